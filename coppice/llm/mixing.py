"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by source, language and topic in one aggregate; every level has its own cell, however many there
are. On that table weights are raked until the token shares of every source, language and topic are the targets: on the
driver up to DRIVER_CELLS cells, and by the same steps on tables of factors, a group-by an axis, beyond. A document's
expected copies are the weight of its cell over a top weight, times the wanted rate, so expected shares are the targets
whatever they are. Cells above the top weight hold CAPPED of the tokens at most, so that a few rare documents do not set
the size of the whole sample; their documents are drawn more than once, as far as no more documents are expected than
there are. Documents are sampled by a hash of doc_id, the same ones at every run.

Target shares may be given; by default a share is its corpus share to the power TEMPER, so large sources are damped.
Levels that given targets do not name share what these leave of 1, in proportion to their tokens; if they leave nothing
though such levels hold tokens, a ValueError names one of them. Targets of levels without tokens are left out.
The synthetic tables have no topic column: the form of a text stands for it (topic_of).

Null sources and languages are a level of their own, named (null); null and empty texts have no tokens, they take the
weight of their cell, or 1 where it holds no tokens. Rows with equal doc_id are sampled alike; rows without doc_id are
drawn one by one, by their place in the input. Extra columns are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

TEMPER, ROUNDS, TOLERANCE = 0.9, 200, 1e-10
#: Cells up to which the driver rakes, and up to which weights are sent to every executor.
DRIVER_CELLS, BROADCAST_CELLS = 500_000, 100_000
#: Part of the tokens in cells that may want more than all of their documents; these are repeated, the others are sampled.
CAPPED = 0.02
MISSING = "(null)"
WORD = r"[^\x20\x09-\x0D]+"
SEED = 11
AXES = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """The form of a text: tabular, symbolic, numeric, long, short or prose."""
    n = F.greatest(F.length(text), F.lit(1))

    def share(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / n

    return F.when(n < 400, "short").when(share("|") > 0.02, "tabular").when(share("#$%&*<>") > 0.05, "symbolic").when(share("0123456789") > 0.05, "numeric").when(n > 6000, "long").otherwise("prose")


def rake(mass: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells that give mass * weights the target shares along each axis. at: each cell's level on each axis, by number; levels without mass are left out of the targets."""
    weights = np.ones(len(mass))
    total = mass.sum()
    if total <= 0:
        return weights
    wanted = []
    for k, t in zip(at, targets, strict=True):
        t = np.where(np.bincount(k, mass, len(t)) > 0, t, 0.0)
        wanted.append(t / t.sum() * total if t.sum() > 0 else None)
    for _ in range(rounds):
        worst = 0.0
        for k, t in zip(at, wanted, strict=True):
            if t is None:
                continue
            now = np.bincount(k, mass * weights, len(t))
            worst = max(worst, float(np.abs(now - t).max() / total))
            weights = weights * np.divide(t, now, out=np.ones_like(t), where=now > 0)[k]
        if worst < tolerance:
            break
    return weights


def rake_table(cells: DataFrame, targets: list[DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same on tables: cells (axes, tokens, n) with _weight. targets: (axis, share), the shares over levels with tokens."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = materialise(cells.withColumn("_weight", F.lit(1.0)))
    for _ in range(rounds if total else 0):
        worst = 0.0
        for axis, target in zip(AXES, targets, strict=True):
            sums = now.groupBy(axis).agg(F.sum(F.col("tokens") * F.col("_weight")).alias("_now"))
            factor = materialise(sums.join(target, axis).select(axis, (F.col("share") * total).alias("_want"), "_now"))
            worst = max(worst, (factor.agg(F.max(F.abs(F.col("_now") - F.col("_want")))).first()[0] or 0.0) / total)
            change = F.when(F.col("_now") > 0, F.col("_want") / F.col("_now")).otherwise(1.0)
            after = materialise(now.join(factor, axis).withColumn("_weight", F.col("_weight") * change).select(*cells.columns, "_weight"))
            discard(now, factor)
            now = after
        if worst < tolerance:
            break
    return now


def target_table(cells: DataFrame, axis: str, given: dict[str, float] | None) -> DataFrame:
    """(axis, share) of every level with tokens."""
    spark = cells.sparkSession
    levels = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("t"))
    if not given:
        raw = levels.withColumn("share", F.when(F.col("t") > 0, F.pow("t", F.lit(TEMPER))).otherwise(0.0))
    else:
        rest = max(0.0, 1.0 - sum(given.values()))
        named = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"`{axis}` string, g double")
        both = levels.join(F.broadcast(named), axis, "left")
        free = both.where("g is null and t > 0").agg(F.sum("t").alias("all"), F.min(axis).alias("one")).first()
        if free["one"] is not None and rest <= 0:
            raise ValueError(f"no target is left for {axis} {free['one']!r}")
        raw = both.withColumn("share", F.when(F.col("t") > 0, F.coalesce("g", F.col("t") / F.lit(float(free["all"] or 1)) * rest)).otherwise(0.0))
    whole = raw.agg(F.sum("share")).first()[0] or 1.0
    return raw.select(axis, (F.col("share") / F.lit(whole)).alias("share"))


def tempered(share: np.ndarray, power: float = TEMPER) -> np.ndarray:
    out = np.where(share > 0, np.maximum(share, 1e-300) ** power, 0.0)
    return out / max(out.sum(), 1e-300)


def target_shares(axis: str, levels: list[str], tokens: np.ndarray, given: dict[str, float] | None) -> np.ndarray:
    """target_table for levels on the driver."""
    if not given:
        return tempered(tokens / max(tokens.sum(), 1))
    rest = max(0.0, 1.0 - sum(given.values()))
    free = np.array([x not in given for x in levels], bool) & (tokens > 0)
    if free.any() and rest <= 0:
        raise ValueError(f"no target is left for {axis} {levels[int(np.flatnonzero(free)[0])]!r}")
    return np.where(free, rest * tokens / max(tokens[free].sum(), 1), [given.get(x, 0.0) for x in levels])


def top_weight(mass: np.ndarray, weights: np.ndarray, capped: float = CAPPED) -> float:
    """The weight of the cell at which the mass, from the largest weights down, goes beyond that part."""
    there = mass > 0
    if not there.any():
        return 1.0
    order = np.argsort(-weights[there], kind="stable")
    w, above = weights[there][order], np.cumsum(mass[there][order]) / mass.sum()
    return float(w[min(int(np.searchsorted(above, capped, "right")), len(w) - 1)])


def with_axes(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")
    return rows.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit(MISSING)), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)), "_topic": topic_of(text), "_tokens": F.regexp_count(text, F.lit(WORD)).cast("bigint"), "_place": F.monotonically_increasing_id()})


def weights_of(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> tuple[DataFrame, float]:
    """(axes and _weight of every cell with tokens, the top weight)."""
    spark, given = cells.sparkSession, targets or {}
    n_cells = cells.count()
    if n_cells > DRIVER_CELLS:
        raked = rake_table(cells.where("tokens > 0"), [target_table(cells, a, given.get(a)) for a in AXES])
        w = F.coalesce("_weight", F.lit(1.0))
        every = cells.join(raked.select(*AXES, "_weight"), list(AXES), "left")
        mean = every.agg(F.sum(F.col("n") * w) / F.sum("n")).first()[0]
        # The weight above which CAPPED of the tokens lie, from the weights' own order.
        ranked = numbered_tokens(raked)
        top = ranked.where(F.col("above") > F.lit(CAPPED)).agg(F.max("_weight")).first()[0] or 1.0
        return raked.select(*AXES, "_weight"), max(float(top), float(mean))
    small = cells.toPandas().sort_values(list(AXES), kind="stable")  # DRIVER_CELLS rows at most
    mass, n = small["tokens"].to_numpy(float), small["n"].to_numpy(float)
    at, wanted = [], []
    for a in AXES:
        levels, k = np.unique(small[a].to_numpy(str), return_inverse=True) if len(small) else (np.zeros(0, str), np.zeros(0, int))
        at.append(k)
        wanted.append(target_shares(a, levels.tolist(), np.bincount(k, mass, len(levels)), given.get(a)))
    weights = rake(mass, at, wanted)
    # No more documents are expected than there are, however often some come.
    top = max(top_weight(mass, weights), float((n * np.where(mass > 0, weights, 1.0)).sum() / max(n.sum(), 1)))
    small = small.assign(_weight=weights)[mass > 0] if len(small) else small.assign(_weight=weights)
    rows = list(small[[*AXES, "_weight"]].itertuples(index=False, name=None))
    return spark.createDataFrame(rows, ", ".join([*(f"{a} string" for a in AXES), "_weight double"])), top


def numbered_tokens(raked: DataFrame) -> DataFrame:
    """_weight, and above: the part of the tokens in cells of at least that weight. By distinct weights, in ranges of the weights."""
    by = raked.groupBy("_weight").agg(F.sum("tokens").alias("t"))
    ranged = materialise(by.repartitionByRange(F.desc("_weight")).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: float(r["t"]) for r in ranged.groupBy("_part").agg(F.sum("t").alias("t")).collect()}  # a row a partition
    total, before, upto = sum(sums.values()), 0.0, {}
    for k in sorted(sums):
        upto[k] = before
        before += sums[k]
    start = F.create_map(*(F.lit(x) for pair in upto.items() for x in pair))[F.col("_part")]
    run = F.sum("t").over(Window.partitionBy("_part").orderBy(F.desc("_weight")))
    return ranged.select("_weight", ((start + run) / F.lit(max(total, 1.0))).alias("above"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = 1.0) -> DataFrame:
    """_row (all columns of docs, whatever their names), _topic, _tokens, _weight, _probability (of at least one copy), _sampled and _copies. targets: shares by axis and level (others damped)."""
    marked = with_axes(docs)
    cells = materialise(marked.groupBy(*(F.col(f"_{a}").alias(a) for a in AXES)).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    known, top = weights_of(cells, targets)
    known = known.select(*(F.col(a).alias(f"_c_{a}") for a in AXES), "_weight")
    on = [F.col(f"_{a}") == F.col(f"_c_{a}") for a in AXES]
    joined = marked.join(F.broadcast(known) if cells.count() <= BROADCAST_CELLS else known, on, "left")
    weight = F.coalesce("_weight", F.lit(1.0))
    expected = weight * F.lit(rate / top)
    whole = F.floor(expected)
    drawn_by = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(SEED), "doc_id")).otherwise(F.xxhash64(F.lit(SEED), F.lit("place"), "_place"))
    draw = F.pmod(drawn_by, F.lit(1 << 53)) / F.lit(float(1 << 53))
    copies = (whole + F.coalesce(draw < expected - whole, F.lit(False)).cast("int")).cast("int")
    drawn = joined.withColumns({"_weight": weight, "_probability": F.least(F.lit(1.0), expected), "_copies": copies})
    return drawn.withColumn("_sampled", F.col("_copies") > 0).select("_row", "_topic", "_tokens", "_weight", "_probability", "_sampled", "_copies")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("_row.doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_sampled").alias("sampled"), F.col("_copies").alias("copies"))
