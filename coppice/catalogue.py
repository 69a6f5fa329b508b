"""The queries of the library's own operators and the SQL that states the same.

Figures are rounded where sums of doubles depend on the order of rows. Queries without SQL are iterative; their results
are invariants and training curves, tested against an in-memory tree.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import criteria, exprs
from .matrices import EVENTS, LINES, ORDERS, PARTS, Matrix
from .operators import binning, bundling, prep, sampling, splits
from .operators.splits import Search
from .plans import bagging, boosting, grow, leafwise, model, newton, registry, store
from .sources import matrix_csv

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        FOUND[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6, **by: int) -> DataFrame:
    """Doubles rounded; by gives other digits for some columns."""
    return df.select(*(F.round(c, by.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where Spark runs in one process and none is named."""
    at = store.folder(spark) or spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        at = os.path.join(tempfile.gettempdir(), "coppice")
    if not at:
        raise ValueError("spark.checkpoint.dir is not set: the executors need a shared folder")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


def centred(rows: DataFrame) -> DataFrame:
    """Labels less their mean over all rows."""
    mean = rows.agg(F.avg("label").alias("_m"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("label", F.col("label") - F.col("_m")).drop("_m")


# --- sources and preprocessing -------------------------------------------------------------------------------------

E, L, P, O = EVENTS, LINES, PARTS, ORDERS  # noqa: E741


@query("validate_matrix", f"WITH b AS ({E.oracle}) SELECT count(*) AS n_rows, count(*) FILTER (WHERE f0 IS NULL OR f1 IS NULL OR label IS NULL OR NOT isfinite(f0) OR NOT isfinite(f1) OR NOT isfinite(label)) AS n_bad, count(label) > 0 AS valid FROM b")
def validate_matrix(spark, sf):
    return matrix_csv.validate(E.read(spark, sf).select("f0", "f1", "label"), "label")


@query("file_stats", f"WITH b AS ({E.oracle}) SELECT count(*) AS total_rows, CAST(3 AS BIGINT) AS total_features, count(*) * 4 * 8 / 1048576.0::DOUBLE AS estimated_memory_mb FROM b")
def file_stats(spark, sf):
    return matrix_csv.file_stats(E.read(spark, sf).select("f0", "f1", "f2", "label"))


@query("zscore_filter", f"WITH b AS ({E.oracle}), s AS (SELECT avg(label) AS m, stddev_pop(label) AS d FROM b) SELECT row_id, label FROM b, s WHERE abs((label - m) / (d + 1e-12)) <= 2.0")
def zscore_filter(spark, sf):
    return prep.zscore_filter(E.read(spark, sf).select("row_id", "label"), "label", 2.0)


@query("equal_freq_binning", f"WITH b AS ({E.oracle}) SELECT row_id, CAST(ntile(16) OVER (ORDER BY label, row_id) - 1 AS INTEGER) AS bin FROM b")
def equal_freq_binning(spark, sf):
    return prep.equal_frequency_bins(E.read(spark, sf).select("row_id", "label"), "label", 16, "row_id").select("row_id", "bin")


@query("binwise_outlier_filter", f"""WITH b AS ({E.oracle}), n AS (SELECT row_id, label, ntile(8) OVER (ORDER BY f0, row_id) - 1 AS bx, ntile(8) OVER (ORDER BY f1, row_id) - 1 AS bo FROM b),
u AS (SELECT row_id, label, bx AS bin FROM n UNION SELECT row_id, label, bo FROM n), s AS (SELECT bin, avg(label) AS m, stddev_pop(label) AS d FROM u GROUP BY bin)
SELECT u.row_id, u.label, CAST(u.bin AS INTEGER) AS bin FROM u JOIN s USING (bin) WHERE abs((u.label - m) / (d + 1e-12)) <= 1.5""")
def binwise_outlier_filter(spark, sf):
    return prep.binwise_filter(E.read(spark, sf), "f0", "f1", 8, 1.5, "label", "row_id").select("row_id", "label", "bin")


@query("seq_split_80_20", f"WITH b AS ({E.oracle}), r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM b) SELECT row_id, CASE WHEN rn <= floor(0.8 * n) THEN 0 ELSE 1 END AS part FROM r")
def seq_split(spark, sf):
    return prep.sequential_split(E.read(spark, sf).select("row_id"), "row_id", (0.8,))


@query("seq_split_3way", f"WITH b AS ({E.oracle}), r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM b) SELECT row_id, CASE WHEN rn <= floor(0.7 * n) THEN 0 WHEN rn <= floor(0.7 * n) + floor(0.2 * n) THEN 1 ELSE 2 END AS part FROM r")
def seq_split_3way(spark, sf):
    return prep.sequential_split(E.read(spark, sf).select("row_id"), "row_id", (0.7, 0.2))


@query("validation_tail", f"WITH b AS ({E.oracle}), r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM b) SELECT row_id FROM r WHERE rn > n - floor(0.15 * n)")
def validation_tail(spark, sf):
    return prep.validation_tail(E.read(spark, sf).select("row_id"), "row_id", 0.15)[1]


@query("batch_scan", f"WITH b AS ({E.oracle}), r AS (SELECT row_id, label, row_number() OVER (ORDER BY row_id) AS rn FROM b) SELECT row_id, label FROM r WHERE rn > 1000 AND rn <= 3000")
def batch_scan(spark, sf):
    """From a CSV file of the rows, in order."""
    at = scratch(spark)
    E.read(spark, sf).select(F.col("row_id").alias("id"), "label").orderBy("id").write.csv(f"{at}/rows.csv", header=True)
    found = matrix_csv.BatchReader(spark, f"{at}/rows.csv", f"{at}/batches").batch(2000, 1000)
    return found.select(F.col("id").cast("bigint").alias("row_id"), "label")


# --- criteria ------------------------------------------------------------------------------------------------------

_GROUPED = f"WITH b AS ({E.oracle}), m AS (SELECT node_id, count(*) AS samples, avg(label) AS node_mean, median(label) AS med FROM b GROUP BY node_id), j AS (SELECT * FROM b JOIN m USING (node_id))"
_CRITERIA = {
    "mse": "round(var_pop(label), 6)",
    "mae": "round(avg(abs(label - med)), 6)",
    "huber": "round(avg(CASE WHEN abs(label - node_mean) <= 1 THEN 0.5 * (label - node_mean) * (label - node_mean) ELSE abs(label - node_mean) - 0.5 END), 6)",
    "logcosh": "round(avg(abs(label - node_mean) + ln(1 + exp(-2 * abs(label - node_mean))) - ln(2)), 6)",
    "poisson": "round(avg(greatest(node_mean, 1e-12) - greatest(label, 1e-12) * ln(greatest(node_mean, 1e-12))), 6)",
}


def _criterion(name: str) -> Query:
    return lambda spark, sf: rounded(criteria.node_metric(E.read(spark, sf), ["node_id"], "label", name))


for _name, _expr in _CRITERIA.items():
    query(f"crit_{_name}", f"{_GROUPED} SELECT node_id, count(*) AS samples, round(avg(label), 6) AS node_mean, {_expr} AS metric FROM j GROUP BY node_id")(_criterion(_name))
for _tau in ("0.25", "0.5", "0.75"):
    query(
        f"crit_quantile{_tau[2:].ljust(2, '0')}",
        f"WITH b AS ({E.oracle}), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY label) - 1 AS k, count(*) OVER (PARTITION BY node_id) AS n FROM b), q AS (SELECT node_id, label AS c FROM r WHERE k = floor({_tau}::DOUBLE * (n - 1))) "
        f"SELECT node_id, count(*) AS samples, round(avg(label), 6) AS node_mean, round(avg((label - c) * CASE WHEN label < c THEN {_tau}::DOUBLE - 1 ELSE {_tau}::DOUBLE END), 6) AS metric FROM b JOIN q USING (node_id) GROUP BY node_id",
    )(_criterion(f"quantile:{_tau}"))


# --- split search --------------------------------------------------------------------------------------------------


def uniform_sql(*parts: str) -> str:
    """The SQL of splits.uniform."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def split_sql(m: "Matrix | Given", finder: str, root: bool) -> str:
    """The SQL of best_splits: the same sums by value or bin, running sums and ties."""
    name, param = registry.finder(finder)
    node = "0" if root else "node_id"
    long = " UNION ALL ".join(f"SELECT {node} AS node_id, {k} AS feature, {c} AS value, y FROM c" for k, c in enumerate(m.features))
    head = f"WITH b AS ({m.oracle}), c AS (SELECT *, label - (SELECT avg(label) FROM b) AS y FROM b), l AS ({long})"
    if name in ("histogram_ew", "adaptive_ew"):
        count = param if name == "histogram_ew" else {"sturges": "CAST(ceil(log2(n)) + 1 AS BIGINT)", "rice": "CAST(ceil(2 * pow(n, 1.0 / 3)) AS BIGINT)", "sqrt": "CAST(ceil(sqrt(n)) AS BIGINT)", "freedman_diaconis": "CAST(CASE WHEN q3 > q1 THEN ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0 / 3))) ELSE ceil(log2(n)) + 1 END AS BIGINT)"}[param]
        count = count if name == "histogram_ew" else f"least(128, greatest(8, {count}))"
        head += f""", ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM l),
s AS (SELECT feature, count(*) AS n, min(value) AS lo, max(value) AS hi, max(value) FILTER (WHERE k = n // 4) AS q1, max(value) FILTER (WHERE k = 3 * n // 4) AS q3 FROM ranked GROUP BY feature),
k AS (SELECT *, {count} AS bins FROM s), e AS (SELECT feature, CASE WHEN x + 1 = bins THEN hi ELSE lo + (hi - lo) / bins * (x + 1) END AS edge FROM k, LATERAL (SELECT unnest(range(CAST(bins AS BIGINT))) AS x))"""
    elif name == "histogram_eq":
        head += f", t AS (SELECT feature, value, ntile({param}) OVER (PARTITION BY feature ORDER BY value) AS x FROM l), e AS (SELECT DISTINCT feature, max(value) AS edge FROM t GROUP BY feature, x)"
    binned = name in ("histogram_ew", "histogram_eq", "adaptive_ew")
    if binned:
        head += ", d AS (SELECT feature, value, min(edge) AS u FROM (SELECT DISTINCT feature, value FROM l) JOIN e USING (feature) WHERE edge >= value GROUP BY feature, value), g AS (SELECT node_id, feature, u AS value, count(*) AS n, sum(y) AS s FROM l JOIN d USING (feature, value) GROUP BY 1, 2, 3)"
    else:
        head += ", g AS (SELECT node_id, feature, value, count(*) AS n, sum(y) AS s FROM l GROUP BY 1, 2, 3)"
    head += """, w AS (SELECT *, sum(n) OVER r AS ln, sum(s) OVER r AS ls, sum(n) OVER p AS tn, sum(s) OVER p AS ts, lead(value) OVER o AS nxt, min(value) OVER p AS lo, max(value) OVER p AS hi,
 sum(n * value) OVER p AS sv FROM g WINDOW p AS (PARTITION BY node_id, feature), o AS (PARTITION BY node_id, feature ORDER BY value), r AS (PARTITION BY node_id, feature ORDER BY value ROWS UNBOUNDED PRECEDING))"""
    middle, where = "(value + nxt) / 2", "nxt > value + 1e-12"
    source = "w"
    if binned:
        middle, where = "value", "nxt IS NOT NULL"
    elif name == "quartile":
        middle = "value"
        where = "nxt IS NOT NULL AND tn >= 4 AND (" + " OR ".join(f"(ln > floor({q}::DOUBLE * (tn - 1)) AND ln - n <= floor({q}::DOUBLE * (tn - 1)))" for q in ("0.25", "0.5", "0.75")) + ")"
    elif name == "adaptive_eq":
        head += ", v AS (SELECT *, sum(n * (value - sv / tn) * (value - sv / tn)) OVER (PARTITION BY node_id, feature) / tn AS var FROM w), z AS (SELECT *, sqrt(var) / (abs(sv / tn) + 1e-12) AS cv FROM v), y AS (SELECT *, greatest(2, least(CASE WHEN cv < 0.1 THEN least(greatest(floor(sqrt(tn) / 2), 4), 16) ELSE least(greatest(floor(sqrt(tn)), 8), 64) END, floor(tn / 5.0))) AS bins FROM z), x AS (SELECT *, greatest(5, floor(tn / bins)) AS size FROM y)"
        source, where = "x", "nxt > value + 1e-12 AND tn >= 10 AND ln % size = 0 AND ln >= 5 AND tn - ln >= 5"
    elif name == "random":
        head += f", q AS (SELECT *, lo + {uniform_sql('node_id', 'feature', 'j', '42')} * (hi - lo) AS thr FROM w, LATERAL (SELECT unnest(range(1, {int(param) + 1})) AS j))"
        source, middle, where = "q", "thr", "hi - lo >= 1e-12 AND value <= thr AND nxt > thr"
    return f"""{head}, f AS (SELECT node_id, feature, {middle} AS threshold, (ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln)) / tn - (ts / tn) * (ts / tn) AS gain, ln, tn FROM {source} WHERE {where}),
o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY gain DESC, feature, threshold) AS rn FROM f WHERE gain > 0)
SELECT CAST(node_id AS INTEGER) AS node_id, CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain, CAST(ln AS BIGINT) AS n_left, CAST(tn - ln AS BIGINT) AS n_right FROM o WHERE rn = 1"""


def _split(m: Matrix, finder: str, root: bool) -> Query:
    def run(spark, sf):
        rows = centred(m.read(spark, sf))
        rows = rows.withColumn("node_id", F.lit(0)) if root else rows
        s = splits.with_edges(rows, Search(features=list(m.features), finder=finder))
        return rounded(splits.best_splits(rows, s), gain=4)

    return run


SPLITS = {
    "split_exhaustive": (L, "exhaustive", False),
    "split_exhaustive_root": (E, "exhaustive", True),
    "split_exhaustive_ties": (P, "exhaustive", True),
    "split_quartile": (E, "quartile", False),
    "split_random": (E, "random:10", False),
    "split_hist_ew": (E, "histogram_ew:32", False),
    "split_hist_eq": (E, "histogram_eq:32", False),
    "split_adaptive_ew_sturges": (E, "adaptive_ew:sturges", False),
    "split_adaptive_ew_rice": (E, "adaptive_ew:rice", False),
    "split_adaptive_ew_sqrt": (E, "adaptive_ew:sqrt", False),
    "split_adaptive_ew_fd": (E, "adaptive_ew:freedman_diaconis", False),
    "split_adaptive_eq": (E, "adaptive_eq", False),
}
for _key, _args in SPLITS.items():
    query(_key, split_sql(*_args))(_split(*_args))


def newton_sql(gamma: float, least: float) -> str:
    score = "CASE WHEN {h} + 1 > 0 THEN 0.5 * ({g}) * ({g}) / ({h} + 1) ELSE 0 END"
    g = f"{score.format(g='lg', h='lh')} + {score.format(g='tg - lg', h='th - lh')} - {score.format(g='tg', h='th')}"
    long = " UNION ALL ".join(f"SELECT node_id, {k} AS feature, {c} AS value, g, h FROM c" for k, c in enumerate(E.features))
    return f"""WITH b AS ({E.oracle}), c AS (SELECT *, (SELECT avg(label) FROM b) - label AS g, 1.0::DOUBLE AS h FROM b), l AS ({long}),
a AS (SELECT node_id, feature, value, count(*) AS n, sum(g) AS sg, sum(h) AS sh FROM l GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER r AS ln, sum(sg) OVER r AS lg, sum(sh) OVER r AS lh, sum(n) OVER p AS tn, sum(sg) OVER p AS tg, sum(sh) OVER p AS th, lead(value) OVER o AS nxt FROM a WINDOW p AS (PARTITION BY node_id, feature), o AS (PARTITION BY node_id, feature ORDER BY value), r AS (PARTITION BY node_id, feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
f AS (SELECT node_id, feature, (value + nxt) / 2 AS threshold, {g} AS gain, ln, tn FROM w WHERE nxt > value + 1e-12 AND lh >= {least} AND th - lh >= {least}),
o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY gain DESC, feature, threshold) AS rn FROM f WHERE gain > {gamma})
SELECT CAST(node_id AS INTEGER) AS node_id, CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain, CAST(ln AS BIGINT) AS n_left, CAST(tn - ln AS BIGINT) AS n_right FROM o WHERE rn = 1"""


def _newton(gamma: float, least: float) -> Query:
    def run(spark, sf):
        rows = E.read(spark, sf)
        mean = rows.agg(F.avg("label").alias("_m"))
        rows = rows.crossJoin(F.broadcast(mean)).withColumns({"_g": F.col("_m") - F.col("label"), "_h": F.lit(1.0)})
        return rounded(splits.best_splits(rows, Search(features=list(E.features), newton=("_g", "_h"), gamma=gamma, min_child_weight=least)), gain=4)

    return run


query("split_newton", newton_sql(0.0, 1.0))(_newton(0.0, 1.0))
query("split_newton_gamma_mcw", newton_sql(5.0, 200.0))(_newton(5.0, 200.0))


_QUARTILES = f"""WITH b AS ({E.oracle}), l AS ({" UNION ALL ".join(f"SELECT node_id, {k} AS feature, {c} AS value, label FROM b" for k, c in enumerate(E.features))}), r AS (SELECT *, row_number() OVER (PARTITION BY node_id, feature ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY node_id, feature) AS n, max(value) OVER (PARTITION BY node_id, feature) AS hi FROM l),
t AS (SELECT DISTINCT node_id, feature, value AS threshold FROM r WHERE n >= 4 AND value < hi AND (k = floor(0.25::DOUBLE * (n - 1)) OR k = floor(0.5::DOUBLE * (n - 1)) OR k = floor(0.75::DOUBLE * (n - 1)))),
s AS (SELECT l.node_id, l.feature, t.threshold, l.value <= t.threshold AS goes, l.label, median(l.label) OVER (PARTITION BY l.node_id, l.feature, t.threshold, l.value <= t.threshold) AS med FROM l JOIN t USING (node_id, feature)),
c AS (SELECT node_id, feature, threshold, sum(abs(label - med)) / count(*) AS children, count(*) FILTER (WHERE goes) AS n_left, count(*) FILTER (WHERE NOT goes) AS n_right FROM s GROUP BY 1, 2, 3), p AS (SELECT node_id, avg(abs(label - med)) AS parent FROM (SELECT node_id, label, median(label) OVER (PARTITION BY node_id) AS med FROM b) GROUP BY 1),
o AS (SELECT *, parent - children AS gain, row_number() OVER (PARTITION BY node_id ORDER BY parent - children DESC, feature, threshold) AS rn FROM c JOIN p USING (node_id) WHERE parent > children)
SELECT node_id, CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain, n_left, n_right FROM o WHERE rn = 1"""


@query("split_criterion_quartile", _QUARTILES)
def split_criterion_quartile(spark, sf):
    """Quartile thresholds judged by mean absolute error."""
    return rounded(splits.best_splits(E.read(spark, sf), Search(features=list(E.features), finder="quartile", criterion="mae")), gain=4)


# --- histograms ----------------------------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT {k} AS feature, {c} AS value, label FROM b" for k, c in enumerate(E.features))
_EDGES_EW = "s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature), e AS (SELECT feature, CAST(x AS INTEGER) AS bin, CASE WHEN x = 15 THEN hi ELSE lo + (hi - lo) / 16 * (x + 1) END AS edge FROM s, LATERAL (SELECT unnest(range(16)) AS x))"
_HIST = f"WITH b AS ({E.oracle}), l AS ({_LONG}), {_EDGES_EW}, d AS (SELECT feature, value, min(bin) AS bin FROM (SELECT DISTINCT feature, value FROM l) JOIN e USING (feature) WHERE edge >= value GROUP BY 1, 2), h AS (SELECT feature, bin, count(*) AS cnt, sum(label) AS s1, sum(label * label) AS s2 FROM l JOIN d USING (feature, value) GROUP BY 1, 2)"


@query("hist_ew_bins", f"WITH b AS ({E.oracle}), l AS ({_LONG}), {_EDGES_EW} SELECT CAST(feature AS INTEGER) AS feature, bin, round(edge, 6) AS edge FROM e")
def hist_ew_bins(spark, sf):
    return _edge_table(spark, binning.equal_width(E.read(spark, sf), list(E.features), 16))


def _edge_table(spark: SparkSession, edges: dict[int, list[float]]) -> DataFrame:
    return spark.createDataFrame([(k, b, round(x, 6)) for k, e in edges.items() for b, x in enumerate(e)], "feature int, bin int, edge double")


@query("hist_eq_bins", f"WITH b AS ({E.oracle}), l AS ({_LONG}), t AS (SELECT feature, value, ntile(16) OVER (PARTITION BY feature ORDER BY value) AS x FROM l), e AS (SELECT DISTINCT feature, max(value) AS edge FROM t GROUP BY feature, x) SELECT CAST(feature AS INTEGER) AS feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS INTEGER) AS bin, round(edge, 6) AS edge FROM e")
def hist_eq_bins(spark, sf):
    return _edge_table(spark, binning.equal_frequency(E.read(spark, sf), list(E.features), 16))


@query("hist_adaptive_bins", f"WITH b AS ({E.oracle}), l AS ({_LONG}), s AS (SELECT feature, count(*) AS n FROM l GROUP BY feature) SELECT CAST(feature AS INTEGER) AS feature, CAST(least(128, greatest(8, ceil(2 * pow(n, 1.0 / 3)))) AS INTEGER) AS bins FROM s")
def hist_adaptive_bins(spark, sf):
    edges = binning.equal_width_adaptive(E.read(spark, sf), list(E.features), "rice")
    return spark.createDataFrame([(k, len(e)) for k, e in edges.items()], "feature int, bins int")


@query("hist_prefix", f"{_HIST} SELECT CAST(feature AS INTEGER) AS feature, bin, cnt, round(s1, 4) AS s1, round(s2, 4) AS s2, CAST(sum(cnt) OVER w AS BIGINT) AS c_cnt, round(sum(s1) OVER w, 4) AS c_s1, round(sum(s2) OVER w, 4) AS c_s2 FROM h WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)")
def hist_prefix(spark, sf):
    rows = E.read(spark, sf)
    return rounded(binning.histogram(rows, list(E.features), binning.equal_width(rows, list(E.features), 16), "label"), 4)


@query("hist_subtraction", f"{_HIST}, c AS (SELECT feature, bin, count(*) AS cnt, sum(label) AS s1, sum(label * label) AS s2 FROM (SELECT feature, value, label FROM (SELECT f0, f1, f2, label FROM b WHERE f0 > 50) b2, LATERAL (SELECT unnest([0, 1, 2]) AS feature, unnest([f0, f1, f2]) AS value)) JOIN d USING (feature, value) GROUP BY 1, 2) SELECT CAST(feature AS INTEGER) AS feature, bin, cnt, round(s1, 4) AS s1, round(s2, 4) AS s2 FROM c")
def hist_subtraction(spark, sf):
    rows = E.read(spark, sf)
    edges = binning.equal_width(rows, list(E.features), 16)
    whole, left = (binning.histogram(x, list(E.features), edges, "label") for x in (rows, rows.where("f0 <= 50")))
    return rounded(binning.subtract(whole, left).select("feature", "bin", "cnt", "s1", "s2"), 4)


# --- losses --------------------------------------------------------------------------------------------------------

_LOSSES = {
    "squared": (exprs.squared(), "0.5 * (y - p) * (y - p)", "y - p", "1.0"),
    "huber": (exprs.huber(1.0), "CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) * (y - p) ELSE abs(y - p) - 0.5 END", "least(greatest(y - p, -1), 1)", "CASE WHEN abs(y - p) <= 1 THEN 1.0 ELSE 0.0 END"),
    "absolute": (exprs.absolute(), "abs(y - p)", "sign(y - p)", "0.0"),
    "quantile": (exprs.quantile(0.75), "CASE WHEN y >= p THEN 0.75 * (y - p) ELSE -0.25 * (y - p) END", "CASE WHEN y >= p THEN 0.75 ELSE -0.25 END", "0.0"),
    "newton_squared": (exprs.newton_squared(), "0.5 * (y - p) * (y - p)", "p - y", "1.0"),
    "logistic": (exprs.newton_logistic(), "y * ln(1 + exp(-p)) + (1 - y) * ln(1 + exp(p))", "1 / (1 + exp(-p)) - y", "1 / (1 + exp(-p)) * (1 - 1 / (1 + exp(-p)))"),
}


def _loss(loss: exprs.Loss, scale: bool) -> Query:
    def run(spark, sf):
        rows = E.read(spark, sf).select("row_id", (F.col("label") > 20).cast("double").alias("y") if scale else F.col("label").alias("y"), (F.col("f1") / 50.0 - 1 if scale else F.col("f1") / 2.0).alias("p"))
        y, p = F.col("y"), F.col("p")
        return rounded(rows.select("row_id", loss.loss(y, p).cast("double").alias("loss"), loss.gradient(y, p).cast("double").alias("gradient"), loss.hessian(y, p).cast("double").alias("hessian")))

    return run


for _key, (_l, _a, _g, _h) in _LOSSES.items():
    _is = _key == "logistic"
    _src = "CAST(label > 20 AS DOUBLE) AS y, f1 / 50.0::DOUBLE - 1 AS p" if _is else "label AS y, f1 / 2.0::DOUBLE AS p"
    query(f"loss_{_key}", f"WITH b AS ({E.oracle}), c AS (SELECT row_id, {_src} FROM b) SELECT row_id, round(CAST({_a} AS DOUBLE), 6) AS loss, round(CAST({_g} AS DOUBLE), 6) AS gradient, round(CAST({_h} AS DOUBLE), 6) AS hessian FROM c")(_loss(_l, _is))


# --- trees of depth one: one split, then the means of its sides -----------------------------------------------------

_BEST = split_sql(P, "exhaustive", True)
_STUMP = f"WITH best AS ({_BEST}), b AS ({P.oracle}), s AS (SELECT b.*, CASE WHEN CASE best.feature WHEN 0 THEN f0 ELSE f1 END <= best.threshold THEN 1 ELSE 2 END AS leaf FROM b, best), m AS (SELECT leaf, avg(label) AS prediction FROM s GROUP BY leaf), p AS (SELECT * FROM s JOIN m USING (leaf))"


def _stump(spark: SparkSession, sf: str, **more) -> tuple[DataFrame, model.Tree]:
    rows = P.read(spark, sf)
    return rows, grow.train_tree(rows, list(P.features), max_depth=more.pop("depth", 1), min_leaf=1, local=False, **more)


def _scored(rows: DataFrame, tree: model.Tree, features) -> DataFrame:
    out = model.Ensemble(list(features))
    out.add(tree)
    return out.score(rows)


@query("tree_depth1_predict", f"{_STUMP} SELECT row_id, round(prediction, 6) AS prediction FROM p")
def tree_depth1_predict(spark, sf):
    rows, tree = _stump(spark, sf)
    return rounded(_scored(rows, tree, P.features).select("row_id", "prediction"))


@query("tree_eval_mse_mae", f"{_STUMP} SELECT count(*) AS n, round(avg((label - prediction) * (label - prediction)), 4) AS mse, round(avg(abs(label - prediction)), 5) AS mae FROM p")
def tree_eval(spark, sf):
    rows, tree = _stump(spark, sf)
    return rounded(criteria.evaluate(_scored(rows, tree, P.features)), mse=4, mae=5)


@query("tree_importance", f"WITH best AS ({_BEST}), f AS (SELECT CAST(unnest(range(2)) AS INTEGER) AS feature) SELECT f.feature, CASE WHEN best.feature = f.feature THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM f, best")
def tree_importance(spark, sf):
    _, tree = _stump(spark, sf)
    return model.importance(model.node_table(spark, list(tree.values())), 2)


@query("top10_importance", f"WITH best AS ({_BEST}), f AS (SELECT CAST(unnest(range(2)) AS INTEGER) AS feature) SELECT f.feature, CASE WHEN best.feature = f.feature THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM f, best ORDER BY importance DESC, feature DESC LIMIT 10")
def top10_importance(spark, sf):
    _, tree = _stump(spark, sf)
    return model.top_importance(model.importance(model.node_table(spark, list(tree.values())), 2))


@dataclass(frozen=True)
class Given:
    """Rows of a query instead of a table: what split_sql needs of a Matrix."""

    oracle: str
    features: tuple[str, ...]


def side(m: Given | Matrix, split: str, left: str, right: str) -> str:
    """SQL of the side of a row under the split of that name."""
    value = "CASE " + " ".join(f"WHEN {split}.feature = {k} THEN {c}" for k, c in enumerate(m.features)) + " END"
    return f"CASE WHEN {value} <= {split}.threshold THEN {left} ELSE {right} END"


def two_levels(m: Given | Matrix) -> str:
    """CTEs of a tree of depth two: n1 (rows with node_id 1 or 2) and n2 (rows with leaf 1 to 6, inner node 0 at the root)."""
    first = f"SELECT b.* EXCLUDE (node_id), {side(m, 'best', '1', '2')} AS node_id FROM ({m.oracle}) b, ({split_sql(m, 'exhaustive', True)}) best"
    second = split_sql(Given(first, m.features), "exhaustive", False)
    return f"n1 AS ({first}), second AS ({second}), n2 AS (SELECT n1.*, CASE WHEN second.node_id IS NULL THEN n1.node_id ELSE 2 * n1.node_id + {side(m, 'second', '1', '2')} END AS leaf FROM n1 LEFT JOIN second USING (node_id))"


_TWO = f"WITH {two_levels(P)}, m2 AS (SELECT leaf, avg(label) AS prediction FROM n2 GROUP BY leaf)"


@query("tree_stats", f"{_TWO} SELECT 0 AS tree_id, CASE WHEN count(*) > 2 THEN 2 ELSE 1 END AS depth, count(*) AS n_leaves, 2 * count(*) - 1 AS n_nodes FROM m2")
def tree_stats(spark, sf):
    _, tree = _stump(spark, sf, depth=2)
    return model.stats(model.node_table(spark, list(tree.values())))


@query("tree_depth2_predict", f"{_TWO} SELECT row_id, round(prediction, 6) AS prediction FROM n2 JOIN m2 USING (leaf)")
def tree_depth2_predict(spark, sf):
    rows, tree = _stump(spark, sf, depth=2)
    return rounded(_scored(rows, tree, P.features).select("row_id", "prediction"))


@query("tree_nodes_deep")
def tree_nodes_deep(spark, sf):
    tree = grow.train_tree(E.read(spark, sf), list(E.features), max_depth=8, min_leaf=20)
    return rounded(model.node_table(spark, list(tree.values())))


@query("tree_histogram_level_wise")
def tree_histogram(spark, sf):
    tree = grow.train_tree(L.read(spark, sf), list(L.features), finder="histogram_ew:32", max_depth=5, min_leaf=5)
    return rounded(model.node_table(spark, list(tree.values())))


# --- pruners -------------------------------------------------------------------------------------------------------

_LEAF_SUMS = "n AS (SELECT node_id, leaf, count(*) AS c, avg(label) AS m, var_pop(label) * count(*) AS sse FROM n2 GROUP BY 1, 2), i AS (SELECT node_id, count(*) AS c, avg(label) AS m, var_pop(label) * count(*) AS sse FROM n1 GROUP BY 1), r AS (SELECT count(*) AS c, avg(label) AS m, var_pop(label) * count(*) AS sse FROM n1)"
_GAIN, _ALPHA = 60_000.0, 2500.0


def _leaves_of(spark: SparkSession, tree: model.Tree) -> DataFrame:
    return rounded(model.node_table(spark, list(tree.values())).where("is_leaf").select("samples", "prediction"))


@query("prune_none", f"WITH {two_levels(P)}, {_LEAF_SUMS} SELECT c AS samples, round(m, 6) AS prediction FROM n")
def prune_none(spark, sf):
    _, tree = _stump(spark, sf, depth=2, pruner="none")
    return _leaves_of(spark, tree)


@query("prune_mingain", f"""WITH {two_levels(L)}, {_LEAF_SUMS}, k AS (SELECT i.node_id, i.c, i.m, (i.sse - sum(n.sse)) / i.c AS gain FROM i JOIN n USING (node_id) GROUP BY i.node_id, i.c, i.m, i.sse), rg AS (SELECT (r.sse - (SELECT sum(sse) FROM i)) / r.c AS gain FROM r)
SELECT c AS samples, round(m, 3) AS prediction FROM r WHERE (SELECT gain FROM rg) < {_GAIN} UNION ALL SELECT c, round(m, 3) FROM k WHERE gain < {_GAIN} AND (SELECT gain FROM rg) >= {_GAIN} UNION ALL SELECT n.c, round(n.m, 3) FROM n JOIN k USING (node_id) WHERE gain >= {_GAIN} AND (SELECT gain FROM rg) >= {_GAIN}""")
def prune_mingain(spark, sf):
    tree = grow.train_tree(L.read(spark, sf), list(L.features), max_depth=2, min_leaf=1, pruner="mingain", prune_param=_GAIN)
    return rounded(_leaves_of(spark, tree), 3)


@query("prune_cost_complexity", f"""WITH {two_levels(P)}, {_LEAF_SUMS}, k AS (SELECT i.node_id, i.c, i.m, i.sse, i.sse + {_ALPHA} <= sum(n.sse) + {_ALPHA} * count(*) AS falls FROM i JOIN n USING (node_id) GROUP BY i.node_id, i.c, i.m, i.sse),
left_ AS (SELECT c, m, sse FROM k WHERE falls UNION ALL SELECT n.c, n.m, n.sse FROM n JOIN k USING (node_id) WHERE NOT falls), root AS (SELECT r.sse + {_ALPHA} <= (SELECT sum(sse) + {_ALPHA} * count(*) FROM left_) AS falls FROM r)
SELECT c AS samples, round(m, 6) AS prediction FROM r WHERE (SELECT falls FROM root) UNION ALL SELECT c, round(m, 6) FROM left_ WHERE NOT (SELECT falls FROM root)""")
def prune_cost_complexity(spark, sf):
    _, tree = _stump(spark, sf, depth=2, pruner="cost_complexity", prune_param=_ALPHA)
    return _leaves_of(spark, tree)


_TRAINED = Given(f"SELECT * EXCLUDE (rn, n) FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM ({E.oracle})) WHERE rn <= floor(0.7 * n)", E.features)
_CHECKED = f"SELECT * EXCLUDE (rn, n) FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM ({E.oracle})) WHERE rn > floor(0.7 * n) AND rn <= floor(0.7 * n) + floor(0.2 * n)"


@query("prune_reduced_error_depth2", f"""WITH {two_levels(_TRAINED)}, {_LEAF_SUMS}, best AS ({split_sql(_TRAINED, 'exhaustive', True)}), v1 AS (SELECT v.* EXCLUDE (node_id), {side(E, 'best', '1', '2')} AS node_id FROM ({_CHECKED}) v, best),
v2 AS (SELECT v1.*, CASE WHEN second.node_id IS NULL THEN v1.node_id ELSE 2 * v1.node_id + {side(E, 'second', '1', '2')} END AS leaf FROM v1 LEFT JOIN second USING (node_id)),
el AS (SELECT n.node_id, n.leaf, n.c, n.m, coalesce(sum((v2.label - n.m) * (v2.label - n.m)), 0) AS e FROM n LEFT JOIN v2 USING (leaf) GROUP BY n.node_id, n.leaf, n.c, n.m), ei AS (SELECT i.node_id, i.c, i.m, coalesce(sum((v1.label - i.m) * (v1.label - i.m)), 0) AS e FROM i LEFT JOIN v1 USING (node_id) GROUP BY i.node_id, i.c, i.m),
k AS (SELECT ei.node_id, ei.c, ei.m, ei.e, ei.e <= sum(el.e) + 1e-12 AS falls FROM ei JOIN el USING (node_id) GROUP BY ei.node_id, ei.c, ei.m, ei.e), left_ AS (SELECT c, m, e FROM k WHERE falls UNION ALL SELECT el.c, el.m, el.e FROM el JOIN k USING (node_id) WHERE NOT falls),
root AS (SELECT (SELECT sum((label - r.m) * (label - r.m)) FROM v1) <= (SELECT sum(e) FROM left_) + 1e-12 AS falls FROM r)
SELECT c AS samples, round(m, 6) AS prediction FROM r WHERE (SELECT falls FROM root) UNION ALL SELECT c, round(m, 6) FROM left_ WHERE NOT (SELECT falls FROM root)""")
def prune_reduced_error_depth2(spark, sf):
    train, validation, _ = prep.train_validation_test(E.read(spark, sf), "row_id", 0.2)
    return _leaves_of(spark, grow.train_tree(train, list(E.features), max_depth=2, min_leaf=1, pruner="reduced_error", validation=validation, local=False))


@query("prune_reduced_error")
def prune_reduced_error(spark, sf):
    train, validation, _ = prep.train_validation_test(E.read(spark, sf), "row_id", 0.2)
    tree = grow.train_tree(train, list(E.features), max_depth=5, min_leaf=5, pruner="reduced_error", validation=validation)
    return rounded(model.node_table(spark, list(tree.values())))


# --- boosting ------------------------------------------------------------------------------------------------------

@query("gbrt_base_score", f"WITH b AS ({E.oracle}) SELECT round(avg(label), 6) AS base_score FROM b")
def gbrt_base_score(spark, sf):
    return rounded(E.read(spark, sf).agg(F.avg("label").alias("base_score")))


@query("gbrt_one_round", f"{_STUMP}, a AS (SELECT avg(label) AS m FROM b) SELECT row_id, round(m + 0.1::DOUBLE * (prediction - m), 6) AS prediction FROM p, a")
def gbrt_one_round(spark, sf):
    rows = P.read(spark, sf)
    made = boosting.train(rows, list(P.features), "label", "row_id", boosting.BoostingConfig(rounds=1, rate=0.1, max_depth=1, local=False))
    return rounded(made.score(rows).select("row_id", "prediction"))


@query("newton_one_round", f"{_STUMP}, a AS (SELECT avg(label) AS m FROM b), g AS (SELECT leaf, sum(label - m) / (count(*) + 1) AS wt FROM s, a GROUP BY leaf) SELECT row_id, round(m + 0.3::DOUBLE * wt, 6) AS prediction FROM s JOIN g USING (leaf), a")
def newton_one_round(spark, sf):
    rows = P.read(spark, sf)
    made = newton.train(rows, list(P.features), "label", "row_id", newton.NewtonConfig(rounds=1, max_depth=1, local=False))
    return rounded(made.score(rows).select("row_id", "prediction"))


def two_stumps(rate: str, lam: str) -> str:
    """CTEs of two rounds of stumps on P: o2 has row_id, label, p1 and p2, the predictions after one and two rounds. lam: added to each leaf's count."""
    value = f"sum(label) / (count(*) + {lam})"
    one = f"SELECT row_id, f0, f1, 0 AS node_id, b.label - a.m AS label, b.label AS target, a.m FROM ({P.oracle}) b, (SELECT avg(label) AS m FROM ({P.oracle})) a"
    r1 = f"r1 AS ({one}), best1 AS ({split_sql(Given(one, P.features), 'exhaustive', True)}), l1 AS (SELECT r1.*, {side(P, 'best1', '1', '2')} AS leaf FROM r1, best1), w1 AS (SELECT leaf, {value} AS w FROM l1 GROUP BY leaf), o1 AS (SELECT row_id, f0, f1, target, m + {rate} * w AS p1 FROM l1 JOIN w1 USING (leaf))"
    two = f"SELECT row_id, f0, f1, 0 AS node_id, target - p1 AS label, target, p1 FROM (WITH {r1} SELECT * FROM o1)"
    return f"r2 AS ({two}), best2 AS ({split_sql(Given(two, P.features), 'exhaustive', True)}), l2 AS (SELECT r2.*, {side(P, 'best2', '1', '2')} AS leaf FROM r2, best2), w2 AS (SELECT leaf, {value} AS w FROM l2 GROUP BY leaf), o2 AS (SELECT row_id, target AS y, p1, p1 + {rate} * w AS p2 FROM l2 JOIN w2 USING (leaf))"


@query("gbrt_two_rounds", f"WITH {two_stumps('0.1::DOUBLE', '0')} SELECT row_id, round(p2, 6) AS prediction FROM o2")
def gbrt_two_rounds(spark, sf):
    rows = P.read(spark, sf)
    made = boosting.train(rows, list(P.features), "label", "row_id", boosting.BoostingConfig(rounds=2, rate=0.1, max_depth=1, local=False))
    return rounded(made.score(rows).select("row_id", "prediction"))


@query("gbrt_evaluate", f"WITH {two_stumps('0.1::DOUBLE', '0')} SELECT count(*) AS n, round(avg(0.5 * (y - p2) * (y - p2)), 4) AS loss, round(avg((y - p2) * (y - p2)), 4) AS mse, round(avg(abs(y - p2)), 5) AS mae FROM o2")
def gbrt_evaluate(spark, sf):
    rows, config = P.read(spark, sf), boosting.BoostingConfig(rounds=2, rate=0.1, max_depth=1, local=False)
    made = boosting.train(rows, list(P.features), "label", "row_id", config)
    return rounded(boosting.evaluate(made, rows, "label", config), loss=4, mse=4, mae=5)


@query("gbrt_curve_of_stumps", f"WITH {two_stumps('0.1::DOUBLE', '0')}, a AS (SELECT avg(y) AS m FROM o2) SELECT 0 AS iter, round(avg(0.5 * (y - m) * (y - m)), 3) AS train_loss FROM o2, a UNION ALL SELECT 1, round(avg(0.5 * (y - p1) * (y - p1)), 3) FROM o2")
def gbrt_curve_of_stumps(spark, sf):
    made = boosting.train(P.read(spark, sf), list(P.features), "label", "row_id", boosting.BoostingConfig(rounds=2, rate=0.1, max_depth=1, local=False))
    return rounded(_curve(spark, made).select("iter", "train_loss"), 3)


@query("gbrt_ensemble_stats", "SELECT CAST(2 AS BIGINT) AS trees, CAST(2 AS BIGINT) AS depths, CAST(4 AS BIGINT) AS leaves, CAST(6 AS BIGINT) AS nodes, CAST(480 AS BIGINT) AS bytes FROM (SELECT count(*) AS c FROM part) WHERE c > 1")
def gbrt_ensemble_stats(spark, sf):
    made = boosting.train(P.read(spark, sf), list(P.features), "label", "row_id", boosting.BoostingConfig(rounds=2, rate=0.1, max_depth=1, local=False))
    return model.ensemble_stats(made.nodes(spark))


@query("newton_two_rounds", f"WITH {two_stumps('0.3::DOUBLE', '1')} SELECT row_id, round(p2, 5) AS prediction FROM o2")
def newton_two_rounds(spark, sf):
    rows = P.read(spark, sf)
    made = newton.train(rows, list(P.features), "label", "row_id", newton.NewtonConfig(rounds=2, max_depth=1, lam=1.0, local=False))
    return rounded(made.score(rows).select("row_id", "prediction"), 5)


@query("newton_leaf_weights", f"WITH b AS ({E.oracle}), a AS (SELECT avg(label) AS m FROM b) SELECT node_id, round(-sum(m - label) / (count(*) + 1.0), 6) AS weight, round(0.5 * sum(m - label) * sum(m - label) / (count(*) + 1.0), 4) AS score FROM b, a GROUP BY node_id")
def newton_leaf_weights(spark, sf):
    rows = E.read(spark, sf)
    with_g = rows.crossJoin(F.broadcast(rows.agg(F.avg("label").alias("_m")))).withColumn("_g", F.col("_m") - F.col("label"))
    sums = with_g.groupBy("node_id").agg(F.sum("_g").alias("g"), F.count(F.lit(1)).cast("double").alias("h"))
    return rounded(sums.select("node_id", exprs.leaf_weight(F.col("g"), F.col("h")).alias("weight"), exprs.structure_score(F.col("g"), F.col("h")).alias("score")), score=4)


@query("line_search_grid", f"WITH b AS ({E.oracle}), r AS (SELECT unnest([0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS rate), a AS (SELECT avg(label) AS m FROM b) SELECT rate, round(avg(0.5 * (label - m - rate * (f1 - 50) / 10) * (label - m - rate * (f1 - 50) / 10)), 4) AS loss FROM b, r, a GROUP BY rate")
def line_search_grid(spark, sf):
    rows = E.read(spark, sf)
    made = rows.crossJoin(F.broadcast(rows.agg(F.avg("label").alias("_pred")))).withColumn("_step", (F.col("f1") - 50) / 10)
    return rounded(boosting.loss_grid(made, exprs.squared(), "label", "_pred", "_step", [0.0, 0.25, 0.5, 1.0]), 4)


def _curve(spark: SparkSession, made: model.Ensemble) -> DataFrame:
    return rounded(spark.createDataFrame([(h["iter"], h["train_loss"], h["lr"], h["n_dropped"]) for h in made.history], "iter int, train_loss double, lr double, n_dropped int"))


@query("gbrt_train_curve")
def gbrt_train_curve(spark, sf):
    return _curve(spark, boosting.train(P.read(spark, sf), list(P.features), "label", "row_id", boosting.BoostingConfig(rounds=4, max_depth=3)))


@query("gbrt_line_search_curve")
def gbrt_line_search_curve(spark, sf):
    return _curve(spark, boosting.train(P.read(spark, sf), list(P.features), "label", "row_id", boosting.BoostingConfig(loss="huber:50", rounds=2, max_depth=2, line_search=True)))


@query("dart_two_stumps", f"{_STUMP}, a AS (SELECT avg(label) AS m FROM b) SELECT row_id, round(m + (0.1::DOUBLE + 0.1::DOUBLE * 0.1::DOUBLE * 1.05::DOUBLE) * (prediction - m), 6) AS prediction FROM p, a")
def dart_two_stumps(spark, sf):
    """The second round leaves out the first tree, so it fits the same residuals; its weight follows the mild variant."""
    rows = P.read(spark, sf)
    made = boosting.train(rows, list(P.features), "label", "row_id", boosting.BoostingConfig(rounds=2, rate=0.1, max_depth=1, dart=True, drop_rate=0.5, normalise="mild", local=False))
    return rounded(made.score(rows).select("row_id", "prediction"))


_LEAF_BINS = "histogram_ew:16"
_ONE_SPLIT = f"SELECT b.* EXCLUDE (node_id), {side(P, 'best', '1', '2')} AS node_id FROM ({P.oracle}) b, ({split_sql(P, _LEAF_BINS, True)}) best"


@query("leafwise_three_leaves", f"WITH n1 AS ({_ONE_SPLIT}), chosen AS (SELECT * FROM ({split_sql(Given(_ONE_SPLIT, P.features), _LEAF_BINS, False)}) ORDER BY gain DESC, node_id LIMIT 1), n2 AS (SELECT n1.*, CASE WHEN n1.node_id = chosen.node_id THEN 2 + {side(P, 'chosen', '1', '2')} ELSE n1.node_id END AS leaf FROM n1, chosen), a AS (SELECT avg(label) AS m FROM n1), w AS (SELECT leaf, avg(label) AS v FROM n2 GROUP BY leaf) SELECT row_id, round(m + 0.1::DOUBLE * (v - m), 6) AS prediction FROM n2 JOIN w USING (leaf), a")
def leafwise_three_leaves(spark, sf):
    rows = P.read(spark, sf)
    config = leafwise.LeafwiseConfig(rounds=1, leaves=3, min_data=1, use_goss=False, finder=_LEAF_BINS, local=False)
    return rounded(leafwise.train(rows, list(P.features), "label", "row_id", config).score(rows).select("row_id", "prediction"))


@query("dart_train")
def dart_train(spark, sf):
    return _curve(spark, boosting.train(P.read(spark, sf), list(P.features), "label", "row_id", boosting.BoostingConfig(rounds=4, max_depth=2, dart=True, drop_rate=0.3, normalise="mild")))


@query("newton_train_curve")
def newton_train_curve(spark, sf):
    return _curve(spark, newton.train(P.read(spark, sf), list(P.features), "label", "row_id", newton.NewtonConfig(rounds=3, max_depth=3, subsample=0.8, colsample=0.5)))


@query("leafwise_train")
def leafwise_train(spark, sf):
    return _curve(spark, leafwise.train(P.read(spark, sf), list(P.features), "label", "row_id", leafwise.LeafwiseConfig(rounds=2, leaves=7, max_bin=32)))


# --- sampling ------------------------------------------------------------------------------------------------------

_GRAD = f"WITH b AS ({E.oracle}), g AS (SELECT row_id, label - 20 AS g FROM b), r AS (SELECT *, row_number() OVER (ORDER BY abs(g) DESC, row_id) AS rn, count(*) OVER () AS n FROM g)"


def _gradients(spark: SparkSession, sf: str) -> DataFrame:
    return E.read(spark, sf).select("row_id", (F.col("label") - 20).alias("g"))


@query("goss_top", f"{_GRAD} SELECT row_id, 1.0::DOUBLE AS w FROM r WHERE rn <= floor(n * 0.2)")
def goss_top(spark, sf):
    return sampling.goss(_gradients(spark, sf), "g", "row_id").where("w = 1").select("row_id", "w")


_GOSS = f"{_GRAD}, o AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql('42', 'row_id')}, row_id) AS k FROM r WHERE rn > floor(n * 0.2)), s AS (SELECT row_id, g, n, 1.0::DOUBLE AS w FROM r WHERE rn <= floor(n * 0.2) UNION ALL SELECT row_id, g, n, 0.8::DOUBLE / 0.1::DOUBLE AS w FROM o WHERE k <= floor((n - floor(n * 0.2)) * 0.1))"


@query("goss_rows", f"{_GOSS} SELECT row_id, round(w, 6) AS w FROM s")
def goss_rows(spark, sf):
    return rounded(sampling.goss(_gradients(spark, sf), "g", "row_id").select("row_id", "w"))


@query("goss_stats", f"{_GOSS} SELECT count(*) AS n_sampled, round(sum(w), 6) AS sum_w, round(max(abs(g)), 6) AS max_abs_g, round(min(abs(g)), 6) AS min_abs_g, round(count(*) / max(n)::DOUBLE, 6) AS ratio FROM s")
def goss_stats(spark, sf):
    rows = _gradients(spark, sf)
    return rounded(sampling.goss_stats(sampling.goss(rows, "g", "row_id"), "g", rows.count()))


@query("goss_adaptive_rates", f"{_GRAD}, c AS (SELECT stddev_pop(abs(g)) / (avg(abs(g)) + 1e-12) AS cv FROM g) SELECT round(cv, 6) AS cv, CASE WHEN cv > 2 THEN least(0.5, 1.5 * 0.2) WHEN cv < 0.5 THEN greatest(0.1, 0.8 * 0.2) ELSE 0.2 END::DOUBLE AS top_rate, CASE WHEN cv > 2 THEN greatest(0.05, 0.8 * 0.1) WHEN cv < 0.5 THEN least(0.3, 1.2 * 0.1) ELSE 0.1 END::DOUBLE AS other_rate FROM c")
def goss_adaptive_rates(spark, sf):
    cv = sampling.gradient_cv(_gradients(spark, sf), "g").first()["cv"]
    top, other = sampling.adaptive_rates(cv, 0.2, 0.1)
    return spark.createDataFrame([(round(cv, 6), top, other)], "cv double, top_rate double, other_rate double")


@query("bootstrap_counts", f"WITH b AS ({O.oracle}), n AS (SELECT count(*) AS n FROM b), d AS (SELECT CAST(id // n AS INTEGER) AS tree_id, CAST(floor({uniform_sql('42', 'id')} * n) + 1 AS BIGINT) AS rn FROM n, LATERAL (SELECT unnest(range(3 * n)) AS id)) SELECT tree_id, rn, count(*) AS w FROM d GROUP BY 1, 2")
def bootstrap_counts(spark, sf):
    return sampling.bootstrap(O.read(spark, sf), "row_id", 3)


@query("subsample_rows", f"WITH b AS ({E.oracle}), r AS (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql('42', 'row_id')}, row_id) AS rn, count(*) OVER () AS n FROM b) SELECT row_id FROM r WHERE rn <= floor(n * 0.3)")
def subsample_rows(spark, sf):
    return sampling.subsample(E.read(spark, sf), "row_id", 0.3).select("row_id")


@query("colsample", f"WITH k AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY {uniform_sql('42', 'k')}) AS rn FROM (SELECT unnest(range(3)) AS k)) WHERE rn <= 2) SELECT CAST(k AS INTEGER) AS feature, count(*) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM (SELECT k, CASE k WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END AS v FROM k, ({E.oracle})) GROUP BY k")
def colsample(spark, sf):
    """Rows and range of the features that are drawn."""
    drawn = sampling.columns_of(list(E.features), 0.67, 42)
    found = binning.bounds(E.read(spark, sf), [E.features[k] for k in drawn])
    names = F.array(*map(F.lit, drawn))
    return rounded(found.select(names[F.col("feature")].cast("int").alias("feature"), "n", "lo", "hi"))


# --- bundling ------------------------------------------------------------------------------------------------------

_TYPES = ("view", "error", "click", "purchase", "signup")
_HOT = ", ".join(f"CAST(event_type = '{t}' AS INTEGER) AS x{k}" for k, t in enumerate(_TYPES)) + ", CAST(user_id % 10 = 0 AS INTEGER) AS x5, 1 AS x6"


def _sparse(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("coppice_events_raw")
    return spark.sql(f"SELECT {_HOT} FROM coppice_events_raw"), [f"x{k}" for k in range(7)]


@query("efb_sparsity", f"WITH s AS (SELECT {_HOT} FROM events), " + "l AS (" + " UNION ALL ".join(f"SELECT {k} AS feature, x{k} AS v FROM s" for k in range(7)) + ") SELECT CAST(feature AS INTEGER) AS feature, count(*) AS n, count(*) FILTER (WHERE v = 0) AS zeros, round(count(*) FILTER (WHERE v = 0) / count(*)::DOUBLE, 6) AS sparsity FROM l GROUP BY feature")
def efb_sparsity(spark, sf):
    return rounded(bundling.sparsity(*_sparse(spark, sf)))


@query("efb_conflict_matrix", f"WITH s AS (SELECT {_HOT} FROM events), l AS (" + " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, x{a} <> 0 AND x{b} <> 0 AS both_, x{a} <> 0 OR x{b} <> 0 AS any_ FROM s" for a in range(7) for b in range(a + 1, 7)) + ") SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, count(*) FILTER (WHERE both_) AS \"both\", count(*) FILTER (WHERE any_) AS either, round(count(*) FILTER (WHERE both_) / count(*) FILTER (WHERE any_)::DOUBLE, 6) AS conflict FROM l GROUP BY a, b")
def efb_conflict_matrix(spark, sf):
    return rounded(bundling.conflicts(*_sparse(spark, sf)))


_SPARSE = "WITH RECURSIVE s AS (SELECT " + _HOT + " FROM events), sp AS (" + " UNION ALL ".join(f"SELECT {k} AS f, avg(CAST(x{k} = 0 AS INTEGER)) AS z FROM s" for k in range(7)) + "), cf AS (" + " UNION ALL ".join(f"SELECT {10 * a + b} AS k, count(*) FILTER (WHERE x{a} <> 0 AND x{b} <> 0) / greatest(count(*) FILTER (WHERE x{a} <> 0 OR x{b} <> 0), 1) AS v FROM s" for a in range(7) for b in range(a + 1, 7)) + ")"
_PLACE = "list_position(list_transform(gs, lambda x: list_aggregate(list_transform(x, lambda e: m[10 * least(e, f) + greatest(e, f)] <= 0.1::DOUBLE), 'bool_and')), true)"


@query("efb_bundles", f"""{_SPARSE}, ms AS (SELECT map_from_entries(list((k, v))) AS m FROM cf), o AS (SELECT f, z, row_number() OVER (ORDER BY z DESC, f) AS rn FROM sp),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[][]) AS gs UNION ALL SELECT i + 1, CASE WHEN z > 0.8 AND coalesce({_PLACE}, 0) > 0 THEN list_transform(gs, lambda x, i: CASE WHEN i = {_PLACE} THEN list_append(x, f) ELSE x END) ELSE list_append(gs, [f]) END FROM g, ms, o WHERE o.rn = i + 1),
u AS (SELECT CAST(unnest(range(len(gs))) AS INTEGER) AS bundle, unnest(gs) AS features FROM g WHERE i = 7)
SELECT bundle, features, CAST(list_transform(range(len(features)), lambda k: k * 255) AS INTEGER[]) AS offsets, CAST(len(features) * 255 AS INTEGER) AS total_bins FROM u""")
def efb_bundles(spark, sf):
    found = bundling.bundles(*_sparse(spark, sf), max_conflict=0.1)
    return spark.createDataFrame([(k, list(b.features), list(b.offsets), b.total_bins) for k, b in enumerate(found)], "bundle int, features array<int>, offsets array<int>, total_bins int")


@query("efb_transform", f"WITH s AS (SELECT {_HOT}, value FROM events) SELECT CASE " + " ".join(f"WHEN x{k} <> 0 THEN {8 * k} + CASE WHEN x{k} <= 0.25 THEN 0 WHEN x{k} <= 0.5 THEN 1 WHEN x{k} <= 0.75 THEN 2 ELSE 3 END" for k in range(5)) + " ELSE 0 END AS bundle, count(*) AS n FROM s GROUP BY 1")
def efb_transform(spark, sf):
    """The exclusive event types in one column of eight bins each."""
    rows, names = _sparse(spark, sf)
    edges = binning.equal_width(rows, names, 4)
    bundle = bundling.Bundle(tuple(range(5)), tuple(8 * k for k in range(5)), 40)
    value = bundling.transform(bundle, names, lambda f: binning.bin_of(F.col(names[f]).cast("double"), edges[f]))
    return rows.select(value.alias("bundle")).groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))


@query("hist_range_stats", f"{_HIST} SELECT CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(s1), 4) AS s1, round(sum(s2), 4) AS s2, round(sum(s1) / sum(cnt), 4) AS mean, round(sum(s2) / sum(cnt) - (sum(s1) / sum(cnt)) * (sum(s1) / sum(cnt)), 4) AS mse FROM h WHERE feature = 1 AND bin >= 3 AND bin < 9")
def hist_range_stats(spark, sf):
    rows = E.read(spark, sf)
    return rounded(binning.range_stats(binning.histogram(rows, list(E.features), binning.equal_width(rows, list(E.features), 16), "label"), 1, 3, 9), 4)


@query("hist_add_rows", f"{_HIST} SELECT CAST(feature AS INTEGER) AS feature, bin, cnt, round(s1, 4) AS s1, round(s2, 4) AS s2 FROM h")
def hist_add_rows(spark, sf):
    """The histogram of some rows with that of the others added is that of all."""
    rows = E.read(spark, sf)
    edges = binning.equal_width(rows, list(E.features), 16)
    low, high = (binning.histogram(rows.where(c), list(E.features), edges, "label") for c in ("f0 <= 50", "f0 > 50"))
    return rounded(binning.changed(low, high, 1).select("feature", "bin", "cnt", "s1", "s2"), 4)


@query("hist_report", f"{_HIST} SELECT CAST(feature AS INTEGER) AS feature, count(*) AS bins, CAST(sum(cnt) AS BIGINT) AS rows, count(*) * 40 AS bytes FROM h GROUP BY feature")
def hist_report(spark, sf):
    rows = E.read(spark, sf)
    return binning.report(binning.histogram(rows, list(E.features), binning.equal_width(rows, list(E.features), 16), "label"))


# --- ensembles -----------------------------------------------------------------------------------------------------

_BAG = bagging.BaggingConfig(trees=5, max_depth=5)


@query("bag_assignment", f"WITH d AS (SELECT CAST(id // n AS INTEGER) AS tree_id, CAST(floor({uniform_sql('42', 'id')} * n) + 1 AS BIGINT) AS rn FROM (SELECT count(*) AS n FROM ({O.oracle})), LATERAL (SELECT unnest(range(4 * n)) AS id)) SELECT CAST(CASE WHEN tree_id < 2 THEN 0 ELSE tree_id - 1 END AS INTEGER) AS worker, count(DISTINCT tree_id) AS trees, min(tree_id) AS first, count(*) AS draws, count(DISTINCT (tree_id, rn)) AS rows FROM d GROUP BY 1")
def bag_assignment(spark, sf):
    """Four trees dealt to three workers: which, how many draws they grow on, and how many different rows."""
    owner = spark.createDataFrame([(t, w) for w, (count, first) in enumerate(bagging.assignment(4, 3)) for t in range(first, first + count)], "tree_id int, worker int")
    drawn = sampling.bootstrap(O.read(spark, sf), "row_id", 4).groupBy("tree_id").agg(F.sum("w").alias("d"), F.count(F.lit(1)).alias("r"))
    return drawn.join(F.broadcast(owner), "tree_id").groupBy("worker").agg(F.count(F.lit(1)).alias("trees"), F.min("tree_id").alias("first"), F.sum("d").alias("draws"), F.sum("r").alias("rows"))


@query("bag_predict")
def bag_predict(spark, sf):
    rows = O.read(spark, sf)
    made, _ = bagging.train(rows, list(O.features), "label", "row_id", _BAG)
    return rounded(made.score(rows).select("row_id", "prediction"))


@query("bag_oob_error")
def bag_oob_error(spark, sf):
    made, ranked = bagging.train(O.read(spark, sf), list(O.features), "label", "row_id", _BAG)
    return rounded(bagging.oob_error(made, ranked, "row_id", "label", _BAG), 2)


@query("bag_importance")
def bag_importance(spark, sf):
    made, _ = bagging.train(O.read(spark, sf), list(O.features), "label", "row_id", _BAG)
    return rounded(made.importance(spark))


# Three bags of stumps: every draw is a row, and the bag its node.
_STUMPS = bagging.BaggingConfig(trees=3, max_depth=1, local=False)
_DRAWS = f"SELECT CAST(id // n AS INTEGER) AS tree_id, CAST(floor({uniform_sql('42', 'id')} * n) + 1 AS BIGINT) AS rn FROM (SELECT count(*) AS n FROM ({O.oracle})), LATERAL (SELECT unnest(range(3 * n)) AS id)"
_RANKED = f"SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM ({O.oracle})"
_BAGS = Given(f"SELECT b.row_id, b.f0, b.f1, b.f2, d.tree_id AS node_id, b.label FROM ({_DRAWS}) d JOIN ({_RANKED}) b USING (rn)", O.features)
_BAGGED = f"WITH splits AS ({split_sql(_BAGS, 'exhaustive', False)}), means AS (SELECT node_id, {side(O, 'splits', '1', '2')} AS leaf, avg(label) AS m FROM ({_BAGS.oracle}) JOIN splits USING (node_id) GROUP BY 1, 2), every AS (SELECT b.row_id, b.rn, b.label, splits.node_id, {side(O, 'splits', '1', '2')} AS leaf FROM ({_RANKED}) b, splits), scored AS (SELECT row_id, rn, label, node_id, m FROM every JOIN means USING (node_id, leaf))"


@query("bag_predict_stumps", f"{_BAGGED} SELECT row_id, round(sum(m) / 3, 4) AS prediction FROM scored GROUP BY row_id")
def bag_predict_stumps(spark, sf):
    rows = O.read(spark, sf)
    made, _ = bagging.train(rows, list(O.features), "label", "row_id", _STUMPS)
    return rounded(made.score(rows).select("row_id", "prediction"), 4)


@query("bag_oob_stumps", f"{_BAGGED}, free AS (SELECT s.* FROM scored s ANTI JOIN (SELECT tree_id AS node_id, rn FROM ({_DRAWS})) d USING (node_id, rn)), o AS (SELECT row_id, label, avg(m) AS p FROM free GROUP BY row_id, label) SELECT count(*) AS n, round(avg((label - p) * (label - p)), 0) AS mse, round(avg(abs(label - p)), 2) AS mae FROM o")
def bag_oob_stumps(spark, sf):
    made, ranked = bagging.train(O.read(spark, sf), list(O.features), "label", "row_id", _STUMPS)
    return rounded(bagging.oob_error(made, ranked, "row_id", "label", _STUMPS), 2, mse=0)


@query("bag_importance_stumps", f"WITH splits AS ({split_sql(_BAGS, 'exhaustive', False)}), f AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS feature) SELECT f.feature, round(count(splits.feature) / 3.0::DOUBLE, 6) AS importance FROM f LEFT JOIN splits USING (feature) GROUP BY f.feature")
def bag_importance_stumps(spark, sf):
    made, _ = bagging.train(O.read(spark, sf), list(O.features), "label", "row_id", _STUMPS)
    return rounded(made.importance(spark))


@query("bag_grouped_importance", f"WITH splits AS ({split_sql(_BAGS, 'exhaustive', False)}), f AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS feature), g AS (SELECT feature, CASE WHEN node_id < 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS s FROM splits) SELECT f.feature, round(coalesce(sum(s), 0) / 2, 6) AS importance FROM f LEFT JOIN g USING (feature) GROUP BY f.feature")
def bag_grouped_importance(spark, sf):
    """Two workers: the first has two of the three trees."""
    made, _ = bagging.train(O.read(spark, sf), list(O.features), "label", "row_id", _STUMPS)
    return rounded(bagging.grouped_importance(made, spark, 2))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

