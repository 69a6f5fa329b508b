"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .store import stored

#: df computed once: range bounds are sampled anew at each run, so counts and rows must come from the same one.
kept = stored


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """df with a row number from 1 in the given total order: ranges are sorted each in its task, their counts give the offsets."""
    ranged = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()  # a row a partition
    offsets, total = {}, 0
    for r in counts:
        offsets[r["_part"]] = total
        total += r["_n"]
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("bigint")
    if not offsets:
        return ranged.withColumn(name, local).drop("_part")
    known = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair))
    return ranged.withColumn(name, local + known[F.col("_part")].cast("bigint")).drop("_part")


def ntile_of(rn: Column, n: int, k: int) -> Column:
    """Bucket from 1 to k of a row number among n: the first n mod k buckets have one row more."""
    size, more = n // k, n % k
    cut = more * (size + 1)
    return F.when(rn <= cut, F.floor((rn - 1) / (size + 1)) + 1).otherwise(more + F.floor((rn - 1 - cut) / max(size, 1)) + 1).cast("int")


def running(df: DataFrame, groups: list[str], order: str, sums: list[str], following: str | None = None) -> DataFrame:
    """df with c_x (running sum, in order, nulls last) and t_x (total) of each of sums in its group, and nxt (the next value of following).

    One group may be as large as the table: ranges of (groups, order) are summed each in its task, and a small table of a
    row a range and group has the offsets. (groups, order) must be unique. Rows are sorted once, where they are dealt out by
    range, and pass by in batches: no window holds a range of a group.
    """
    by = [*(F.col(c) for c in groups), F.asc_nulls_last(order)]
    ranged = kept(summed_in_order(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*by), groups, sums, following))
    first = [F.min(following).alias("_first")] if following else []
    parts = ranged.groupBy("_part", *groups).agg(*(F.sum(x).alias(f"_p_{x}") for x in sums), *first)
    w = Window.partitionBy(*groups).orderBy("_part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    made = {f"_o_{x}": F.sum(f"_p_{x}").over(before) for x in sums} | {f"t_{x}": F.sum(f"_p_{x}").over(Window.partitionBy(*groups)) for x in sums}
    offsets = parts.withColumns(made | ({"_after": F.lead("_first").over(w)} if following else {}))
    # The hint keeps Spark from sending ranged, rows as many as the table's, through the driver to every executor.
    joined = ranged.join(offsets.drop(*(f"_p_{x}" for x in sums), "_first").hint("shuffle_hash"), ["_part", *groups])
    out = {f"c_{x}": F.coalesce(F.col(f"_o_{x}") + F.col(f"c_{x}"), f"_o_{x}", f"c_{x}") for x in sums} | ({"nxt": F.coalesce("nxt", "_after")} if following else {})
    return joined.withColumns(out).drop("_part", "_after", *(f"_o_{x}" for x in sums))


def summed_in_order(df: DataFrame, groups: list[str], sums: list[str], following: str | None) -> DataFrame:
    """df, sorted by groups in each partition, with c_x, the running sums of a group in its partition (whole numbers as bigint, others as double), and nxt, the next value of following there."""
    whole = {x: df.schema[x].dataType.typeName() in ("byte", "short", "integer", "long") for x in sums}
    more = [StructField(f"c_{x}", LongType() if whole[x] else DoubleType()) for x in sums] + ([StructField("nxt", df.schema[following].dataType)] if following else [])

    def differ(a: list[pa.Array], b: list[pa.Array]) -> np.ndarray:
        out = np.zeros(len(a[0]) if a else 0, bool)
        for x, y in zip(a, b, strict=True):
            unlike = pc.fill_null(pc.not_equal(x, y), False)
            if pa.types.is_floating(x.type):
                unlike = pc.and_not(unlike, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
            out |= pc.or_(unlike, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = {x: (0, False) for x in sums}  # sum of the group so far, and whether it has any value
        waits = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(g) for g in groups]
            ends = np.flatnonzero(differ([k[:-1] for k in keys], [k[1:] for k in keys]))
            goes_on = waits is not None and not differ([waits.column(g)[-1:] for g in groups], [k[:1] for k in keys]).any()
            if waits is not None:
                yield finished(*held, b.column(following)[:1] if following and goes_on else None)
            starts, stops = [0, *(ends + 1).tolist()], [*(ends + 1).tolist(), b.num_rows]
            made = []
            for x in sums:
                kind = pa.int64() if whole[x] else pa.float64()
                given = b.column(x).cast(kind)
                v = np.array(pc.fill_null(given, 0).to_numpy(zero_copy_only=False))
                known = ~given.is_null().to_numpy(zero_copy_only=False)
                total, some = carry[x] if goes_on else (0, False)
                v[0] = total + v[0]
                none = np.zeros(len(v), bool)
                for a, z in zip(starts, stops, strict=True):
                    np.cumsum(v[a:z], out=v[a:z])
                if given.null_count:
                    for a, z in zip(starts, stops, strict=True):
                        none[a:z] = ~np.logical_or.accumulate(known[a:z])
                    if some:
                        none[: stops[0]] = False
                carry[x] = (v[-1], not none[-1])
                made.append(pa.array(v, kind, mask=none))
            waits, held = b, (b, made, ends)
        if waits is not None:
            yield finished(*held, None)

    def finished(b: pa.RecordBatch, made: list[pa.Array], ends: np.ndarray, after: pa.Array | None) -> pa.RecordBatch:
        if following:
            x = b.column(following)
            last = np.zeros(b.num_rows, bool)
            last[ends] = True
            nxt = pa.concat_arrays([x[1:], pa.nulls(1, x.type) if after is None else after])
            made = [*made, pc.if_else(pa.array(last), pa.scalar(None, x.type), nxt)]
        return pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *(f.name for f in more)])

    return df.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in df.schema] + more))
