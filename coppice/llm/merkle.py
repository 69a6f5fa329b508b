"""Merkle manifest of a dataset: one digest that vouches for every row, and a proof for each.

Rows of a group (a source), in order, are the leaves of a tree of FANOUT children a node; the groups' roots, in order of
the groups, are the leaves of a tree above them. Levels are built bottom-up, each by one grouping of the level below, and
written to the shared folder: they are the manifest. Proofs are pushed top-down: the nodes of a level join their parents,
and each prepends its siblings to the suffix it inherits. Positions come from ranges sorted each in its task plus the
ranges' offsets, so that a group may be as large as the table, and a join brings at most FANOUT rows to a parent.

H is the lowercase hex SHA-256. A field is `-` if null, else its UTF-8 byte count, `:` and its value; digests enter as hex
text, and are held as 32 bytes. Null groups are a group of their own, before all others; in a group rows without order
column come first, equal ones by digest, so repeated rows are leaves of their own and the digests do not depend on the
order of the input. Empty and very long texts are values like others. Extra columns are not read. An empty table has no
root and no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id() below those of the partition.
ROW_BITS = 33
PROOF = "array<struct<before:array<binary>,after:array<binary>>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the strings joined, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def in_hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, as_hex), "")


def row_digest(**fields: Column) -> Column:
    """H of the fields in the order given."""
    held = [c.cast("string") for c in fields.values()]
    return digest(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in held))


def positioned(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (a stored table, with tree) with pos, from 0 in the order given, and n, the rows of their tree."""
    # The last key parts equal rows, which may be many; they are alike, so which of them comes first does not matter.
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_salt").sortWithinPartitions("tree", *order, "_salt")
    placed = materialise(ranged.drop("_salt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", ROW_BITS)))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    numbered = placed.join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    out = materialise(numbered.drop("_at", "_part", "_first", "_before"))
    discard(placed)
    return out


def levels_above(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """leaves (tree, pos, n, digest) and the stored levels above them, with kids, the digests of a node's children."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos"), F.ceil(F.col("n") / fanout).alias("n"))
        kids = runs.agg(F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("kids"))
        levels.append(materialise(kids.withColumn("digest", digest(in_hex(F.col("kids"))))))
        most = math.ceil(most / fanout)
    return levels


def pushed(levels: list[DataFrame], inherited: DataFrame, fanout: int) -> DataFrame:
    """levels[0] with proof, and what else inherited (tree, proof, ...) has: roots take it by tree, other nodes from their parents. A job a level."""
    more = [c for c in inherited.columns if c not in ("tree", "proof")]
    above = None
    for k, rows in reversed([*enumerate(levels)]):
        own = rows.columns
        out = rows.where("n = 1").join(inherited, "tree").select(*own, "proof", *more)
        if above is not None:
            up = above.select(F.col("tree"), F.col("pos").alias("_up"), F.col("kids").alias("_kids"), F.col("proof").alias("_suffix"), *more)
            inner = rows.where("n > 1").withColumn("_up", F.floor(F.col("pos") / fanout)).join(up, ["tree", "_up"])
            at = (F.col("pos") % fanout).cast("int")
            siblings = F.struct(F.slice("_kids", F.lit(1), at).alias("before"), F.slice("_kids", at + 2, F.lit(fanout)).alias("after"))
            out = out.unionByName(inner.select(*own, F.concat(F.array(siblings), "_suffix").alias("proof"), *more))
        below, above = above, materialise(out) if k else out
        if below is not None and k:
            discard(below)
    return above


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, pos, n, digest and the carried columns; levels: the stored levels of the groups' trees; upper: those above them."""

    levels: list[DataFrame]
    upper: list[DataFrame]
    fanout: int
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves with proof (siblings from the leaf's run up to the root's) and subroot."""
        spark = self.levels[0].sparkSession
        top = spark.createDataFrame([("", [])], f"tree string, proof {PROOF}")
        of_groups = pushed(self.upper, top, self.fanout).select(F.col("group").alias("tree"), "proof", F.col("digest").alias("subroot"))
        return pushed(self.levels, of_groups, self.fanout)


def manifest(rows: DataFrame, group: Column, order: list[str], fanout: int = FANOUT) -> Manifest:
    """rows: digest (32 bytes), the columns of order, and any others that leaves shall carry. Read once."""
    tree = F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group.cast("string")))  # "-" sorts before "="
    stored = materialise(rows.withColumn("tree", tree))
    leaves = positioned(stored, [*(F.asc_nulls_first(c) for c in order), F.asc("digest")])
    discard(stored)
    levels = levels_above(leaves, fanout)
    roots = materialise(reduce(DataFrame.unionByName, (x.where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest") for x in levels)))
    upper = levels_above(positioned(roots, [F.asc("group")]), fanout)
    discard(roots)
    top = upper[-1].where("n = 1").select(as_hex(F.col("digest"))).first()
    return Manifest(levels, upper, fanout, top[0] if top else None)


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(in_hex(p["before"]), in_hex(p["after"]))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) that a leaf's digest and the siblings of its proof lead to."""
    return F.aggregate(proof, as_hex(leaf), lambda done, p: F.sha2(F.concat(in_hex(p["before"]), done, in_hex(p["after"])), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(docs.select("doc_id", "source", row_digest(**fields).alias("digest"), row_digest(**fields | {"text": tampered}).alias("tampered")), F.col("source"), ["doc_id"])
    out = found.proofs().withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    root = F.lit(found.root).cast("string")
    return out.select("doc_id", as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: ((ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) >> (k % 8)::INT) & 1)::BIGINT)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) & 1 AS odd
  FROM documents
), f AS (
  SELECT doc_id, source, text, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS other,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d
), h AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM f
), leaves AS (
  SELECT *, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h
), low AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 3, n
), subroots AS (
  SELECT tree, level AS depth, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3, n
), nodes AS (
  SELECT tree, level, pos, digest FROM low WHERE n > 1
  UNION ALL
  SELECT s.tree, s.depth + u.level, u.pos, u.digest FROM subroots s, high u WHERE u.n > 1
), starts AS (
  SELECT l.doc_id, l.leaf, l.tampered, l.tree, s.digest AS subroot, row_number() OVER () AS r, l.pos, s.pos AS spos, s.depth, s.depth + (SELECT max(level) FROM high) AS top
  FROM leaves l JOIN subroots s USING (tree)
), walk AS (
  SELECT r, tree, 0 AS level, CASE WHEN depth = 0 THEN spos ELSE pos END AS pos, spos, depth, top, tampered AS acc, '' AS proof FROM starts
  UNION ALL
  SELECT w.r, w.tree, w.level + 1, CASE WHEN w.level + 1 = w.depth THEN w.spos ELSE w.pos // 3 END, w.spos, w.depth, w.top,
    sha256(string_agg(CASE WHEN x.pos = w.pos THEN w.acc ELSE x.digest END, '' ORDER BY x.pos)), w.proof || coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos <> w.pos), '')
  FROM walk w JOIN nodes x ON x.tree = w.tree AND x.level = w.level AND x.pos // 3 = w.pos // 3
  WHERE w.level < w.top GROUP BY w.r, w.tree, w.level, w.pos, w.spos, w.depth, w.top, w.acc, w.proof
), root AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT s.doc_id, s.leaf, s.subroot, root.root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = root.root AS verified
FROM starts s JOIN walk w ON w.r = s.r AND w.level = s.top, root
"""
