"""PII by information-theoretic sanitisation, in DataFrame functions only.

Base patterns find the protected entities of every whole text. All words of a text with entities are candidate terms; how
strongly a term reveals an entity is its pointwise mutual information with it, estimated from document counts over the
whole corpus. A term that carries at least DISCLOSURE of the information of an entity is removed as well, at every place
in the documents that hold both. No pair is too rare to count: a term in df of n documents is expected in (df + 1) / (n + 1) of others (rule of succession), so one
document is evidence that grows with the corpus.

Plan: one scan makes a table of spans (written to the shared folder, with the texts and words of documents that have
entities); a second scan counts in how many documents each of their words stands; words in too many documents to disclose
any entity are dropped, and the rest paired with entities. Small tables are broadcast while they have at most
BROADCAST_TERMS rows and joined by a shuffle beyond it.

Null texts are empty and have no spans. Positions are code points, ends are exclusive; spans of different kinds may
overlap, and one replacement then covers both. Repeated rows are rows of their own; rows without doc_id are kept. Extra
columns are not read (the sanitised table keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

# Kinds in order, and their patterns. Possessive forms and the look-behind (or the end of the match
# before, \G) change no match of the plain patterns; they only keep a long run of characters from being tried again
# from each of its places.
LOCAL, DIGIT = "[A-Za-z0-9._%+-]", "[0-9]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:(?<!{DIGIT})|\G){DIGIT}++\.{DIGIT}++\.{DIGIT}++\.{DIGIT}++",
    "card": rf"{DIGIT}(?:[\x20-]?{DIGIT})++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]+"
NOT_TERM = r"[^\p{L}\p{N}]+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: The part of an entity's information that a term may not give away.
DISCLOSURE = 0.9
BROADCAST_TERMS = 20_000
#: Sums run over blocks of so many, so that long lists cost no square of their length.
BLOCK = 256


def prefix_sums(xs: Column) -> Column:
    """Running sums of an array of integers."""

    def running(a: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            now = acc["sum"] + x
            return F.struct(now.alias("sum"), F.concat(acc["all"], F.array(now)).alias("all"))

        return F.aggregate(a, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")), add)["all"]

    starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
    inner = F.transform(starts, lambda b: running(F.slice(xs, b * BLOCK + 1, BLOCK)))
    outer = running(F.transform(inner, lambda a: F.element_at(a, -1)))
    return F.flatten(F.transform(inner, lambda a, i: F.transform(a, lambda x: x + F.when(i > 0, F.get(outer, i - 1)).otherwise(F.lit(0)))))


def located(text: Column, matches: Column, gaps: Column, kind: str) -> Column:
    """Spans of the matches; gaps: what split() leaves between them."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    ends = prefix_sums(steps)
    made = F.zip_with(ends, matches, lambda e, m: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    return F.when(F.size(matches) > 0, made).otherwise(F.array().cast(SPAN)).cast(SPAN)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _valid_match(kind: str):
    return lambda m: valid(kind, m)


def _valid_span(kind: str):
    return lambda s: valid(kind, s["value"])


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs with body (text, null as empty) and a column of spans for each kind; failing matches are dropped."""
    body = docs.withColumn("_body", F.coalesce("text", F.lit("")))
    found = {}
    for kind, pattern in PATTERNS.items():
        every = F.regexp_extract_all("_body", F.lit(pattern), F.lit(0))
        found[f"_m_{kind}"] = F.when(F.instr("_body", NEEDS[kind]) > 0, every).otherwise(F.array().cast("array<string>")) if NEEDS[kind] else every
    matched = body.withColumns(found)
    spans = {}
    for kind, pattern in PATTERNS.items():
        all_of = located(F.col("_body"), F.col(f"_m_{kind}"), F.split("_body", pattern, -1), kind)
        keep = all_of if kind == "email" else F.filter(all_of, _valid_span(kind))
        # Most documents have no match that could count; for them nothing is located.
        some = F.exists(F.col(f"_m_{kind}"), _valid_match(kind))
        spans[f"_s_{kind}"] = F.when(some, keep).otherwise(F.array().cast(SPAN))
    return matched.withColumns(spans).drop(*found)


def base_spans() -> Column:
    return F.concat(*(F.col(f"_s_{k}") for k in PATTERNS))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def words_of(text: Column) -> Column:
    """The distinct terms of a text, in small letters."""
    words = F.array_distinct(F.split(text, NOT_TERM))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w != ""))


def entity_of(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.lower(s["value"]))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def most_documents(of_entity: Column, both: Column, n_docs: int) -> Column:
    """Documents in which a term may stand at most and disclose an entity beside which it stands in both of of_entity."""
    shared = F.lit(DISCLOSURE) * F.log2(F.lit(float(n_docs)) / of_entity)
    return both / of_entity * (n_docs + 1) / F.pow(F.lit(2.0), shared) - 1 + 1e-9


def disclosing(docs: DataFrame, found: DataFrame, n_docs: int) -> DataFrame:
    """(_row, term), stored: terms of each document whose mutual information with one of its entities is at least DISCLOSURE of the entity's information."""
    entities = found.select("_row", F.explode(F.array_distinct(F.transform("_base", entity_of))).alias("entity"))
    # Entities of the same documents have the same counts with any term and are one class, so that a long list of
    # entities costs no pairs of its own.
    at = F.xxhash64("_row")
    by_entity = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"), F.bit_xor(at).alias("xor"), F.sum(at.cast("decimal(20,0)")).alias("sum"))
    known = materialise(by_entity.where(F.col("of_entity") < n_docs).select("entity", "of_entity", F.struct("of_entity", "xor", "sum").alias("class")))
    most = known.agg(F.max("of_entity")).first()[0]
    if most is None:
        return found.select("_row", F.lit("").alias("term")).limit(0)
    classes = entities.join(small(known), "entity").select("_row", "class").distinct()
    near = found.select(F.explode("_words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("near"))
    # No term in more documents than this discloses any entity; the limit grows with of_entity.
    rare = near.where(F.col("near") <= most_documents(F.lit(most), F.lit(most), n_docs)).select("term")
    # Counted where they stand before they are dealt out.
    counts = docs.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = materialise(counts.where(F.col("df") <= most_documents(F.lit(most), F.lit(most), n_docs)).join(rare, "term"))
    held = materialise(found.select("_row", F.explode("_words").alias("term")).join(small(terms), "term").select("_row", "term", "df"))
    # Pairs of a class and a term in more documents than the class allows are left out where they stand.
    limit = F.col("df") <= most_documents(F.col("class.of_entity"), F.col("class.of_entity"), n_docs)
    pairs = materialise(held.join(classes, "_row").where(limit).select("_row", "class", "term", "df"))
    rated = pairs.groupBy("class", "term", "df").agg(F.count(F.lit(1)).alias("both"))
    kept = materialise(rated.where(F.col("df") <= most_documents(F.col("class.of_entity"), F.col("both"), n_docs)).select("class", "term"))
    out = materialise(pairs.join(small(kept), ["class", "term"]).select("_row", "term").distinct())
    discard(known, terms, held, pairs, kept)
    return out


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, _base (base spans) and _spans (all spans, base ones first) of every row."""
    scanned = with_base_spans(docs.select(*dict.fromkeys([*keep, "text"])))
    kept = scanned.select(*keep, "_body", base_spans().alias("_base"))
    some = F.size("_base") > 0
    found = materialise(kept.select(*keep, "_base", F.when(some, F.col("_body")).alias("_body"), F.when(some, words_of(F.col("_body"))).alias("_words"), F.monotonically_increasing_id().alias("_row")))
    holding = found.where(some)
    terms = disclosing(docs, holding.select("_row", "_base", "_words"), found.count())
    texts = holding.join(terms.select("_row").distinct(), "_row")
    split = texts.select("_row", F.regexp_extract_all("_body", F.lit(TERM), F.lit(0)).alias("_m"), F.split("_body", TERM, -1).alias("_g"))
    steps = split.select("_row", F.posexplode(F.zip_with(F.slice("_g", 1, F.size("_m")), "_m", lambda g, m: F.struct((F.length(g) + F.length(m)).alias("step"), m.alias("value")))).alias("at", "word"))
    # A window over the words of one document.
    end = F.sum("word.step").over(Window.partitionBy("_row").orderBy("at")).cast("int")
    words = steps.select("_row", F.lower("word.value").alias("term"), (end - F.length("word.value")).alias("start"), end.alias("end"))
    at = words.join(terms, ["_row", "term"]).join(holding.select("_row", "_base"), "_row")
    added = at.where(~F.exists("_base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    # At most the words of the document.
    by_row = added.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("end")))).alias("_added"))
    extra = F.transform(F.coalesce("_added", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("value")))
    return found.select(*keep, "_base", "_row").join(by_row, "_row", "left").select(*keep, "_base", F.concat("_base", extra.cast(SPAN)).alias("_spans"))


def redacted(body: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))
    kind = "struct<out:array<struct<start:int,end:int,kind:string>>,last:struct<start:int,end:int,kind:string>>"

    def merge(acc: Column, s: Column) -> Column:
        last = acc["last"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = last.isNull() | (s["start"] >= last["end"])
        return F.struct(F.when(apart & last.isNotNull(), F.concat(acc["out"], F.array(last))).otherwise(acc["out"]).alias("out"), F.when(apart, s).otherwise(joined).alias("last")).cast(kind)

    empty = F.struct(F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"), F.lit(None).cast("struct<start:int,end:int,kind:string>").alias("last")).cast(kind)
    apart = F.aggregate(by_start, empty, merge, lambda acc: F.concat(acc["out"], F.array(acc["last"])))
    ends = F.concat(F.array(F.lit(0)), F.transform(apart, lambda s: s["end"]))
    parts = F.transform(apart, lambda s, i: F.concat(F.substring(body, F.get(ends, i) + 1, s["start"] - F.get(ends, i)), F.lit("["), s["kind"], F.lit("]")))
    tail = F.substring(body, F.element_at(ends, -1) + 1, F.length(body))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(body)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the text of every row redacted; other columns as they were. Null texts stay null."""
    found = find_pii(docs.select(F.struct("*").alias("_all"), "text"), ("_all",))
    body = F.col("_all").getField("text")
    text = F.when(body.isNotNull(), redacted(body, F.col("_spans")))
    return found.select(*(text.alias(c) if c == "text" else F.col("_all").getField(c).alias(c) for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("_base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(span_string(F.col("_base")), 256).alias("base_sha256"), span_string(F.col("_spans")).alias("spans"))
