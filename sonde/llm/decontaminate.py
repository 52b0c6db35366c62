"""Benchmark decontamination by winnowing.

Of the hashes of all runs of ``GRAM`` words, every ``WINDOW - GRAM + 1`` neighbours leave
their minimum. Two texts that share ``WINDOW`` consecutive words therefore share a kept hash
at the same place of the shared words. Kept hashes of documents are joined with those of the
items; around each meeting the words are compared outwards, and a run of ``WINDOW`` equal
words or more is hit. Items of fewer words are matched as one run of their own length.

The hashes of a benchmark of at most ``LITERALS`` hashes are looked up while a document is
read, so that only documents with a meeting go further. A larger benchmark is joined with the
exploded hashes of the documents; results are the same.

Edge cases: a null or empty text has no words; null item ids count as one item without a name;
repeated document rows keep a row each, repeated items count once; further columns have no
influence; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm import scratch
from sonde.llm.textexpr import gram_hashes, let, lower_ascii, plain_words, sliding, whole

WINDOW, GRAM = 10, 5
LITERALS = 20_000
_AROUND = WINDOW - GRAM


def winnowed(words: Column) -> Column:
    """Kept hashes with their places: an array of (kind 0, hash, at); at counts from 0."""
    width = WINDOW - GRAM + 1
    lowest = F.lit(-(1 << 63))

    def kept(h: Column) -> Column:
        return F.filter(F.zip_with(F.transform(h, lambda x, i: F.struct(F.lit(0).alias("kind"), x.alias("hash"), i.alias("at"))), most(h), lambda s, m: F.when(s["hash"] == m, s)), lambda s: s.isNotNull())

    def most(h: Column) -> Column:
        pad = F.array_repeat(lowest, width - 1)
        return sliding(F.concat(pad, sliding(h, width, lambda a, b: F.least(a, b)), pad), width, lambda a, b: F.greatest(a, b))

    return F.when(F.size(words) >= WINDOW, let(gram_hashes(words, GRAM), kept)).otherwise(F.array().cast("array<struct<kind:int,hash:bigint,at:int>>"))


def runs(words: Column, length: int) -> Column:
    """All runs of `length` words, as (kind, hash, at) with the length as kind."""
    hashes = F.transform(gram_hashes(words, length), lambda x, i: F.struct(F.lit(length).alias("kind"), x.alias("hash"), i.alias("at")))
    return F.when(F.size(words) >= length, hashes).otherwise(F.array().cast("array<struct<kind:int,hash:bigint,at:int>>"))


def around(words: Column, mark: Column) -> Column:
    """The words that a meeting at `mark` is compared over; null beyond the text's ends."""
    near = F.transform(F.sequence(F.lit(-_AROUND), F.lit(WINDOW - 1)), lambda k: F.when(mark["at"] + k >= 0, F.get(words, F.greatest(mark["at"] + k, F.lit(0)))))
    return F.when(mark["kind"] == 0, near).otherwise(F.slice(words, mark["at"] + 1, F.greatest(mark["kind"], F.lit(1))))


def _met(words: Column, marks: Column) -> Column:
    return F.transform(marks, lambda m: F.struct(m["kind"].alias("kind"), m["hash"].alias("hash"), m["at"].alias("at"), around(words, m).alias("near")))


def item_marks(items: DataFrame) -> DataFrame:
    """(item_id, kind, hash, item_near) of all kept hashes of items (columns item_id, text)."""
    words = items.select("item_id", plain_words(lower_ascii(whole("text"))).alias("w"))
    short = F.array().cast("array<struct<kind:int,hash:bigint,at:int>>")
    for m in range(1, WINDOW):
        short = F.when(F.size("w") == m, runs(F.col("w"), m)).otherwise(short)
    marks = F.when(F.size("w") >= WINDOW, winnowed(F.col("w"))).otherwise(short)
    return words.select("item_id", F.explode(_met(F.col("w"), marks)).alias("m")).select("item_id", "m.kind", "m.hash", F.col("m.near").alias("item_near")).distinct()


def _marked(docs: DataFrame, lengths: list[int], wanted: list[int] | None) -> DataFrame:
    """docs (uid, text) as (uid, n_words, marks), or only those marks that `wanted` holds with their words."""
    # runs of a few words are looked up for the lengths that short items have
    words = plain_words(lower_ascii(whole("text")))

    def of(w: Column) -> Column:
        marks = F.concat(winnowed(w), *[runs(w, m) for m in lengths])
        if wanted is not None:
            marks = _met(w, F.filter(marks, lambda m: m["hash"].isin(wanted)) if wanted else F.filter(marks, lambda m: F.lit(False)))
        return F.struct(F.size(w).cast("long").alias("n_words"), marks.alias("marks"))

    return docs.withColumn("x", let(words, of)).select(*[c for c in docs.columns if c != "text"], "x.n_words", "x.marks")


def _ranges() -> Column:
    """The hit words of a meeting as (start, stop), or null."""
    eq = F.zip_with("near", "item_near", lambda a, b: F.coalesce(a == b, F.lit(False)))

    def of(e: Column) -> Column:
        left, right = F.lit(0), F.lit(0)
        for k in range(_AROUND, 0, -1):  # the longest stretch of equal words next to the gram
            left = F.when(F.forall(F.slice(e, _AROUND - k + 1, k), lambda x: x), F.greatest(left, F.lit(k))).otherwise(left)
            right = F.when(F.forall(F.slice(e, WINDOW + 1, k), lambda x: x), F.greatest(right, F.lit(k))).otherwise(right)
        gram = F.forall(F.slice(e, _AROUND + 1, GRAM), lambda x: x)
        long = F.when(gram & (left + right + GRAM >= WINDOW), F.struct((F.col("at") - left).alias("start"), (F.col("at") + GRAM + right).alias("stop")))
        short = F.when(F.forall(e, lambda x: x), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("kind")).alias("stop")))
        return F.when(F.col("kind") == 0, long).otherwise(short)

    return let(eq, of)


def contamination(docs: DataFrame, items: DataFrame, literals: int = LITERALS) -> DataFrame:
    """docs (uid, doc_id, text) as (uid, doc_id, n_words, n_hit, item_ids); uid tells rows apart.

    item_ids: the items, of which a null stands for all without an id.
    """
    marks = scratch.save(item_marks(items), "item-marks")
    kinds = [r[0] for r in marks.select("kind").distinct().collect()]  # at most WINDOW numbers
    lengths = sorted(k for k in kinds if k)
    hashes = marks.select("hash").distinct().limit(literals + 1).collect()  # a size check; within it, this is all
    if len(hashes) <= literals:
        slim = scratch.save(_marked(docs, lengths, [r[0] for r in hashes]), "marked")
    else:
        base = scratch.save(docs, "texts")
        every = base.transform(_marked, lengths, None).select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
        met = every.join(marks.select("kind", "hash").distinct(), ["kind", "hash"]).groupBy("uid").agg(F.collect_list(F.struct("kind", "hash", "at")).alias("marks"))
        words = let(plain_words(lower_ascii(whole("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _met(w, F.coalesce("marks", F.array().cast("array<struct<kind:int,hash:bigint,at:int>>"))).alias("marks")))
        slim = scratch.save(base.join(met, "uid", "left").withColumn("x", words).select("uid", "doc_id", "x.n_words", "x.marks"), "marked")
    near = slim.filter(F.size("marks") > 0).select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
    hit = near.join(marks, ["kind", "hash"]).withColumn("r", _ranges()).filter("r IS NOT NULL")
    by_doc = hit.groupBy("uid").agg(F.collect_set("r").alias("r"), F.collect_set(F.struct("item_id")).alias("items"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("r", lambda r: F.sequence(r["start"], r["stop"] - 1)))))
    sums = by_doc.select("uid", n_hit.cast("long").alias("n_hit"), F.transform("items", lambda s: s["item_id"]).alias("item_ids"))
    return slim.drop("marks").join(sums, "uid", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", literals: int = LITERALS) -> DataFrame:
    """The rows of docs without any hit word, with their own columns."""
    rows = scratch.by_uid(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    found = contamination(rows.select("uid", F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{text}`").alias("text")), items, literals)
    return rows.join(found.filter("n_hit > 0").select("uid"), "uid", "left_anti").select("row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(_numbered(docs, "doc_id", "text"), items)
    named = F.array_join(F.sort_array(F.transform(F.filter(F.coalesce("item_ids", F.array().cast("array<bigint>")), lambda i: i.isNotNull()), lambda i: i.cast("string"))), ",")
    n_items = F.coalesce(F.size("item_ids"), F.lit(0))
    return found.select("doc_id", "n_words", "n_hit", F.greatest(n_items, F.lit(0)).cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(list_slice(w, i, i + least({WINDOW}, len(w)) - 1), ' ') AS g
       FROM b, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
h AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""
