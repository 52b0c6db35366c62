"""Line dedup by a log-template tree of fixed depth.

A line's form is its words with ``*`` for each one that holds a digit. The tree sends a form
by its number of words and its first ``LEADING`` words to a leaf. In a leaf, a word at some
place stays in the template if forms of at least ``MIN_DOCS`` documents have it there, and
becomes ``*`` otherwise; forms with one template share it. A template is recurring if its
forms stand in ``MIN_DOCS`` documents or more and at least half of its words are fixed; lines
with such a template are dropped. Support counts each document once, however many forms it has.

Lines are counted by hashes of leaf and form, within documents first; only forms of leaves
that hold several forms and enough documents are spelled out, once each.

Edge cases: a null or empty text has no lines and stays as it is (null as empty); lines
without a word are never dropped; repeated rows are documents of their own; null ids and
further columns have no influence; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm import scratch
from sonde.llm.textexpr import let, white_words, whole

LEADING, MIN_DOCS = 3, 5
#: From the start of a word to its end, if there is a digit in it; never looks at a character twice.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _general(line: Column) -> Column:
    return white_words(F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, "*")).otherwise(line))


def _tree(words: Column) -> Column:
    """Leaf and form of a line's general words, with their number and that of fields."""
    leaf = F.xxhash64(F.size(words), *[F.get(words, F.lit(k)) for k in range(LEADING)])
    return F.struct(leaf.alias("leaf"), F.xxhash64(words).alias("form"), F.size(words).alias("n"), (F.size(words) - F.size(F.array_remove(words, "*"))).alias("fields"))


def _fixed_enough(n: Column, fields: Column) -> Column:
    return 2 * fields <= n


def _in_documents(rows: DataFrame, keys: list[str], owners: DataFrame, min_docs: int) -> DataFrame:
    """The keys whose forms stand in min_docs distinct documents; rows has keys, leaf, form and docs."""
    sums = rows.groupBy(keys).agg(F.sum("docs").alias("all_docs"), F.max("docs").alias("most")).filter(F.col("all_docs") >= min_docs)
    # one form in enough documents decides; others have few owners each, which are told apart
    unsure = rows.join(sums.filter(F.col("most") < min_docs).select(keys), keys).join(owners, ["leaf", "form"]).select(*keys, "uid").distinct()
    return sums.filter(F.col("most") >= min_docs).select(keys).unionByName(unsure.groupBy(keys).count().filter(F.col("count") >= min_docs).select(keys))


def recurring(lines: DataFrame, texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, form) of lines to drop; lines has uid and the array `tree`, texts uid and text."""
    in_order = F.sort_array(F.transform("tree", lambda t: t.dropFields("no")))
    once = let(in_order, lambda s: F.filter(s, lambda t, i: (i == 0) | (t != F.get(s, i - 1))))  # a set of structs would compare all pairs
    each = lines.select("uid", F.explode(once).alias("t")).select("uid", "t.*")
    forms = each.groupBy("leaf", "form", "n", "fields").agg(F.count("*").alias("docs"), F.min("uid").alias("uid"))
    forms = scratch.save(forms, "forms")
    alone = forms.filter((F.col("docs") >= min_docs) & _fixed_enough(F.col("n"), F.col("fields"))).select("leaf", "form")
    # where forms meet in a leaf, words that few documents have become fields
    mixed = forms.groupBy("leaf").agg(F.sum("docs").alias("all_docs"), F.count("*").alias("all_forms")).filter((F.col("all_docs") >= min_docs) & (F.col("all_forms") > 1)).select("leaf")
    open_ = scratch.save(forms.filter(F.col("n") > LEADING).join(mixed, "leaf"), "open-forms")
    owners = scratch.save(each.select("uid", "leaf", "form").join(open_.filter(F.col("docs") < min_docs).select("leaf", "form"), ["leaf", "form"]), "owners")
    wanted = open_.groupBy("uid").agg(F.collect_list(F.struct("form", "leaf", "docs")).alias("wanted"))
    # texts lie by uid: what is sought goes to them, and words are spelled out and told apart there
    general = F.filter(F.transform(F.split("text", "\n"), _general), lambda w: F.size(w) > LEADING)
    named = F.transform(general, lambda w: F.struct(let(F.xxhash64(w), lambda h: F.get(F.filter("wanted", lambda t: t["form"] == h), F.lit(0))).alias("of"), w.alias("words")))
    spoken = texts.join(wanted, "uid").select("uid", F.explode(F.filter(named, lambda x: x["of"].isNotNull())).alias("x")).select("uid", "x.of", "x.words")
    spelled = spoken.groupBy("uid", "of.form", "of.leaf", "of.docs").agg(F.first("words").alias("words")).select("leaf", "form", "docs", "words")
    spelled = scratch.save(spelled, "spelled")
    words = spelled.select("leaf", "form", "docs", F.posexplode("words").alias("at", "word"))
    known = _in_documents(words, ["leaf", "at", "word"], owners, min_docs).withColumn("known", F.lit(True))
    kept = words.join(known, ["leaf", "at", "word"], "left").select("leaf", "form", "docs", "at", F.when(F.col("known"), F.col("word")).otherwise("*").alias("word"))
    templates = kept.groupBy("leaf", "form", "docs").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")).select("leaf", "form", "docs", F.transform("w", lambda x: x["word"]).alias("w"))
    named_templates = templates.select("leaf", "form", "docs", F.xxhash64("w").alias("template"), F.size("w").alias("n"), (F.size("w") - F.size(F.array_remove("w", "*"))).alias("fields")).filter(_fixed_enough(F.col("n"), F.col("fields")))
    common = _in_documents(named_templates, ["leaf", "template"], owners, min_docs)
    return alone.unionByName(named_templates.join(common, ["leaf", "template"]).select("leaf", "form")).distinct()


def without_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row; text has the lines that stay."""
    texts = scratch.by_uid(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), whole(text).alias("text")))
    tree = F.filter(F.transform(F.split("text", "\n"), lambda x, i: let(_general(x), lambda w: F.when(F.size(w) > 0, _tree(w).withField("no", i)))), lambda t: t.isNotNull())
    lines = scratch.save(texts.select("uid", tree.alias("tree")), "lines")
    drops = scratch.save(recurring(lines, texts, min_docs), "recurring")
    hit = lines.select("uid", F.explode("tree").alias("t")).select("uid", "t.leaf", "t.form", "t.no").join(drops, ["leaf", "form"]).groupBy("uid").agg(F.collect_list("no").alias("gone"))
    joined = texts.join(lines.select("uid", F.size("tree").cast("long").alias("n_lines")), "uid").join(hit, "uid", "left")

    def left(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), left))
    return joined.select("doc_id", kept.alias("text"), "n_lines", F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_templates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, i AS no, string_split(text, chr(10))[i] AS line FROM d, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(i)),
f AS (SELECT rid, no, line, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS w FROM l),
forms AS (SELECT w, len(w) AS n, list_slice(w, 1, {LEADING}) AS lead, row_number() OVER () AS form FROM f WHERE len(w) > 0 GROUP BY w),
words AS (SELECT form, n, lead, i AS at_, w[i] AS word FROM forms, unnest(generate_series(1, len(w))) AS u(i)),
owners AS (SELECT DISTINCT form, rid FROM f JOIN forms USING (w)),
known AS (SELECT n, lead, at_, word, count(DISTINCT rid) AS support FROM words JOIN owners USING (form) GROUP BY ALL),
t AS (SELECT form, n, lead, string_agg(CASE WHEN support >= {MIN_DOCS} THEN word ELSE '*' END, ' ' ORDER BY at_) AS template,
             count(*) FILTER (support < {MIN_DOCS} OR word = '*') AS fields FROM words JOIN known USING (n, lead, at_, word) GROUP BY form, n, lead),
often AS (SELECT n, lead, template FROM t JOIN owners USING (form) GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
r AS (SELECT form FROM t JOIN often USING (n, lead, template) WHERE 2 * fields <= n),
m AS (SELECT f.rid, f.no, f.line, len(f.w) > 0 AS real, r.form IS NOT NULL AS gone FROM f LEFT JOIN forms ON forms.w = f.w AND len(f.w) > 0 LEFT JOIN r ON r.form = forms.form)
SELECT d.doc_id, count(*) FILTER (real)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (rid) GROUP BY rid, doc_id
"""
