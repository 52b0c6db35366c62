"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds a ratio of two counts of a text by whole percents, so that every engine
decides alike. ``verdict`` turns the table into one boolean expression; nothing is shuffled
and no user function runs.

Edge cases: a null or empty text has no words, fails the base rules and is not kept; other
nulls, repeated rows, ties and further columns have no influence; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm.textexpr import BLANKS, gram_hashes, let, shifted, white_words, whole, without

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Frequent function words of the languages that the corpus is written in.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "ist", "mit", "im", "auf", "eine", "des", "dem", "sich", "nicht",
    "de", "la", "le", "et", "les", "un", "une", "que", "en", "dans", "pour", "est", "par", "avec", "sur", "qui",
    "el", "los", "y", "se", "las", "por", "con", "su", "para", "al", "lo", "no", "una",
)


@dataclass(frozen=True)
class Rule:
    """low <= 100 * part / of <= high, for texts of at_least words or more."""

    name: str
    part: str
    of: str
    low: int | None = None
    high: int | None = None
    at_least: int = 0


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=150, high=2500),
    Rule("symbols", "n_symbols", "n_words", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=1, at_least=100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50, at_least=40),
)


def repeated_words(words: Column, width: int) -> Column:
    """How many words lie in runs of `width` words that the text has twice or more."""

    def spread(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = F.zip_with(s, shifted(s, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
            twice = let(same, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), F.slice(e, 1, F.size(e) - 1)), lambda a, b: a | b))
            return F.filter(F.zip_with(s, twice, lambda a, m: F.when(m, a["i"])), lambda i: i.isNotNull())

        def covered(at: Column) -> Column:
            step = F.zip_with(at, shifted(at, 1), lambda p, q: F.least(F.coalesce(q - p, F.lit(width)), F.lit(width)))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return let(F.sort_array(let(ordered, marked)), covered)

    counted = let(gram_hashes(words, width), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), spread(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > width, counted).otherwise(F.lit(0))


def features(text: Column) -> Column:
    """A struct of the counts that rules may name."""

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(without(text, BLANKS)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words, WINDOW).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(white_words(text), lambda w: let(lines, lambda n: of(w, n)))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT * f["n_words"])


def verdict(f: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the counts keep every rule of the table."""
    good = F.lit(True)
    for r in rules:
        part, of = 100 * f[r.part], f[r.of]
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (part >= r.low * of)
        if r.high is not None:
            inside = inside & (part <= r.high * of)
        good = good & (inside | (f["n_words"] < r.at_least))
    return good


def score_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with one more column `_quality`: the counts, base_failed and kept."""
    counted = docs.withColumn("_quality", features(whole(text)))
    f = F.col("_quality")
    bad = base_failed(f)
    return counted.withColumn("_quality", f.withField("base_failed", bad).withField("kept", ~bad & verdict(f, rules)))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    f = features(whole(text))
    return docs.filter(let(f, lambda x: ~base_failed(x) & verdict(x, rules)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines"]
    return score_quality(docs).select("doc_id", *[F.col("_quality")[n].alias(n) for n in names])


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    parts = []
    for r in rules:
        inside = [f"100 * {r.part} >= {r.low} * {r.of}"] * (r.low is not None) + [f"100 * {r.part} <= {r.high} * {r.of}"] * (r.high is not None)
        parts.append(f"(({' AND '.join(inside)}) OR n_words < {r.at_least})")
    return " AND ".join(parts)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS win FROM w, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS u(i) WHERE len(ws) >= {WINDOW}),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g),
r AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM
        (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM c WHERE n > 1) GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop_words,
             len(ls)::BIGINT AS n_lines FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules(RULES)} AS kept, n_stop_words, n_lines FROM b
"""
