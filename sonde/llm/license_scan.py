"""License scans by a positional index of rare words.

The words of licence templates (function words apart) are counted over all documents. Of each
template's mandatory key phrase the rarest word is looked up: each place of it in a file gives
an alignment, which counts if the key phrase stands in full at its place. As no alignment
counts without its key phrase, none is missed, however many licences a file holds. The score
is the share of the template's words that stand at theirs, and from ``SHARE`` on it gives the
template's label. Fixed phrases give labels by themselves.

Edge cases: a null or empty text has no words, labels or score; ties in rarity go by word;
repeated rows and further columns have no influence beyond the counts; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm.textexpr import let, lower_ascii, plain_words, whole

SHARE = 0.7
#: Phrases that give a label wherever their words stand in a row.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening or notice words of public licences with a phrase that must be there.
TEMPLATES = (
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "software and accompanying documentation covered by this license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions of the software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)
#: Function words, which no lookup starts from.
COMMON = frozenset("a an and any are as at be by can for from in is it may met not of on or that the this to under use with without you".split())


def _key(text: str, phrase: str) -> tuple[int, int]:
    words, key = text.split(), phrase.split()
    return next(k for k in range(len(words)) if words[k : k + len(key)] == key), len(key)


def _vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - COMMON)


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rarity(docs: DataFrame, text: str = "text") -> list[str]:
    """The licence words by the number of documents that hold them, rarest first.

    At most as many rows as the templates have words come to the driver.
    """
    found = docs.select(F.explode(F.array_intersect(_array(_vocabulary()), plain_words(lower_ascii(whole(text))))).alias("w"))
    counts = dict(found.groupBy("w").count().collect())
    return sorted(_vocabulary(), key=lambda w: (counts.get(w, 0), w))


def places(words: Column) -> Column:
    """Places of the fixed phrases: an array of (at, label)."""

    def here(label: str, parts: list[str]) -> Column:
        whole_phrase = lambda i: F.forall(F.transform(_array(parts), lambda p, k: F.coalesce(F.get(words, i + k) == p, F.lit(False))), lambda x: x)
        starts = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
        return F.transform(F.filter(starts, whole_phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.concat(*[here(label, phrase.split()) for phrase, label in PHRASES])


def aligned(words: Column, order: list[str]) -> Column:
    """Verified alignments: an array of (label, share)."""
    templates = F.array(*[F.struct(F.lit(label).alias("label"), _array(text.split()).alias("words"), F.lit(_key(text, phrase)[0]).alias("key"), F.lit(_key(text, phrase)[1]).alias("length")) for label, text, phrase in TEMPLATES])
    rank = {w: k for k, w in enumerate(order)}
    anchors = []
    for t, (_, text, phrase) in enumerate(TEMPLATES):
        first, length = _key(text, phrase)
        anchors.append(min((rank[w], w, t, p) for p, w in enumerate(text.split()) if first <= p < first + length and w in rank)[1:])
    postings = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(p).alias("p")) for w, t, p in anchors])
    looked_up = _array(sorted({w for w, _, _ in anchors}))

    def candidates() -> Column:
        marks = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda m: F.array_contains(looked_up, m["w"]))
        return F.flatten(F.transform(marks, lambda m: F.transform(F.filter(postings, lambda p: p["w"] == m["w"]), lambda p: F.struct(p["t"].alias("t"), (m["i"] - p["p"]).alias("at")))))

    def verified(a: Column, t: Column) -> Column:
        stands = F.transform(t["words"], lambda w, k: F.coalesce(F.get(words, a["at"] + k) == w, F.lit(False)))
        share = lambda s: F.size(F.filter(s, lambda x: x)) / F.size(s)
        return let(stands, lambda s: F.when(F.forall(F.slice(s, t["key"] + 1, t["length"]), lambda x: x), F.struct(t["label"].alias("label"), share(s).alias("share"))))

    return F.filter(F.transform(candidates(), lambda a: let(F.element_at(templates, a["t"] + 1), lambda t: verified(a, t))), lambda x: x.isNotNull())


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    order = rarity(docs, text)

    def of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), places(words).alias("base"), aligned(words, order).alias("found"))

    others = [c for c in docs.columns if c != text]
    seen = docs.withColumn("_seen", let(plain_words(lower_ascii(whole(text))), of))
    base, found = F.col("_seen.base"), F.col("_seen.found")
    at, labels = F.transform(base, lambda b: b["at"]), F.transform(base, lambda b: b["label"])
    more = F.transform(F.filter(found, lambda x: x["share"] >= SHARE), lambda x: x["label"])
    return seen.select(
        *others,
        F.col("_seen.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, more))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT rid, i - 1 AS i, ws[i] AS w FROM d, unnest(generate_series(1, len(ws))) AS u(i)),
phrases(label, n, words) AS (VALUES {", ".join(f"('{label}', {len(text.split())}, {text.split()})" for text, label in PHRASES)}),
base AS (SELECT rid, label, p.i AS pos FROM p JOIN phrases ON p.w = words[1] JOIN d USING (rid) WHERE list_slice(ws, p.i + 1, p.i + n) = words),
templates(t, label, n) AS (VALUES {_values((t, label, len(text.split())) for t, (label, text, _) in enumerate(TEMPLATES))}),
tw(t, j, w) AS (VALUES {_values((t, j, w) for t, (_, text, _) in enumerate(TEMPLATES) for j, w in enumerate(text.split()))}),
keys(t, key_at, key_len, words) AS (VALUES {", ".join(f"({t}, {_key(text, phrase)[0]}, {_key(text, phrase)[1]}, {phrase.split()})" for t, (_, text, phrase) in enumerate(TEMPLATES))}),
al AS (SELECT p.rid, keys.t, p.i - key_at AS pos FROM p JOIN keys ON p.w = words[1] JOIN d USING (rid) WHERE list_slice(ws, p.i + 1, p.i + key_len) = words),
st AS (SELECT al.rid, al.t, al.pos, tw.j, coalesce(p.w = tw.w, false) AS ok FROM al JOIN tw USING (t) LEFT JOIN p ON p.rid = al.rid AND p.i = al.pos + tw.j),
ver AS (SELECT st.rid, label, count(*) FILTER (ok) / n AS share FROM st JOIN templates USING (t) GROUP BY st.rid, st.t, st.pos, label, n),
b AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM ver WHERE share >= {SHARE}) GROUP BY rid),
s AS (SELECT rid, max(share) AS score FROM ver GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(s.score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""
