"""Quality rules, decontamination, licences and line templates against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from corpora import frame, plain, texts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonde.llm import decontaminate, license_scan, line_templates, quality_rules
from sonde.llm.textexpr import gram_hashes, sliding

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def repeated(words, n=8):
    runs = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = set()
    for i in range(len(words) - n + 1):
        if runs[tuple(words[i : i + n])] > 1:
            hit |= set(range(i, i + n))
    return len(hit)


def test_quality_counts(spark):
    got = quality_rules.score_quality(frame(spark)).select("doc_id", *[F.col("_quality")[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]).collect()
    want = []
    for d, t, _ in texts():
        w = WHITE.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WHITE.search(x)]
        rep = repeated(w)
        failed = len(w) < 20 or 100 * rep > 30 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, failed))
    assert plain(tuple(r)[:-1] for r in got) == plain(want)
    assert not any(r[-1] and r[-2] for r in got)


def test_quality_keeps_rows_as_they_are(spark):
    docs = frame(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.exceptAll(docs).count() == 0
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_quality_rejects_junk_and_keeps_prose(spark):
    prose = "the quick river of stone and salt ran on for the people in a valley that is far from the town as it was before"
    rows = [(1, prose, "s"), (2, " ".join(w + "$$$" for w in prose.split()), "s"), (3, "buy now " * 40, "s"), (4, "short one", "s")]
    assert [r["doc_id"] for r in quality_rules.keep_good(frame(spark, rows)).collect()] == [1]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 9))
def test_gram_hashes_tell_runs_apart(spark, words, k):
    df = spark.createDataFrame([(words,)], "w array<string>")
    h = df.select(gram_hashes(F.col("w"), k)).first()[0]
    runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    assert len(h) == len(runs)
    assert len(set(h)) == len(set(runs))
    assert [h[i] == h[0] for i in range(len(h))] == [r == runs[0] for r in runs]


@pytest.mark.parametrize("width", [1, 2, 5, 6])
def test_sliding(spark, width):
    v = [5, 3, 8, 1, 9, 2, 7]
    got = spark.createDataFrame([(v,)], "v array<int>").select(sliding(F.col("v"), width, lambda a, b: F.least(a, b))).first()[0]
    assert got == [min(v[i : i + width]) for i in range(len(v) - width + 1)]


def contaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall(lower(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(i)
    out = []
    for d, t, _ in docs:
        w = PLAIN.findall(lower(t))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names |= windows[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), sorted(map(str, names))))
    return out


ITEMS = [(1, "the old RIVER ran past a grey stone and under the long bridge of"), (2, "stone river"), (3, None), (4, ""), (5, "valley met to trade wool and salt in the early years and then some more"), (6, "word word word word word word word word word word word"), (2, "stone river"), (7, "é"), (908, "under the long bridge of the town where people of the")]


@pytest.mark.parametrize("literals", [20_000, 0])
def test_decontamination(spark, literals):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    got = decontaminate.contamination(docs, items, literals).collect()
    assert plain((r["doc_id"], r["n_words"], r["n_hit"], sorted(map(str, r["item_ids"] or []))) for r in got) == plain(contaminated(texts(), ITEMS))


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark)
    assert decontaminate.keep_clean(docs, none).count() == docs.count()
    assert decontaminate.keep_clean(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    kept = decontaminate.keep_clean(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


LICENCES = [
    (901, "Released under the MIT License.", "s"), (902, "This work is licensed under the GNU General Public License, version 3. More words.", "s"), (903, "Licensed under CC BY-NC 4.0.", "s"),
    (904, "apache license and mit license and Mit  LICENSE", "s"), (905, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "s"),
    (906, "Permission is hereby granted to any person", "s"), (907, "redistribution and use in source and binary forms, with or without modification, are permitted", "s"), (908, None, "s"), (909, "mit", None), (909, "mit license", None),
]


def scanned(rows):
    words = {k: PLAIN.findall(lower(t)) for k, (_, t, _) in enumerate(rows)}
    out = []
    for k, (d, _, _) in enumerate(rows):
        w = words[k]
        base = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels, score = {label for _, label in base}, 0.0
        for label, text, phrase in license_scan.TEMPLATES:
            tw, pw = text.split(), phrase.split()
            key = next(j for j in range(len(tw)) if tw[j : j + len(pw)] == pw)
            for i in range(len(w)):
                if w[i : i + len(pw)] == pw:
                    share = sum(0 <= i - key + j < len(w) and w[i - key + j] == x for j, x in enumerate(tw)) / len(tw)
                    score = max(score, share)
                    labels |= {label} if share >= license_scan.SHARE else set()
        at = [i for i, _ in base]
        out.append((d, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


def test_licences(spark):
    rows = LICENCES + texts()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = license_scan.license_scan(frame(spark, rows).select("doc_id", "text")).select(*names).collect()
    assert plain(got) == plain(scanned(rows))
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] > 900}
    assert (by[903]["labels"], by[905]["labels"], by[906]["labels"], by[902]["score"]) == ("cc-by-nc", "mit", "", 1.0)
    assert license_scan.license_scan(frame(spark, []).select("doc_id", "text")).count() == 0


def templates_dropped(rows, least):
    forms = defaultdict(set)
    lines = []
    for k, (_, t, _) in enumerate(rows):
        for n, x in enumerate((t or "").split("\n")):
            w = tuple("*" if re.search("[0-9]", y) else y for y in WHITE.findall(x))
            lines.append((k, n, x, w))
            if w:
                forms[w].add(k)
    support = defaultdict(set)
    for w, ds in forms.items():
        for i, x in enumerate(w):
            support[len(w), w[:3], i, x] |= ds
    template = {w: tuple(x if len(support[len(w), w[:3], i, x]) >= least else "*" for i, x in enumerate(w)) for w in forms}
    total = defaultdict(set)
    for w, ds in forms.items():
        total[len(w), w[:3], template[w]] |= ds
    gone = {w for w in forms if len(total[len(w), w[:3], template[w]]) >= least and 2 * template[w].count("*") <= len(w)}
    out = []
    for k, (d, _, _) in enumerate(rows):
        own = [x for x in lines if x[0] == k]
        out.append((d, "\n".join(x for _, _, x, w in own if w not in gone), sum(bool(w) for *_, w in own), sum(w in gone for *_, w in own)))
    return out


def test_line_templates(spark):
    rows = [(k, f"page {k} of 9 next\nown words number {'abcdefg'[k]} here\n\nuser u{k} said hello to the {'cat' if k % 2 else 'dog'} today", "s") for k in range(7)] + texts()
    got = line_templates.without_templates(frame(spark, rows)).collect()
    assert plain(got) == plain(templates_dropped(rows, line_templates.MIN_DOCS))
    assert sum(r["n_dropped"] for r in got) >= 14
    assert line_templates.without_templates(frame(spark, [])).count() == 0


def test_a_text_of_very_many_lines(spark):
    """Work grows with the lines, not with their pairs; the long text's forms are those that are spelled out."""
    lines = [f"entry of the {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)} kind was seen here" for k in range(17_576)]
    rows = [(1, "\n".join(lines * 3), "s")] + [(k, lines[k] + "\nonly here " + "abcdefgh"[k], "s") for k in range(2, 8)]
    got = {r["doc_id"]: r for r in line_templates.without_templates(frame(spark, rows)).collect()}
    assert (got[1]["n_lines"], got[1]["n_dropped"], got[1]["text"]) == (52_728, 52_728, "")
    assert all(got[k]["text"] == "only here " + "abcdefgh"[k] for k in range(2, 8))
