"""Near copies, passages, mixing, stores, counts and scores against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from corpora import frame, plain, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_filters import WHITE, lower

from sonde.llm import components, context_tree, mixing, scratch, simhash, suffix_dedup, token_counts, token_store
from sonde.llm.running import running_sums


def fingerprint(t):
    w = WHITE.findall(lower(t))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def classes(values, near):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_simhash(spark):
    rows = texts()
    fps = [fingerprint(t) for _, t, _ in rows]
    label = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {c: min((d for (d, *_), x in zip(rows, label, strict=True) if x == c and d is not None), default=None) for c in label}
    got = simhash.near_components(frame(spark)).select("doc_id", "fp", "component_id").collect()
    assert plain((d, f % (1 << 64), c) for d, f, c in got) == plain((d, f, least[c]) for (d, *_), f, c in zip(rows, fps, label, strict=True))


def test_simhash_keeps_one_row_of_each_component(spark):
    docs = frame(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert kept.count() == simhash.near_components(docs).select("component_id").distinct().count()
    assert kept.filter("doc_id = 103").count() == 1  # of two equal rows and one without an id
    assert simhash.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4096, 6])
def test_all_links_are_found_however_groups_are_cut(spark, most):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    nodes = {r["node"] % (1 << 64): r["root"] for r in components.components(simhash.local_stars(df, most=most)).collect()}
    label = classes(values, lambda a, b: (a ^ b).bit_count() <= 2)
    groups, found = defaultdict(set), defaultdict(set)
    for v, c in zip(values, label, strict=True):
        groups[c].add(v)
        found[nodes.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=30, unique=True))
@settings(max_examples=50, deadline=None)
def test_gray_rank_orders_by_single_bits(values):
    x = np.array(values, np.uint64)
    rank = simhash.gray_rank(x)
    assert (rank ^ (rank >> np.uint64(1)) == x).all()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 150), (150, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {150: 150, 200: 150}
    assert components.components(links.limit(0)).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(i % 7, i, i * i) for i in range(50)] + [(None, 99, 5)], "a long, b long, v long").withColumn("one", F.lit(1).cast("long"))
    got = running_sums(df.repartition(6), ["a", "b"], {"s": "v", "n": "one"}).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(51)) and got[0]["b"] == 99
    assert [r["s"] for r in got] == [0, *np.cumsum([r["v"] for r in got])[:-1]]


def wanted_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, held = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        if not free:
            return held
        part = (total - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if part * weight[s] >= 2 * sizes[s]]
        if not over:
            return held | {s: part * weight[s] for s in free}
        held |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = texts()
    docs = frame(spark).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", "text")
    got = mixing.mix(docs).join(docs.select("uid", "source"), "uid").collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WHITE.findall(t or ""))
    targets = wanted_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert plain((r["doc_id"], r["size"]) for r in got) == plain((d, len(WHITE.findall(t or ""))) for d, t, _ in rows)
    for s, n in taken.items():
        assert abs(n - targets[s]) <= max((r["size"] for r in got if r["source"] == s), default=0) / 2 + 1
    again = mixing.mix(docs.repartition(3)).groupBy("doc_id", "size").agg(F.sum("taken")).collect()
    assert plain(again) == plain(mixing.mix(docs).groupBy("doc_id", "size").agg(F.sum("taken")).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_rows(spark):
    docs = frame(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    have, took = (Counter(tuple(r) for r in df.collect()) for df in (docs, out))
    assert took and all(n <= 2 * have[r] for r, n in took.items())
    rows = [(1, "", "a"), (2, None, "a"), (3, " \n", "a"), (4, "one two", "a"), (5, "three", "a"), (6, "w " * 400, "b")]  # a is taken twice in full
    assert Counter(r["doc_id"] for r in mixing.mixed(frame(spark, rows)).collect() if r["source"] == "a") == {4: 2, 5: 2}


NASTY = ["", None, "  \t\n", "It's <|endoftext|> x<|startoftext|>y don't we'll 're", "a\x00b \x00 c", "É́ é ̈x ΑΣ ΣΑΣ İstanbul K", "漢字　かな x", "123 4.5 --- ###$$$ the&&& a.b, 'tis", "a" * 3000, "\x1cab\x1d c\x85d", "😀😀 ok", "<|ENDOFTEXT|> Àé× ÿ. ß!"]


def test_word_encoder_gives_what_the_library_gives():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.word_bpe())
    encoder = token_store.WordEncoder(token_store.word_bpe())
    for _ in range(2):  # the second time from what is known
        ids, ends = encoder.encode(pa.array(NASTY, pa.string()))
        for t, a, b in zip(NASTY, [0, *ends], ends, strict=False):
            assert ids[a:b].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.word_bpe())
    rows = texts()
    path = scratch.new_path(spark, "store")
    token_store.write_store(frame(spark), path, token_store.word_bpe())
    want = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t, _ in rows]
    got = token_store.read_ids(spark, path).orderBy("start").collect()
    assert plain((r["doc_id"], bytes(r["ids"])) for r in got) == plain(want)
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in want), key=lambda d: -1 if d is None else d)
    start = 0
    for r in got:
        assert r["start"] == start
        start += len(r["ids"]) // 4
    digests = token_store.read_digests(spark, path).collect()
    assert plain((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in digests) == plain((d, len(x) // 4, zlib.crc32(x)) for d, x in want)
    chunks = token_store.stored_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").agg(F.sum("n_docs")).first()[0] == len(rows)


@pytest.mark.parametrize("lost", ["recipes", "packs"])
def test_a_store_with_a_loss_is_not_read(spark, lost):
    path = scratch.new_path(spark, "store")
    token_store.write_store(frame(spark), path, token_store.word_bpe())
    rows = spark.read.parquet(f"{path}/{lost}").collect()
    gone = rows[0] if lost == "recipes" else next(r for r in rows if r["digest"] is not None)
    schema = spark.read.parquet(f"{path}/{lost}").schema
    spark.createDataFrame([r for r in rows if r != gone], schema).write.mode("overwrite").parquet(f"{path}/{lost}")
    with pytest.raises(Exception, match="manifest" if lost == "recipes" else "put together"):
        token_store.read_digests(spark, path).collect()


def test_empty_store(spark):
    path = scratch.new_path(spark, "store")
    token_store.write_store(frame(spark, []), path, token_store.word_bpe())
    assert token_store.read_digests(spark, path).count() == 0


@given(st.lists(st.integers(0, 60_000), max_size=400), st.lists(st.integers(0, 400), max_size=4))
@settings(max_examples=30, deadline=None)
def test_chunks_end_at_documents_and_follow_content(ids, ends):
    ids = np.array(ids, np.uint32)
    ends = np.array(sorted({*[e for e in ends if 0 < e < len(ids)], *([len(ids)] if len(ids) else [])}), np.int64)
    at = token_store.cuts(ids, ends)
    assert set(ends.tolist()) <= set(at.tolist())
    if len(ends) > 1:  # a document's chunks do not depend on what stands before it
        alone = token_store.cuts(ids[ends[0] :], ends[1:] - ends[0])
        assert (at[at > ends[0]] - ends[0]).tolist() == alone.tolist()


@given(st.binary(max_size=60), st.binary(max_size=60))
@settings(max_examples=50, deadline=None)
def test_crc_of_two_strings(a, b):
    assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.byte_bpe())
    rng = random.Random(1)
    bits = ["'", "s", "t", "r", "e", "v", "l", "d", "m", " ", "  ", "\n", "1", "!", "é", "A", "x", "\t", " ", "漢", "'s", "<|endoftext|>"]
    some = NASTY + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 50))) for _ in range(400)] + [" " * 700, "-" * 300, "\n" * 50 + "x"]
    rows = [(k, t, "s") for k, t in enumerate(some)] + texts()
    got = token_counts.token_counts(frame(spark, rows).select("doc_id", "text"), token_counts.byte_bpe()).collect()
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert plain(got) == plain((d, len((t or "").encode()), count(t), count(t) > 512) for d, t, _ in rows)
    assert token_counts.token_counts(frame(spark, []).select("doc_id", "text"), token_counts.byte_bpe()).count() == 0


@given(st.lists(st.integers(0, 11), max_size=1500))
@settings(max_examples=25, deadline=None)
def test_scan_of_chunks_is_a_walk(symbols):
    classes_ = np.array(symbols, np.uint8)
    state, want = 0, []
    for c in symbols:
        want.append(token_counts._MARKS[c, state])
        state = token_counts._GOING[c, state]
    assert token_counts.scan(classes_).tolist() == want


def without_repeats(rows, n=suffix_dedup.LENGTH):
    data = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (d, *_), b in zip(rows, data, strict=True):
        hit = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        spans = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((d, bytes(x for x, h in zip(b, hit, strict=True) if not h), len(b), sum(hit), spans))
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 6])
def test_repeated_passages(spark, group):
    rng = random.Random(3)
    noise = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    passage, long = noise("abcdef gh", 430), noise("abcdef gh", 900)
    rows = [(k, noise("xyz uvw", rng.randint(0, 400)) + passage + noise("xyz uvw", rng.randint(0, 400)), "s") for k in range(25)]
    rows += [(50, "a" * 1500, "s"), (51, "ab" * 500, "s"), (52, long, "s"), (53, long, "s"), (54, long[:500] + "!" + long[500:], "s"), (55, long[1:400], "s"), (56, long[:400], "s"), (57, "é" * 450, "s")]
    rows += [(60 + k, "<" + long[a : a + rng.randint(390, 900)] + ">", "s") for k, a in enumerate(rng.sample(range(500), 12))] + texts()
    got = suffix_dedup.cleaned(frame(spark, rows), group=group).collect()
    assert plain((r[0], bytes(r[1]), *r[2:5]) for r in got) == plain(without_repeats(rows))
    assert suffix_dedup.cleaned(frame(spark, [])).count() == 0


def shared_words(rows, n=suffix_dedup.PASSAGE.length):
    """(runs, words) of each row that lie in n words of another row."""
    data = [WHITE.findall(t or "") for _, t, _ in rows]
    strings = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in data]
    seen = Counter(x for s in strings for x in s)
    out = []
    for (d, *_), w in zip(rows, data, strict=True):
        hit = [0] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = [1] * n
        out.append((d, sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1])), sum(hit)))
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 6])
def test_passages_of_other_documents(spark, group):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bdfgk" for b in ["a", "e", "i", "o", "ui"]]
    noise = lambda n: rng.choices(words, k=n)
    shared, long = noise(51), noise(160)
    rows = [(k, " ".join(noise(rng.randint(0, 90)) + shared + noise(rng.randint(0, 90))), "s") for k in range(25)]
    rows += [(40, " ".join(noise(9) + shared + noise(9) + shared + noise(9)), "s"), (41, " ".join(shared[:50] + noise(5)), "s"), (42, " ".join(["a"] * 300), "s"), (43, "\n".join([" ".join(noise(60))] * 3), "s")]
    rows += [(60 + k, " ".join(noise(5) + long[a : a + rng.randint(45, 160)] + noise(5)), "s") for k, a in enumerate(rng.sample(range(100), 30))] + texts()
    rows += [(100 + k, "x " * (51 + 40 * k), "s") for k in range(2)]
    got = suffix_dedup.cleaned(frame(spark, rows), group=group).collect()
    assert plain((r["doc_id"], r["n_passages"], r["passage_words"]) for r in got) == plain(shared_words(rows))


@given(st.lists(st.binary(max_size=12), min_size=1, max_size=25), st.integers(1, 3))
@settings(max_examples=40, deadline=None)
def test_suffix_order(rows, groups):
    size = np.array([len(r) for r in rows])
    data = np.zeros((len(rows), 13), np.uint8)
    for k, r in enumerate(rows):
        data[k, : len(r)] = np.frombuffer(r, np.uint8)
    group = np.arange(len(rows)) % groups
    order, common = suffix_dedup.suffix_order(data, size, group)
    assert order.tolist() == sorted(range(len(rows)), key=lambda k: (group[k], rows[k], k))
    for a, b, n in zip(order, order[1:], common[1:], strict=False):
        shared = next((i for i, (x, y) in enumerate(zip(rows[a], rows[b], strict=False)) if x != y), min(size[a], size[b]))
        assert n == (shared if group[a] == group[b] else 0)


def tree_scores(train, asked, depth):
    """The same mixture by its definition, with a dictionary of nodes."""
    tree, below, memo = defaultdict(lambda: [0, 0]), defaultdict(list), {}
    steps = lambda t: ((x, p, bit) for x in [b"\0" * depth + t + b"\0"] for p in range(depth, len(x)) for bit in range(8))
    name = lambda x, p, bit, d: (x[p - d : p], (x[p] >> (8 - bit)) | (1 << bit))
    for t in train:
        for x, p, bit in steps(t):
            for d in range(depth + 1):
                tree[name(x, p, bit, d)][x[p] >> (7 - bit) & 1] += 1
    for context, node in list(tree):
        if context:
            below[context[1:], node].append((context, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def whole(key):
        if key not in memo:
            e = kt(*tree[key])
            memo[key] = e if len(key[0]) == depth else np.logaddexp(e, sum(map(whole, below[key]))) - math.log(2)
        return memo[key]

    out = []
    for t in asked:
        total = 0.0
        for x, p, bit in steps(t):
            guess = None
            for d in range(depth, -1, -1):
                key = name(x, p, bit, d)
                if key in tree:
                    a, b = tree[key]
                    here, stop = (b + 0.5) / (a + b + 1), math.exp(kt(a, b) - math.log(2) - whole(key))
                    guess = here if guess is None or d == depth else stop * here + (1 - stop) * guess
            guess = 0.5 if guess is None else guess
            total += math.log10(guess if x[p] >> (7 - bit) & 1 else 1 - guess)
        out.append(total)
    return out


def test_hot_keys_are_joined_without_marking_all_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(k % 7 if k < 40 else 1, k % 2, k) for k in range(80)], "gram long, c1 long, uid long")
    for on in (["gram"], ["gram", "c1"]):
        keys = rows.groupBy(*on).count().filter("gram <> 2")
        got = suffix_dedup._of_keys(rows, keys, on, "count", 80)
        assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = rows.join(keys, on)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_words_that_differ_in_case_and_signs_are_looked_up_once():
    encoder = token_store.WordEncoder(token_store.word_bpe())
    asked = []

    class Known(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    encoder.parts = Known()
    texts = ["Some some SOME some, words", "words, Words. some"]
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*encoder.whole.encode(t, add_special_tokens=False).ids, token_store.END_ID] for t in texts]
    assert sorted(k for k in asked if k.isalpha()) == ["some", "some", "words", "words"]


def test_batches_are_answered_in_parts_and_leave_no_memory(monkeypatch):
    rng = np.random.default_rng(6)
    docs = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([" ".join(map(str, rng.integers(0, 10**6, 300))) + "".join(map(chr, rng.integers(32, 127, 500))) for _ in range(40)])], names=["doc_id", "text"])
    released = []
    monkeypatch.setattr(context_tree, "release", lambda: released.append(1))
    monkeypatch.setattr(context_tree.TaskContext, "get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 3)}))
    out = list(context_tree._counted(context_tree._batched(iter([docs]))))
    asked = [b for b in out if b.column("asked").null_count < b.num_rows]
    assert sum(b.num_rows for b in asked) > 16 >= max(b.num_rows for b in asked)
    assert len(released) >= 2


@pytest.mark.parametrize("asked_strings", [context_tree.ASKED, 40])
def test_context_tree(spark, asked_strings):
    rows = texts()
    docs = frame(spark, rows)
    got = context_tree.scores(docs, asked_strings=asked_strings).collect()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = [[*WHITE.findall(lower(t)), None] for _, t, _ in rows]
    counts = Counter(w for (d, *_), ws in zip(rows, words, strict=True) if not fold(d) for w in ws)
    n, kinds = sum(counts.values()), len(counts)
    train = [lower(t).encode() for d, t, _ in rows if not fold(d)]
    tree = tree_scores(train, [lower(t).encode() for _, t, _ in rows], context_tree.DEPTH)
    want = []
    for (d, *_), ws, score in zip(rows, words, tree, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in ws)
        want.append((d, fold(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 8), round(score, 7)))
    assert plain((*r[:5], round(r[5], 8), round(r[6], 7)) for r in got) == plain(want)
    assert any(r["held_out"] for r in got)
    assert context_tree.scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 40])
def test_a_model_gives_probabilities(k):
    strings = np.uint64(int.from_bytes(b"\0\0\0abc"[-6:], "big")) + np.arange(k, dtype=np.uint64)
    model, _ = context_tree.weigh(context_tree.levels(strings, np.arange(5, 5 + k)))
    every = np.arange(256, dtype=np.uint64) + np.uint64(int.from_bytes(b"\0\0\0ab\0", "big"))
    assert (10 ** context_tree.log_probabilities(model, every)).sum() == pytest.approx(1.0)


@given(st.lists(st.integers(0, (1 << 48) - 1), unique=True, max_size=50))
@settings(max_examples=30, deadline=None)
def test_strings_are_packed_and_dealt_alike_on_both_sides(values):
    strings = np.array(sorted(values), np.uint64)
    if len(strings):
        assert (context_tree._unpacked(context_tree._packed(strings)) == strings).all()
    assert all(0 <= g < context_tree.GROUPS for g in context_tree._group(strings))


def test_groups_of_columns_and_arrays_agree(spark):
    values = [random.Random(2).getrandbits(48) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "key long").select(context_tree._group_column("key").alias("g")).collect()
    assert [r["g"] for r in got] == context_tree._group(np.array(values, np.uint64)).tolist()


def test_held_out_texts_are_likelier_than_chance(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["river", "stone", "valley", "bridge"]) for _ in range(60)), "s") for k in range(60)]
    for r in context_tree.scores(frame(spark, rows)).filter("held_out").collect():
        size = len(rows[r["doc_id"]][1]) + 1
        assert -r["score"] / math.log10(2) / size < 2.0  # bits a byte, of eight


def test_digests_are_of_whole_texts(spark):
    kept = suffix_dedup.cleaned(frame(spark)).filter("doc_id = 108").first()["kept"]
    assert hashlib.sha256(bytes(kept)).hexdigest() == hashlib.sha256(b"one").hexdigest()
