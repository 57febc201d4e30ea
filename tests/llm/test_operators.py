"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelode.llm import decontaminate, lm, mixing, neardup, pii, quality, substrings, textnum, tokenbin, topk, urls

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def text_of(corpus):
    return {r[0]: r[1] or "" for r in corpus}


# 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_codes_are_prefix_free_and_short(n):
    counts = np.zeros(6000, np.int64)
    counts[:n] = np.random.default_rng(n).zipf(1.3, n).clip(1, 10**12)
    lengths = tokenbin.code_lengths(counts, 14)
    assert lengths.max(initial=0) <= 14 and ((lengths > 0) == (counts > 0)).all()
    if n > 1:
        assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) == 1.0


def test_code_lengths_are_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    best = min(sum(c * x for c, x in zip(counts, ls, strict=True)) for ls in itertools.combinations_with_replacement(range(4, 0, -1), 8) if sum(2.0**-x for x in ls) <= 1)
    assert (counts * tokenbin.code_lengths(counts, 4)).sum() == best


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.zipf(1.4, n).clip(0, 65535).astype(np.uint16)
        lengths = tokenbin.code_lengths(np.bincount(ids, minlength=1 << 16))
        block = tokenbin.pack_block(np.array([0, 7]), 1, np.array([0, n]), ids, lengths, tokenbin.canonical(lengths))
        d, nulls, s, out = tokenbin.unpack_block(block, *tokenbin.decoding_table(lengths))
        assert (list(d), nulls, list(s)) == ([0, 7], 1, [0, n]) and (out == ids).all()


def test_token_ids(spark, docs, corpus, empty, clashing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenbin.vocabulary_path("byte_bpe_50k.json"))
    want, at = [], 0
    for k, t, *_ in sorted(corpus, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for source in (docs, clashing):
        got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.digest(spark, source).collect())
        assert got == want
    assert tokenbin.digest(spark, empty).count() == 0


def test_token_ids_of_null_and_equal_doc_ids(spark):
    """Rows without doc_id come first; ties of doc_id are in the same order in every run."""
    rows = [(None, "no id"), (3, "x y z"), (3, "a"), (3, None), (3, "a"), (1, "first"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
    first = sorted(map(key, tokenbin.digest(spark, frame).collect()))
    assert [r[1] for r in first] == [None, None, 1, 3, 3, 3, 3]
    assert [r[0] for r in first] == [sum(x[2] for x in first[:k]) for k in range(len(first))]
    assert first == sorted(map(key, tokenbin.digest(spark, frame.repartition(5)).collect()))


def ids_of(texts):
    own = tokenbin.encoder(tokenbin.vocabulary_path("byte_bpe_50k.json"))
    ids, first = own.ids(*textnum.buffers(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenbin.vocabulary_path("byte_bpe_50k.json"))
    return lambda texts: [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_equal_the_whole(whole):
    texts = ["a  b", " lead", "trail ", " ", "", None, "x \n y", "it's 42, ok", "a<|endoftext|>b", "<|endof", "text|>", "é\x1cb c᠎ d", "日本 語", "q" * 5000, "end ", " begin"]
    assert ids_of(texts) == whole(texts)


def test_pieces_of_any_characters_equal_the_whole(whole):
    """White space, signs, digits and letters of all lengths in UTF-8, in every neighbourhood."""
    import random

    rnd = random.Random(4)
    signs = [" ", " ", " ", "\n", "\t", "\x85", "\xa0", "\u2003", "\u3000", "\u1680", "\u180e", "\x1c", "\x7f", "'", "'s", "'ll", "’", "a", "B", "ß", "é", "×", "÷", "²", "7", "٣", "я", "中", "😀", ".", "-", "\u0301", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    assert ids_of(texts) == whole(texts)


def test_the_cache_is_bounded(whole, monkeypatch, words):
    monkeypatch.setattr(tokenbin, "CACHE_BYTES", 5000)
    texts = [" ".join(words[k : k + 40]) for k in range(0, 400, 20)]
    tokenbin._loaded.clear()
    got = [ids_of([t])[0] for t in texts]
    own = tokenbin.encoder(tokenbin.vocabulary_path("byte_bpe_50k.json"))
    assert got == whole(texts) and own.size <= 2500 and len(own.kept) + len(own.older) <= 25
    tokenbin._loaded.clear()


# 2


def test_mixing(docs, corpus, empty, clashing):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus}
    for source in (docs, clashing):
        rows = mixing.mixed(source).collect()
        assert len(rows) == len(corpus) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(source).collect()))
        assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[(r["source_size"], r["target"])].append(r)
        for (_, target), own in by.items():
            assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
        total = sum(r["size"] for r in rows)
        assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("weight", [None, "w"])
def test_odds_differ_by_document(spark, weight):
    """Many sources of the same documents: each is drawn as often as its rate says, and every source is near its target."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 10, 10, 40, 40, 7]
    given = [1.0, 9.0, 2.0, None, 3.0, 1.0, 1.0, 2.0, 1.0, 1.0, 5.0, 1.0, 1.0, 4.0, 1.0]
    rows = [(k * 1000 + i * 100 + j, f"s{k:04}", "w " * n, given[j]) for k in range(120) for i in range(10) for j, n in enumerate(sizes)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string, w double"), weight).collect()
    weights = [g or 1.0 for g in given] if weight else [n.bit_length() for n in sizes]
    for target in {r["target"] for r in got}:
        low, high = 0.0, 1e6  # the level by bisection
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(10 * n * min(2, w * level) for n, w in zip(sizes, weights, strict=True)) < target else (low, level)
        own = [r for r in got if r["target"] == target]
        for j, w in enumerate(weights):
            copies = [r["copies"] for r in own if r["doc_id"] % 100 == j]
            rate = min(2, w * level)
            assert np.mean(copies) == pytest.approx(rate, abs=0.09) and set(copies) <= {math.floor(rate + 1e-9), math.ceil(rate - 1e-9)}
        taken = collections.Counter()
        for r in own:
            taken[r["doc_id"] // 1000] += r["taken"]
        assert all(abs(t - target) <= 89 / 2 for t in taken.values())


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 50), ("c", 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    left, want, weight = 1.5 * 1160, {}, {"a": 5, "b": 2, "c": 1, None: 5}
    cap = {"a": 200, "b": 20, "c": 2000, None: 100}
    while True:  # shares by weight, cut, until none is above
        total = sum(w for s, w in weight.items() if s not in want)
        above = [s for s, w in weight.items() if s not in want and left * w / total >= cap[s]]
        if not above:
            break
        for s in above:
            want[s] = cap[s]
        left = 1.5 * 1160 - sum(want.values())
    want |= {s: left * w / total for s, w in weight.items() if s not in want}
    assert got == pytest.approx(want)


# 3


def test_quality(spark, words, empty, docs, clashing):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice(words, 60))
    rows = [(k, text() if k % 3 else text().upper().replace(" ", "!! "), int(k % 3 > 0)) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.train(frame.where("doc_id < 200"), frame.select("doc_id", "label"))
    held = quality.score(frame.where("doc_id >= 200"), model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["label"] == 1) for r in held]) > 0.97
    for source in (docs, clashing):
        got = quality.score(source, model, "quality_score").collect()
        assert len(got) == source.count() and all(0 <= r["quality_score"] <= 1 for r in got)
    nothing = quality.train(empty, frame.select("doc_id", "label"))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_training_rows(spark, words, monkeypatch):
    """Ids without a document use up no places, contradicting labels don't train, a doc_id's least text trains once."""
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda rows, y, bits: seen.update(n=len(rows), y=sorted(y.tolist()), rows=rows))
    docs = spark.createDataFrame([(k, words[k]) for k in range(20)] + [(3, "zzz")] * 50 + [(None, "x")], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(500)] + [(4, 1), (None, 1), (6, None)]
    quality.train(docs, spark.createDataFrame(labels, "doc_id long, label int"), max_rows=10)
    assert seen["n"] == 10
    quality.train(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    assert seen["n"] == 19 and sum(seen["y"]) == 10
    least = next(quality.indicators(pa.array([min(words[3], "zzz")]), 18))[0]
    assert any((r == least).all() for r in seen["rows"] if len(r) == len(least))


def test_ratio_and_descent_equal_brute_force():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 9))).astype(np.int32) for _ in range(60)]
    y = np.array([int(2 in r or rng.random() < 0.3) for r in rows])
    ratio = quality.log_count_ratio(rows, y, 40)
    count = {v: [1 + sum(k in r for r, w in zip(rows, y, strict=True) if w == v) for k in range(40)] for v in (0, 1)}
    want = [math.log(count[1][k] / sum(count[1]) / (count[0][k] / sum(count[0]))) for k in range(40)]
    assert ratio == pytest.approx(want)

    got, bias = quality.dual_coordinate_descent(rows, y, ratio, epochs=3000)
    w = np.divide(got, ratio, out=np.zeros(40), where=ratio != 0)
    x = np.zeros((60, 40))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9)
    cost = np.where(y == 1, 5 / (y == 1).mean(), 5 / (y == 0).mean())
    sign = 2 * y - 1
    loss = lambda w, b: (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - sign * (x @ w + b))).sum()
    best = loss(w, bias)
    v, c, low = w.copy(), bias, best  # subgradient descent from there finds nothing lower
    for k in range(4000):
        active = sign * (x @ v + c) < 1
        g, gb = v - (cost * sign * active) @ x, c - (cost * sign * active).sum()
        v, c = v - 0.01 / (k + 1) * g, c - 0.01 / (k + 1) * gb
        low = min(low, loss(v, c))
    assert best <= low * 1.002


# 4


def brute_substrings(corpus):
    seen, out = set(), {}
    for k, b in sorted({(r[0], (r[1] or "").encode()) for r in corpus}):
        hit = bytearray(len(b))
        for i in range(len(b) - 99):
            if (s := b[i : i + 100]) in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out[k] = (len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(docs, corpus, empty, clashing):
    want = brute_substrings(corpus)
    for source in (docs, clashing):
        rows = substrings.deduplicated(source).collect()
        assert len(rows) == len(corpus)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert substrings.deduplicated(empty).count() == 0


def test_substrings_of_runs(spark):
    texts = ["a" * 99, "a" * 100, "a" * 101, "ab" * 300, "b" + "ab" * 120, "x" * 40 + "ab" * 60 + "y" * 70, "a" * 500]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_substrings(rows)


def test_substrings_of_shared_and_altered_passages(spark, words):
    """Passages with other neighbours, altered copies, and texts of one doc_id, over several tasks."""
    rnd = random.Random(11)
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = []
    for k in range(60):
        mine = passage.split()
        if k % 3 == 1:
            mine[rnd.randrange(60)] = rnd.choice(words)
        around = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(2)]
        texts.append(around[0] + " ".join(mine[rnd.randint(0, 8) : 60 - rnd.randint(0, 8)]) + around[1])
    texts += ["=" * 333, "\0" * 150 + "x", "ab\0" * 70, "\0" * 99 + "y" + "\0" * 130]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    got = substrings.deduplicated(spark.createDataFrame(rows, schema).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_substrings(rows)
    twice = [(1, passage, None, None, None), (2, "short", None, None, None), (2, passage + " more", None, None, None)]
    got = substrings.deduplicated(spark.createDataFrame(twice, schema).repartition(2)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0), (2, len(passage))]


def test_levels_report_later_starts():
    rng, index, first, want = np.random.default_rng(4), substrings.Levels(), {}, 0
    for _ in range(20):
        batch = np.zeros(50, substrings.START)
        batch["mark"], batch["doc"], batch["at"] = rng.integers(0, 200, 50), rng.integers(0, 9, 50), np.arange(50) + 1000 * rng.integers(0, 1000)
        index.add(batch)
        for m, d, a in batch.tolist():
            want += m in first
            first[m] = min(first.get(m, (d, a)), (d, a))
    assert {m: (d, a) for lv in index.levels for m, d, a in lv.tolist()} == first
    assert sum(map(len, index.repeated)) == want and len(index.levels) < 10


# 5


def test_lm(docs, corpus, empty, clashing):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = [[*WORD.findall(low(r[1] or "")), None] for r in corpus]
    train = F.col("doc_id") % 7 != 2
    count = collections.Counter(t for r, w in zip(corpus, tokens, strict=True) if r[0] % 7 != 2 for t in w)
    n, v = sum(count.values()), len(count)
    want = sorted((r[0], len(w), sum(count[t] > 0 for t in w), n) for r, w in zip(corpus, tokens, strict=True))
    base = {r[0]: sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w) for r, w in zip(corpus, tokens, strict=True)}
    whole = lm.scored(docs, train).collect()
    for got in (whole, lm.scored(clashing, train).collect(), lm.scored(docs, train, group_bytes=2000).collect()):
        assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
        assert all(r["base_score"] == pytest.approx(base[r["doc_id"]]) and r["score"] < 0 for r in got)
        assert {r["doc_id"]: pytest.approx(r["score"]) for r in got} == {r["doc_id"]: r["score"] for r in whole}
    assert lm.scored(empty, train).count() == 0


def test_filter_never_underestimates():
    rng = np.random.default_rng(2)
    keys, counts = np.unique(rng.integers(0, 1 << 40, 3000)).astype(np.uint64), None
    counts = rng.zipf(1.5, len(keys)).clip(1, 10**6)
    got = lm.probed(lm.filled(keys, counts), keys)
    assert (got >= lm.levels(counts)).all() and (got == lm.levels(counts)).mean() > 0.9
    other = rng.integers(0, 1 << 40, 3000).astype(np.uint64)
    assert (lm.probed(lm.filled(keys, counts), other) > 0).mean() < 0.08


# 6


def test_decontamination(spark, docs, corpus, words, empty, clashing):
    item = words[:40]
    changed = [*item[:39], "other"]
    rows = [(100, "pre " + " ".join(item) + " post", None, None, 1), (101, "x\n" + " ".join(changed).upper(), None, None, 1), (102, " ".join(item[:20]), None, None, 1), (103, " ".join(words[50:53]), None, None, 1)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(words[50:53])), (3, None), (4, ""), (None, "a b c d e f")], "item_id long, text string")
    more = spark.createDataFrame(rows, docs.schema)
    for source in (docs.union(more), clashing.unionByName(more, allowMissingColumns=True)):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(source, bench).collect()}
        assert got == {(100, 1): 1.0, (101, 1): pytest.approx(35 / 37), (103, 2): 1.0}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("item_id > 9")).count() == 0


# 7


def shingles(text):
    w = WORD.findall(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(x, y):
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_probability_jaccard_equals_its_definition():
    rng = np.random.default_rng(8)
    for _ in range(30):
        a, b = (np.unique(rng.integers(0, 30, 15)).astype(np.uint64) for _ in "ab")
        wa, wb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
        x, y = collections.Counter(dict(zip(a.tolist(), wa.tolist(), strict=True))), collections.Counter(dict(zip(b.tolist(), wb.tolist(), strict=True)))
        assert neardup.probability_jaccard((a, wa), (b, wb)) == pytest.approx(similarity(x, y))


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(9)
    common, a, b = (rng.integers(0, 1 << 48, k).astype(np.uint64) for k in (300, 40, 60))
    x, y = np.sort(np.concatenate((common, a))), np.sort(np.concatenate((common, b)))
    est = []
    for k in range(20):
        e = [np.bitwise_xor(s, np.uint64(k * 7919)) for s in (x, y)]
        sig = neardup.prob_min_hash(np.concatenate(e), np.repeat([0, 1], [len(x), len(y)]), np.ones(len(x) + len(y)), 2)
        est.append((sig[0] == sig[1]).mean())
    assert np.mean(est) == pytest.approx(300 / 400, abs=0.04)


def test_near_duplicates(docs, corpus, empty, clashing, spark):
    text = text_of(corpus)
    sets = {k: shingles(t) for k, t in text.items()}
    cls = {k: k for k in text}
    for a, b in itertools.combinations(sorted(text), 2):
        if text[a] == text[b] or (sets[a] and sets[b] and sets[a].keys() & sets[b].keys() and similarity(sets[a], sets[b]) >= 0.8):
            old, new = max(cls[a], cls[b]), min(cls[a], cls[b])
            cls = {k: new if c == old else c for k, c in cls.items()}
    for source in (docs, clashing):
        got = neardup.near_duplicates(source).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == cls and len(got) == len(text)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.one_of_each(spark, clashing, "").columns == clashing.columns


def test_blocks_of_a_large_bucket(spark, words, monkeypatch):
    """Many near copies that only a chain joins, over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = list(words[:150])
    rows = []
    for k in range(40):
        base[(7 * k) % 150] = f"new{k}"
        rows.append((k, " ".join(base), None, None, 1))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r["class_id"] for r in got} == {0}


# 8


def test_url_rules(spark):
    rows = [(0, "http://x.example.net/en/a?q", "example.net/en/", "allow"), (1, "https://A.NET/b", "net/", "block"), (2, "http://net", None, "allow"), (3, None, None, "allow"), (4, "no url", None, "allow"), (5, "http://example.com/de/", "example.com/de/", "block"), (6, "http://q.org/fr/1#x", "org/fr/", "allow"), (7, "http://notexample.com/de/", None, "allow"), (7, "http://notexample.com/de/", None, "allow")]
    pages = spark.createDataFrame([(r[0], r[1], r[0]) for r in rows], "page_id long, url string, score int")
    none = spark.createDataFrame([], "page_id long, verdict string")
    got = urls.judged(pages, none).collect()
    assert sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in got) == sorted((r[0], r[2] or "", r[3]) for r in rows)
    assert urls.judged(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows = [(k, f"http://s{k % 5}.test/{'ads' if k % 2 else 'news'}/{k}", "block" if k % 2 else "allow") for k in range(200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = urls.judged(frame.drop("verdict"), frame.where("page_id < 100").select("page_id", "verdict")).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got)


def brute_rules(rows, confidence=0.5):
    """{antecedent items: (verdict, confidence)} and each token's item, over all subsets of a page's items."""
    held = collections.defaultdict(set)
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            held[t].add(k)
    held = {t: frozenset(k) for t, k in held.items() if len(k) >= urls.MIN_ROWS}
    item = {t: min(u for u in held if held[u] == k) for t, k in held.items()}
    least = max(math.ceil(urls.MIN_SUPPORT * len(rows)), urls.MIN_ROWS)
    found = {}
    pages = [frozenset(item[t] for t in tokens if t in item) for tokens, _ in rows]
    for some in {frozenset(c) for p in pages for n in range(1, len(p) + 1) for c in itertools.combinations(sorted(p), n)}:
        said = [v for p, (_, v) in zip(pages, rows, strict=True) if some <= p]
        for v in set(said):
            if said.count(v) >= least and said.count(v) / len(said) >= confidence:
                found[some, v] = said.count(v) / len(said)
    return {(s, v): c for (s, v), c in found.items() if not any(found.get((s - {t}, v), -1) >= c for t in s)}, item


def test_mined_rules_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(160):
        tokens = sorted({f"t{x}" for x in rng.integers(0, 9, rng.integers(1, 6))} | ({"twin", "t3"} if rng.random() < 0.2 else set()))
        tokens += ["twin2"] if "twin" in tokens else []
        rows.append((tokens, "block" if ("t3" in tokens) != (rng.random() < 0.2) else "allow"))
    rules, items = urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), str(tmp_path / "mine"))
    want, item = brute_rules(rows)
    assert {r["t"]: r["item"] for r in items.collect()} == item and item["twin2"] == item["twin"]
    got = {(frozenset(r["antecedent"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    assert got == pytest.approx(want) and len(want) > 3


def test_long_urls(spark):
    """A url of 2,000 tokens, and many rows of one long url: no combination of their tokens is listed."""
    path = "/".join(f"w{k}x" for k in range(2000))
    rows = [(0, f"http://a.test/{path}", "block"), *[(k, f"http://a.test/{path}?q={k}", "block") for k in range(1, 9)], *[(k, f"http://b.test/{k}", "allow") for k in range(9, 40)]]
    frame = spark.createDataFrame([*rows, (41, "http://c.test/w7x", None), (42, None, None), (43, "", None)], "page_id long, url string, verdict string")
    extra = frame.select("page_id", "url", *[F.lit(1).alias(c) for c in ("row", "tokens", "key", "item", "t", "given", "best")])
    got = {r["page_id"]: r["verdict"] for r in urls.judged(extra, frame.select("page_id", "verdict").where("verdict is not null")).collect()}
    assert got == {k: "block" if k < 9 or k == 41 else "allow" for k in [*range(40), 41, 42, 43]}
    assert urls.judged(frame.limit(0), frame.select("page_id", "verdict")).count() == 0


# 9


@pytest.mark.parametrize(("n", "k", "dim"), [(1, 3, 4), (300, 5, 6), (900, 20, 3)])
def test_top_k(spark, monkeypatch, n, k, dim):
    monkeypatch.setattr(topk, "SHARD", 120)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(n)
    v = rng.integers(-3, 4, (n, dim))
    v[n // 2 :] = v[0]  # a hot vector, and ties
    rows = [(int(i), [int(x) for x in r]) for i, r in enumerate(v)] + [(n, None), (n + 1, []), (None, [1] * dim)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    frame = frame.select("*", *[F.lit(7).alias(c) for c in ("shard", "dim", "kind", "id", "floor", "score", "rank")])
    got = topk.nearest(frame, frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k).collect()
    want = []
    for q in range(0, n, 20):
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(n) if i != q))[:k]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_boxes_prune_and_lose_nothing(scale):
    rng = np.random.default_rng(2)
    rows = rng.integers(-500, 500, (6000, 3)).astype(float) * scale
    rows[3000:3100] = rows[0]
    ids = rng.permutation(6000)
    shard, queries = topk.Shard(ids, rows), rng.integers(-500, 500, (50, 3)).astype(float) * scale
    names = np.concatenate((np.arange(25), np.arange(9000, 9025)))
    q, i, s = shard.search(names, queries, np.full(50, -np.inf), 7)
    want = {(int(n), j, x) for n, v in zip(names, queries, strict=True) for x, j in [(-a, int(b)) for a, b in sorted((-int(r @ v), b) for r, b in zip(rows, ids, strict=True) if b != n)[:7]]}
    assert set(zip(q.tolist(), i.tolist(), s.tolist(), strict=True)) == want and len(q) == 350
    assert shard.visited < 0.6 * shard.offered
    kth = np.array([min(x for n, _, x in want if n == name) for name in names], float)
    assert set(zip(*[c.tolist() for c in shard.search(names, queries, kth, 7)], strict=True)) == want


def test_quantised(spark):
    rows = [(1, [0.5, -0.01]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf")])]
    got = {r["vec_id"]: r["v"] for r in topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None}


# 10

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_pii(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 16 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 8 <= len(d) <= 15:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    import random

    rnd = random.Random(3)
    for _ in range(8000):
        t = "".join(rnd.choice("a.b@-+1 2(3)9.@ 0%_é") for _ in range(rnd.randint(0, 150)))
        assert pii.found(t) == brute_pii(t)


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("mail john [at] mail dot example dot com now", "john [at] mail dot example dot com"), ("jane at mail dot example dot com", "jane at mail dot example dot com"),
        ("ｊoe@ｍail.example.com", "ｊoe@ｍail.example.com"), ("call plus one seven two two five five five six nine seven eight now", "plus one seven two two five five five six nine seven eight"),
        ("ip ５５.８０.３２.１４!", "５５.８０.３２.１４"), ("meet me at home dot", None), ("one two three", None), ("look at this dot", None),
    ],
)
def test_disguises(text, span):
    base, every = pii.identify(text)
    assert [text[s:e] for _, s, e in every if (_, s, e) not in base] == ([span] if span else [])


def test_personal_data(docs, empty, clashing, corpus, spark):
    for source in (docs, clashing):
        got = pii.personal_data(source).collect()
        assert len(got) == len(corpus) and all(r["base_sha256"] == hashlib.sha256(pii.joined(brute_pii(text_of(corpus)[r["doc_id"]])).encode()).hexdigest() for r in got)
    assert pii.personal_data(empty).count() == 0
    big = spark.createDataFrame([(1, "1" * 200000 + " " + "a" * 200000 + "@" + "1." * 100000)], "doc_id long, text string")
    assert pii.personal_data(big).count() == 1
