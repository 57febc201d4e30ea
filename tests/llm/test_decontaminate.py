"""Decontamination against brute force over all windows."""

from __future__ import annotations

import collections
import random

import pytest

from tracelode.llm import decontaminate

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def shingles(w):
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def brute(docs, items):
    """{(doc_id, item_id): (similarity, at)} of the best and first window at 0.8."""
    out = {}
    for d, text in docs:
        for i, item in items:
            w, x = text.lower().split(), item.lower().split()
            for at in range(max(len(w) - len(x), 0) + 1):
                a, b = shingles(w[at : at + len(x)]), shingles(x)
                common = (a & b).total()
                similarity = common / (a.total() + b.total() - common)
                if similarity >= 0.8 and similarity > out.get((d, i), (0, 0))[0]:
                    out[(d, i)] = similarity, at
    return out


def found(spark, docs, items):
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM))
    return {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["at"]) for r in got.collect()}


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_moved_words(spark, words, monkeypatch, broadcast):
    """Swaps, insertions and deletions, inside longer documents."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(8)
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate((100, 58, 58, 40, 23, 16, 3))]
    texts = []
    for _, item in items:
        w = item.split()
        half = len(w) // 2
        changed = [w, w[half:] + w[:half], [*w[:10], "inserted", *w[10:-2], w[-1]], [*w[: half + 1], "inserted", *w[half + 1 :]], w[1:], [*w[:half], *w[half + 1 :]], [*w[:2], *w[4:], *w[2:4]]]
        for c in changed:
            texts.append(" ".join([rnd.choice(words) for _ in range(rnd.randint(60, 120))] + c + [rnd.choice(words) for _ in range(rnd.randint(60, 120))]))
    docs = list(enumerate(texts))
    want = brute(docs, items)
    assert {(1, 0), (9, 1)} <= set(want)
    assert found(spark, docs, items) == want


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_shorter_documents(spark, words, monkeypatch, broadcast):
    """Items cut short or with words left out, as whole documents."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(9)
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate((40, 59, 16, 27, 6, 4))]
    texts = ["one", "two words", " ".join(words[:4])]
    for _, item in items:
        w = item.split()
        texts += [" ".join(w[lo : len(w) - hi]) for lo in range(0, 8, 2) for hi in range(0, 9) if lo + hi < len(w)]
        texts += [" ".join(w[:k] + w[k + 1 :]) for k in range(len(w))]
    docs = list(enumerate(texts))
    want = brute(docs, items)
    assert any(len(texts[d].split()) == 35 and i == 0 for d, i in want)
    assert found(spark, docs, items) == want


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_repeated_words(spark, words, monkeypatch, broadcast):
    """Copies that break off in repeated tokens, and items with repeated passages: fingerprints say little of them."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(10)
    plain = [rnd.choice(words) for _ in range(100)]
    line = [rnd.choice(words) for _ in range(6)]
    items = [(0, " ".join(plain)), (1, " ".join([*line * 6, *plain[:20]])), (2, "- " * 40 + " ".join(plain[40:50])), (2, "- " * 40 + " ".join(plain[40:50]))]
    around = [rnd.choice(words) for _ in range(30)]
    changed = [
        [*around, *plain[:90], *["-"] * 10, *around], [*plain[:91], *["="] * 9], [*around, *line * 6, *words[:20], *around],
        [*around, *line * 7, *plain[:14], *around], ["-"] * 45, [*["-"] * 39, *plain[40:49], *around], [*["-"] * 40, *plain[40:50]], [*["-"] * 120, *plain[40:50]],
    ]
    docs = [(k, " ".join(c)) for k, c in enumerate(changed)]
    want = brute(docs, items)
    assert {d for d, _ in want} == {0, 1, 5, 6, 7}
    assert found(spark, docs, items) == want


def test_defined_results(spark, words):
    item = " ".join(words[:30])
    docs = [(1, None), (2, ""), (None, item), (3, item + " " + item), (3, "other text"), (3, item + " " + item)]
    items = [(7, item), (7, item), (8, None), (9, " "), (None, item)]
    assert found(spark, docs, items) == {(3, 7): (pytest.approx(1.0), 0)}
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}
