from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text, lang, source, n_chars): nulls, empty, blank and long texts, exact and near copies, repeats."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 120))) for _ in range(40)]
    long = " ".join(rnd.choice(words) for _ in range(9000))
    near = texts[3].split()
    near[5] = "changedword"
    texts += [None, "", " \n\t ", "one", "two words", texts[0], texts[0], " ".join(near), long, texts[1] + "\n" + texts[2], "ä" * 150 + " " + texts[4]]
    rows = [(k, t, "en" if k % 2 else None, [None, "a", "b", "ä", "c"][k % 5], None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[0]]  # a repeated row


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """Documents with further columns of the names that operators use."""
    names = ["score", "key", "size", "copies", "root", "bucket", "start", "at", "taken", "b"]
    rows = [(*r, *range(len(names))) for r in corpus]
    return spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{n} int" for n in names)).repartition(2)
