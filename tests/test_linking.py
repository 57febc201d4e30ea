"""Links and tokens against brute force by the reference's rules."""

from __future__ import annotations

import re

from tracelode.functions.text import STOPWORDS
from tracelode.plans import catalogue


def run(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return catalogue.queries()[name](spark, str(tmp_path)).collect()


def test_short_and_punctuated_terms(spark, tmp_path):
    terms = ["TimeoutError", "disk full", "that and more words", "out of memory,", '"quoted start of', "--", "a\\Eb", "größe", "", None, "full"]
    texts = ["a TimeoutError was seen here", "MyTimeoutErrors here again", 'he said ("That and more words")', "it ran out of memory, then died", "xx disk full.", 'so "quoted start of it', "x -- y", "see a\\eb now", "die Größe ist da", "die Größen sind da", "disk", "", None, "disk fuller"]
    got = run(spark, tmp_path, "error_linker", documents=(list(enumerate(texts)), "doc_id long, text string"), benchmark=(list(enumerate(terms)), "item_id long, text string"))
    edge = lambda c, mark: mark if re.match(r"\w", c) else ""
    want = [(d, i) for d, x in enumerate(texts) for i, t in enumerate(terms) if x and t and re.search(edge(t[0], r"(?<!\w)") + re.escape(t) + edge(t[-1], r"(?!\w)"), x, re.I)]
    assert sorted(map(tuple, got)) == want and {(0, 0), (2, 2), (3, 3), (4, 1), (5, 4), (6, 5)} <= set(want)


def test_tokens_of_all_documents(spark, tmp_path):
    texts = [("die Prüfung parseHTTPHeader und", "de"), ("plain words the words", "en"), ("el niño año_2 snake_case", "es"), ("été 1abc abc", None), ("", "en"), (None, "en")]

    def tokens(text):
        out = set()
        for word in re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b", text or ""):
            for part in re.split(r"[_\-\s]+", word):
                out |= {s.lower() for s in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", part) if len(s) > 2 and s.lower() not in STOPWORDS}
        return len(out)

    got = run(spark, tmp_path, "text_tokens", documents=([(k, *t) for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    assert sorted(map(tuple, got)) == [(k, tokens(t)) for k, (t, _) in enumerate(texts)]


def test_all_references_of_a_turn(spark, tmp_path):
    long = "x" * 200 + " resolves #9"
    rows = [(7, 0, "user", "closes #12, fixes #13"), (8, 0, "user", long), (8, 1, "assistant", "closes #1"), (9, 0, "user", None)]
    got = run(spark, tmp_path, "closing_refs", conversations=(rows, "conv_id long, turn int, role string, text string"))
    assert sorted(map(tuple, got)) == [(7, 0, "12,13,2,7", 21), (8, 0, "9,2,8", len(long)), (9, 0, "2,9", 0)]
