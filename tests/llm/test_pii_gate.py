"""Disguises of personal data: what is rewritten must not depend on the gate or on unrelated words."""

from __future__ import annotations

import random
import time

import pytest

from tracelode.llm import pii


def ungated(text):
    base = pii.found(text)
    return base, sorted(base + pii.undisguised(text, base))


@pytest.mark.parametrize(
    "span",
    [
        "john { at } example.com", "john < at > example.com", "john [ @ ] example.com", "john <@> example.com", "john [  at\t] example.com", "john\n[\nat ] example.com", "john@example { . } com",
        "john <arroba> example < Punkt > com", "plus one, two, three, four, five, six, seven, eight", "plus six. six. six. six. six. six. six. six",
    ],
)
def test_brackets_and_separators(span):
    text = f"to {span}!"
    assert (3, len(text) - 1) in [(s, e) for _, s, e in pii.identify(text)[1]]


def test_gate_agrees_with_the_transducers():
    rnd = random.Random(10)
    pieces = [*"[](){}<>@.,- \t\n+", "  ", " at ", "AT", "at", " dot ", "Dot", "punto", "point", "punkt", "arroba", "john", "example", "com", "é", "ａ", "plus", "ſix", *(w for words in pii.DIGIT_WORDS for w in words), *"0123456789"]
    digits = [w for words in pii.DIGIT_WORDS for w in words] + list("0123456789")
    rewritten = 0
    for k in range(20000):
        if k % 3 == 0:
            sign = lambda names: rnd.choice("[({<") + rnd.choice(["", " ", "  ", "\t", "\n"]) + rnd.choice(names) + rnd.choice(["", " ", "\t "]) + rnd.choice("])}>")
            text = f"x john{rnd.choice(['', ' '])}{sign(['at', '@', 'AT', 'arroba'])} example{rnd.choice(['.', ' dot ', sign(['dot', '.', 'punkt', 'punto', 'point'])])}com y"
        elif k % 3 == 1:
            text = "x " + rnd.choice(["plus ", ""]) + rnd.choice([" ", ", ", ". ", "-", " dot "]).join(rnd.choice(digits) for _ in range(rnd.randint(5, 17))) + rnd.choice(["", " y", "y"])
        else:
            text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25)))
        want = ungated(text)
        assert pii.identify(text) == want, text
        rewritten += want[0] != want[1]
    assert rewritten > 3000


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in (" " * 300000 + "<at>", "one" + " " * 300000 + "<at>", "one, " * 100000, "<" * 300000 + " dot "):
        pii.identify(text)
    assert time.perf_counter() - began < 20
