"""Repeated passages against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import linehash

PASSAGE = ("The river rose before dawn, and the lower road was gone by noon; nobody had moved the carts. "
           "What the water left was mud, a broken gate, and the smell of the tannery upstream. They counted the sheep twice: "
           "eleven were missing. By evening the miller came down with ropes, lamps and two of his sons.")


def marks_of(text: str) -> list[tuple[int, str]]:
    """Units by walking over the characters, with their places."""
    out, start = [], 0
    for i, c in enumerate(text):
        ends = c in linehash.MARKS + "\n"
        if ends and (i + 1 == len(text) or text[i + 1] not in linehash.MARKS + "\n") or i + 1 == len(text):
            out.append((start, text[start:i + 1]))
            start = i + 1
    return out


def by_hand(docs, least=linehash.PASSAGE_WORDS):
    units, order = {}, []
    for name, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        own = []
        for start, part in marks_of(text or ""):
            plain = " ".join(x for x in re.split(r"[ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), part)) if x)
            if plain:
                own.append((start, part, hashlib.md5(plain.encode()).hexdigest().upper(), max(plain.count(" ") + 1, len(part) // 8)))
        units[name, text] = own
        order.append((name, text))
    first = {}
    for key in order:
        for k, u in enumerate(units[key]):
            first.setdefault(u[2], (key, k))
    out = []
    for key in order:
        run = []
        for k, u in enumerate([*units[key], None]):
            if u is not None and first[u[2]][0] != key:
                run.append((k, u))
                continue
            total = sum(x[3] for _, x in run)
            if total >= least:
                out += [(key[0], j, x[0], len(x[1]), x[2], first[x[2]][0][0], first[x[2]][1], run[0][0], total) for j, x in run]
            run = []
    return out


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit("c") for c in ("copy", "unit", "digest", "keep", "salt", "run", "island", "n", "start")}).repartition(3)


DOCS = [
    (1, PASSAGE), (2, "Some words of its own. " + PASSAGE + " And an end."), (3, PASSAGE.replace("eleven", "twelve")), (4, PASSAGE.upper().replace(" ", "  ")),
    (5, PASSAGE[:120]), (6, None), (7, ""), (8, " \n\t\n"), (None, "no id, " + PASSAGE), (9, "x" * 100_000), (10, "x" * 100_000), (11, "word " * 50_000),
    (12, "Yes. No. Yes. Thanks."), (13, "Yes. Thanks. Bye."), (14, "repeat me, please.\n" * 40), (15, "...!?\n;;, " + PASSAGE), (2, PASSAGE + " Another text of one id."),
    (1, PASSAGE), (-4, "日本語の長い行です。" * 40), (16, "前置き。" + "日本語の長い行です。" * 40), (17, "\n".join(PASSAGE.split(". "))), (18, PASSAGE + "\n" + PASSAGE),
]


@pytest.mark.parametrize("least", [1, 10, linehash.PASSAGE_WORDS, 200])
def test_passages_equal_brute_force(spark, least):
    docs = frame(spark, DOCS)
    got = linehash.repeated_passages(docs, words=least)
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(DOCS, least))
    assert linehash.repeated_passages(docs.limit(0)).collect() == []


def test_passages_of_many_documents_and_a_common_unit(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    shared = [" ".join(rng.choices(words, k=rng.randint(3, 25))) + rng.choice(".,;:!") for _ in range(60)]
    docs = [(k, " ".join(["As everyone knows,", *(rng.choice(shared) if rng.random() < .5 else " ".join(rng.choices(words, k=9)) + "." for _ in range(12))])) for k in range(400)]
    got = linehash.repeated_passages(frame(spark, docs))
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(docs))


def test_texts_lose_the_passages_and_nothing_else(spark):
    docs = frame(spark, DOCS)
    out = linehash.passage_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    left = Counter((r.doc_id, r.text) for r in out.collect())
    gone = {}
    for name, _, start, size, *_ in by_hand([d for d in DOCS if d[0] != 2]):
        gone.setdefault(name, []).append((start, size))
    for name, text in DOCS:
        if name in (2, None):
            continue
        want = text
        for start, size in sorted(gone.get(name, []), reverse=True):
            want = want[:start] + want[start + size:]
        assert left[name, want] == sum(d == (name, text) for d in DOCS), name
    assert left[None, "no id, " + PASSAGE] == 1 and left[2, " Another text of one id."] + left[2, "Some words of its own. And an end."] >= 1
