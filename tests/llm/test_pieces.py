"""The two forms of op5's agenda, and empty texts."""

from __future__ import annotations

import random

import pytest

from ledgerloom.llm import pieces
from ledgerloom.llm.queries import PIECE_BPE, vocabulary


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(vocabulary(PIECE_BPE))


def _units(n):
    draw = random.Random(5)
    letters = ["a", "e", "t", "h", "n", "s", "0", "1", "ß", "é", "語", "😀", "\x00", "\t", pieces.SPACE, "."]
    return ["".join(draw.choices(letters, k=draw.randrange(0, 60))) for _ in range(n)] + ["a" * 31, "a" * 33, "", "t"]


def test_list_and_heap_merge_alike(own):
    for unit in _units(3000):
        assert own._short(unit) == [s for s in own._long(unit) if s]


def test_short_units_need_no_heap(own, monkeypatch):
    monkeypatch.setattr(pieces.heapq, "heapify", lambda _: pytest.fail("a heap for a short unit"))
    text = "the cat sat, 12 times; über alles 語"
    assert own.encode([text]) == [own.library.encode(text)]


def test_empty_texts_between_others(own):
    texts = ["", "a", "", " a  b\n\nc, d", "\n", "▁x ▁", "", "the end ", ""]
    assert own.encode(texts) == [own.library.encode(t) for t in texts]
    assert own.encode(["", ""]) == [[], []]
