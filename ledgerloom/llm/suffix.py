"""Benchmark decontamination with a generalised suffix automaton over the items' words.

The items of a block are read into one automaton whose edges are word numbers. A document's
words are streamed through it; at each word the state tells the longest run of words, ending
there, that some item holds. A window is ``window`` consecutive item words (an item of fewer is
one window); every document word inside an occurrence of a window is hit.

The automaton of a block is bounded by ``block_words`` and handed to the tasks with their code.
More items than that make several blocks, each streamed over the documents, and the spans of
one document are put together by its row number.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import octets, slices, staged, with_columns

WINDOW = 13
BLOCK_WORDS = 100_000
# Lower-case A-Z; every other ASCII byte that is no digit and no letter separates words.
_TABLE = bytes(
    b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences, and the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # Window lengths in use, and by (length, state) the items of which that run is a window.
        self.sizes = sorted({min(window, len(codes)) for _, codes in coded})
        self.owners: dict[tuple[int, int], set] = {}
        pairs = set()
        for item, codes in coded:
            size = min(window, len(codes))
            for at, (state, _) in enumerate(self.walk(codes)):
                if at + 1 >= size:
                    self.owners.setdefault((size, self.holder(state, size)), set()).add(item)
            pairs.update(a * len(self.number) + b for a, b in zip(codes, codes[1:]))
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.owners = {k: frozenset(v) for k, v in self.owners.items()}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def walk(self, codes) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word; an unknown word is -1."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for c in codes:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = size = 0
            else:
                state, size = to, size + 1
            yield state, size

    def holder(self, state: int, size: int) -> int:
        """The state whose runs include the last ``size`` words of a longer match in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def matches(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words (from, to) of one document, and the items found.

        Only stretches in which each two neighbours are neighbours in some item, as long as the
        shortest window, are walked: no other place can hold a window.
        """
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not self.sizes or len(text) < self.sizes[0]:
            return spans, found
        get = self.number.get
        codes = np.fromiter((get(w, -1) for w in text), dtype=np.int64, count=len(text))
        joined = (codes[:-1] >= 0) & (codes[1:] >= 0)
        if self.sizes[0] > 1:
            if not len(self.pairs):
                return spans, found
            key = codes[:-1] * len(self.number) + codes[1:]
            place = np.minimum(np.searchsorted(self.pairs, key[joined]), len(self.pairs) - 1)
            joined[joined] = self.pairs[place] == key[joined]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        stretches = [(a, b + 1) for a, b in zip(edge[::2], edge[1::2]) if b + 1 - a >= self.sizes[0]]
        if self.sizes[0] == 1:
            stretches = sorted(stretches + [(k, k + 1) for k in np.flatnonzero(codes >= 0)])
        held, done = {}, 0
        for a, b in stretches:
            if b <= done:
                continue
            done = b
            for at, (state, size) in enumerate(self.walk(codes[a:b].tolist()), a + 1):
                for k in self.sizes[:bisect_right(self.sizes, size)]:
                    place = held.get((k, state))
                    if place is None:
                        place = held[k, state] = self.holder(state, k)
                    if own := self.owners.get((k, place)):
                        found |= own
                        if spans and at - k <= spans[-1][1]:
                            while spans and at - k <= spans[-1][1]:
                                k = max(k, at - spans.pop()[0])
                        spans.append((int(at - k), int(at)))
        return spans, found


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Distinct items as word lists, in blocks of about ``limit`` words; the driver holds one."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL").distinct()
    block, size = [], 0
    for row in rows.orderBy("i", "t").toLocalIterator():
        found = item_words(row.t.encode())
        if size and size + len(found) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, found))
        size += len(found)
    yield block


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
_FIELDS = {"n_words": T.LongType(), "spans": _SPANS, "items": T.ArrayType(T.StringType())}


def _matched(docs: DataFrame, block, window: int, text: str, prefix: str, longest: int | None = None) -> DataFrame:
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
    new = [T.StructField(prefix + n, t) for n, t in _FIELDS.items()]
    fields = [f for f in docs.schema.fields if f.name not in [x.name for x in new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for batch in batches:
            for part in slices(batch, text):
                rows = [item_words(t) for t in octets(part.column(text))]
                found = [own.matches(ws) for ws in rows]
                if longest is not None:  # in the same worker, for a second one would hold its own memory
                    part = _cut_batch(part, text, [spans for spans, _ in found], longest)
                yield with_columns(part, **{
                    prefix + "n_words": pa.array(map(len, rows), pa.int64()),
                    prefix + "spans": pa.array(
                        [[list(s) for s in spans] for spans, _ in found], pa.list_(pa.list_(pa.int32()))),
                    prefix + "items": pa.array(
                        [sorted(str(i) for i in items if i is not None) for _, items in found], pa.list_(pa.string())),
                })

    return docs.mapInArrow(run, T.StructType([*fields, *new]))


def _merged(lists) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(tuple(s) for one in lists for s in one):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, prefix: str = "", longest: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``spans`` of hit words and ``items`` found.

    With ``longest``, texts come without their spans of so many words or more; counts and spans are of the
    whole texts.

    Spans are [from, to) in word numbers, merged and ascending; item ids are strings, sorted.
    A null or empty text has no words and no spans; items without words have no windows; equal
    items are all found; an item without an id hits words but is not listed. No items: no spans.
    Columns of ``docs`` named like one of the three (``prefix`` goes before their names) are replaced.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _matched(docs, block, window, text, prefix, longest)
    # Spans of each block, by the row number of a staged copy; only documents with hits shuffle.
    count, spans, items = (prefix + n for n in _FIELDS)
    names = [c for c in docs.columns if c not in (count, spans, items)]
    rows = staged(docs.select(*names).withColumn("__row", F.monotonically_increasing_id()), "benchmark-docs")
    hits = None
    while block is not None:
        one = _matched(rows.select("__row", text), block, window, text, prefix)
        one = one.filter(F.size(spans) > 0).select("__row", spans, items)
        hits = one if hits is None else hits.unionByName(one)
        block, following = following, next(blocks, None)
    hits = hits.groupBy("__row").agg(
        F.collect_list(spans).alias("lists"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    hits = hits.select("__row", F.udf(_merged, _SPANS, useArrow=True)("lists").alias(spans), items)
    counted = _matched(rows, [], window, text, prefix).drop(spans, items)
    none = [F.coalesce(c, F.array().cast(_FIELDS[n])).alias(c) for c, n in ((spans, "spans"), (items, "items"))]
    found = counted.join(hits, "__row", "left").select(*names, count, *none)
    if longest is None:
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield _cut_batch(part, text, part.column(spans).to_pylist(), longest)

    return found.mapInArrow(run, found.schema)


def hit_words(prefix: str = "") -> Column:
    """Number of words in ``spans``."""
    return F.aggregate(prefix + "spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))


def contaminated(coverage: int = 20, prefix: str = "") -> Column:
    """One word in ``coverage`` is hit, or more, and one at all."""
    hit = hit_words(prefix)
    return (hit > 0) & (hit * coverage >= F.col(prefix + "n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, a digest of the items found, and the verdict."""
    found = match_benchmark(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


# Words of a text in its own case: what ``item_words`` finds, by character.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _cut(text: str | None, spans: list, longest: int) -> str | None:
    """The text without its spans of ``longest`` words or more."""
    spans = [s for s in spans or [] if s[1] - s[0] >= longest]
    if text is None or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def _cut_batch(part: pa.RecordBatch, text: str, spans: list[list], longest: int) -> pa.RecordBatch:
    """The batch with its texts cut; only those with such a span are touched."""
    rows = [k for k, own in enumerate(spans) if any(b - a >= longest for a, b in own)]
    if not rows:
        return part
    column = part.column(text)
    texts = column.to_pylist()
    for k in rows:
        texts[k] = _cut(texts[k], spans[k], longest)
    return part.set_column(part.schema.get_field_index(text), text, pa.array(texts, column.type))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: int = 20, longest: int | None = None,
) -> DataFrame:
    """The documents kept, with their columns and no others: the contaminated ones go.

    A document goes when one word in ``coverage`` or more is hit. With ``longest``, spans of so
    many words or more are cut out of the documents that stay; without it their texts stay
    whole. A document without words stays; so does every row of an id that occurs again.
    """
    kept = match_benchmark(docs, benchmark, text, prefix="__", longest=longest).filter(~contaminated(coverage, "__"))
    return kept.select(*docs.columns)
