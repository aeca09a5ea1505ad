"""Encoding and decoding with a merge-type (BPE) sentencepiece vocabulary.

Pairs of adjacent symbols whose join is a piece wait in an agenda ordered by score, then by
place. The best pair is merged, its new neighbours are added, and pairs whose symbols changed
meanwhile are passed over. Symbols that are no piece become bytes.

A text falls into units no piece can cross (see ``Pieces.cuts``), so each worker keeps the ids
of the units it has met. All units that are new in an Arrow batch are also encoded by the
sentencepiece library, and a difference stops the job. Decoding is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from math import inf
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import octets, slices
from ledgerloom.llm.lexicon import Lexicon, flat

SPACE = "▁"
CACHE = 600_000
# Letters of a unit up to which looking through its pairs beats a heap of them.
SHORT = 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Pieces:
    """A vocabulary read through the sentencepiece library; holds the ids of units met."""

    def __init__(self, path: str, room: int = CACHE):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.room = room
        special = (lib.is_control, lib.is_unknown, lib.is_byte)
        every = range(lib.get_piece_size())
        self.scores = {lib.id_to_piece(i): (-lib.get_score(i), i) for i in every if not any(f(i) for f in special)}
        self.ranks = {p: rank for p, (rank, _) in self.scores.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.scores):
            raise ValueError("pieces that cross words or lines are not provided for")
        if not lib.is_byte(self.bytes[0]) or lib.encode("  a ") != self.agenda(SPACE * 3 + "a") + self.agenda(SPACE):
            raise ValueError("a vocabulary with byte fallback that keeps every space is needed")
        joined = {b for p in self.scores for a, b in zip(p, p[1:]) if _ALNUM[min(ord(a), 255)]}
        self.mark = np.zeros(256, bool)
        self.mark[[ord(m) for m in ",.|!?;:" if m not in joined]] = True
        self.lead = len(lib.encode("\n"))
        self._clear()

    def _clear(self) -> None:
        self.lexicon = Lexicon()
        self.ids, self.id_starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.decimals, self.decimal_starts = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def agenda(self, unit: str) -> list[int]:
        """Ids of one unit, by merging in order of score."""
        symbols = self._short(unit) if len(unit) <= SHORT else self._long(unit)
        ids: list[int] = []
        for s in symbols:
            if s:
                found = self.scores.get(s)
                ids += [found[1]] if found else [self.bytes[b] for b in s.encode()]
        return ids

    def _short(self, unit: str) -> list[str]:
        """Symbols of a unit of few letters: the agenda is a list by place, looked through for the best."""
        known, symbols = self.ranks.get, list(unit)
        waiting = [known(pair, inf) for pair in map(add, symbols, symbols[1:])]
        while waiting and (best := min(waiting)) < inf:
            k = waiting.index(best)
            del waiting[k]
            symbols[k] += symbols.pop(k + 1)
            if k:
                waiting[k - 1] = known(symbols[k - 1] + symbols[k], inf)
            if k < len(waiting):
                waiting[k] = known(symbols[k] + symbols[k + 1], inf)
        return symbols

    def _long(self, unit: str) -> list[str]:
        """Symbols of a unit of any length, "" where one was merged: the agenda is a heap."""
        scores, symbols = self.scores, list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = []
        for k in range(n - 1):
            if (found := scores.get(symbols[k] + symbols[k + 1])) is not None:
                waiting.append((found[0], k, k + 1, symbols[k] + symbols[k + 1]))
        heapq.heapify(waiting)
        while waiting:
            _, a, b, piece = heapq.heappop(waiting)
            if not symbols[a] or not symbols[b] or after[a] != b or len(symbols[a]) + len(symbols[b]) != len(piece):
                continue
            symbols[a], symbols[b] = piece, ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                joined = piece + symbols[c]
                if (found := scores.get(joined)) is not None:
                    heapq.heappush(waiting, (found[0], a, c, joined))
            if (p := before[a]) >= 0:
                joined = symbols[p] + piece
                if (found := scores.get(joined)) is not None:
                    heapq.heappush(waiting, (found[0], p, a, joined))
        return symbols

    def cuts(self, buffer: np.ndarray) -> np.ndarray:
        """Places in UTF-8 text between units.

        They are before a run of spaces, around line breaks, and before a mark that follows an
        ASCII letter or digit, if it does so in no piece.
        """
        space = buffer == 32
        sign = np.flatnonzero(buffer[:-2] == 0xE2)  # the space sign itself, E2 96 81, is a space too
        sign = sign[(buffer[sign + 1] == 0x96) & (buffer[sign + 2] == 0x81)]
        first = space.copy()
        first[sign] = True
        last = space
        last[sign + 2] = True
        line = buffer == 10
        cut = first
        cut[1:] &= ~last[:-1]
        cut |= line
        cut[1:] |= line[:-1]
        cut[1:] |= self.mark[buffer[1:]] & _ALNUM[buffer[:-1]]
        return np.flatnonzero(cut)

    def learn(self) -> None:
        """Encode the units that are new, and compare them with the library's ids."""
        new = [u.decode("utf-8", "replace") for u in self.lexicon.words(len(self.id_starts) - 1)]
        if not new:
            return
        found = [self.agenda(u.replace(" ", SPACE)) for u in new]
        theirs = self.library.encode(["\n" + u for u in new], num_threads=1)
        for unit, mine, other in zip(new, found, theirs):
            if mine != other[self.lead:]:
                raise AssertionError(f"{unit!r} is {mine} here and {other[self.lead:]} in the library")
        decimals = [("%d," * len(x) % tuple(x)).encode() for x in found]
        ends = self.id_starts[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)
        self.id_starts = np.concatenate((self.id_starts, ends))
        self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], dtype=np.int32)))
        ends = self.decimal_starts[-1] + np.cumsum([len(x) for x in decimals], dtype=np.int64)
        self.decimal_starts = np.concatenate((self.decimal_starts, ends))
        self.decimals = np.concatenate((self.decimals, np.frombuffer(b"".join(decimals), np.uint8)))

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its ids, and the ids in decimal with commas between."""
        if len(self.lexicon) > self.room:
            self._clear()
        # The library puts a space in front of a text that is not empty.
        buffer = np.frombuffer(b"".join(b" %b\n" % t if t else b"\n" for t in texts), np.uint8)
        if not len(buffer):
            return
        ends = np.cumsum([len(t) + 1 + bool(t) for t in texts], dtype=np.int64)
        bounds = np.concatenate(([0], ends))
        cut = np.zeros(len(buffer), bool)
        cut[self.cuts(buffer)] = True
        cut[bounds[:-1]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(buffer))
        own = np.zeros(len(buffer) + 1, bool)  # the line break after each text belongs to none
        own[ends] = True
        starts, stops = starts[~own[stops]], stops[~own[stops]]
        units = self.lexicon.index(buffer, starts, stops)
        self.learn()
        edge = np.searchsorted(starts, bounds)
        both = []
        for values, at in ((self.ids, self.id_starts), (self.decimals, self.decimal_starts)):
            sizes = at[units + 1] - at[units]
            before = np.concatenate(([0], np.cumsum(sizes)))
            both.append((values[flat(at[units], sizes)], before[edge].tolist()))
        (ids, a), (decimals, b) = both
        for k in range(len(texts)):
            yield ids[a[k]:a[k + 1]], decimals[b[k]:max(b[k], b[k + 1] - 1)].tobytes()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids, _ in self([t.encode() for t in texts])]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_HELD: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, room: int = CACHE) -> Pieces:
    """One vocabulary for a Python worker, so that tasks share its units, ``room`` at most."""
    if (path, room) not in _HELD:
        _HELD[path, room] = Pieces(path, room)
    return _HELD[path, room]


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row; a null text is empty and has no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = pa.array([i for i, _ in own(octets(part.column("text")))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``doc_id`` and the text of the library's ``decode`` for every row; null ids decode to ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            out = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", text])

    rows = encoded.select("doc_id", F.col(ids).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {text} string")


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", room: int = CACHE) -> DataFrame:
    """Encode, decode again, and return counts and digests, one row for every row of ``docs``.

    ``n_tokens`` counts all ids, ``ids_sha256`` is over the decimal ids joined by commas and
    ``decoded_sha256`` over the decoded text. A null or empty text has no ids and decodes to
    ''. Equal rows give equal rows; an empty table gives none; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = pieces(model, room), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                counts, ids, texts = [], [], []
                for mine, decimals in own(octets(part.column("text"))):
                    counts.append(len(mine))
                    ids.append(sha(decimals))
                    texts.append(sha(own.decode(mine.tolist()).encode()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
