"""Token ids as directly addressable codes.

An id is split into levels of 8 bits. Level 0 holds the low byte of every id, level 1 the next
byte of the ids that have one, and so on; a bitmap per level tells which ids go on, and a rank
directory counts its ones up to every 512th bit. Token ``i`` is read by following ``i`` through
ranks, so any token or range is read without decoding what lies before it.

The file format is a Parquet table of blocks (one row each, payload uncompressed), in ascending
order of document ids: ``part`` and ``seq`` order the blocks, ``first`` is the number of ids before
the block in its part, ``doc_ids`` and ``bounds`` (one more than documents) index its documents,
``payload`` holds the levels. Documents are whole in a block. ``offsets`` adds up the parts.

Payload, all little-endian: u32 ``DAC1``, u32 levels, then per level u64 count, the count bytes
padded to 8, the bitmap in u64 words (bit i is bit i%64 of word i/64), and u64 ones before every
8th word.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import octets, slices
from ledgerloom.llm.lexicon import Lexicon, flat, joined
from ledgerloom.session import shared_folder

MAGIC = 0x31434144
BLOCK = 1 << 18
CACHE = 1_000_000
_DIRECTORY = 8


def pack(ids: np.ndarray) -> bytes:
    """The payload of a block of unsigned 32-bit ids."""
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        flags = np.packbits(more, bitorder="little").tobytes()
        bitmap = np.frombuffer(flags + b"\0" * (-len(flags) % 8), dtype="<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bitmap), dtype=np.int64)))[:len(bitmap):_DIRECTORY]
        low = (rest & 255).astype(np.uint8).tobytes()
        parts += [len(rest).to_bytes(8, "little"), low, b"\0" * (-len(low) % 8), bitmap.tobytes(), ones.astype("<u8").tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            break
    return MAGIC.to_bytes(4, "little") + (len(parts) // 5).to_bytes(4, "little") + b"".join(parts)


class Codes:
    """Random access to a payload."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, dtype="<u4", count=2)
        if head[0] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(head[1]):
            n = int.from_bytes(payload[at:at + 8], "little")
            at += 8
            words = -(-n // 64)
            low = np.frombuffer(payload, np.uint8, n, at)
            at += n + -n % 8
            bitmap = np.frombuffer(payload, "<u8", words, at)
            at += 8 * words
            ones = np.frombuffer(payload, "<u8", -(-words // _DIRECTORY), at)
            at += 8 * len(ones)
            self.levels.append((low, bitmap, ones))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bitmap: np.ndarray, ones: np.ndarray, i: int) -> int:
        """Set bits before bit ``i``."""
        word = i >> 6
        if word >= len(bitmap):
            return Codes._rank(bitmap, ones, i - 1) + (int(bitmap[-1]) >> (i - 1 & 63) & 1) if i else 0
        near = word // _DIRECTORY
        count = int(ones[near]) + int(np.bitwise_count(bitmap[near * _DIRECTORY:word]).sum())
        return count + (int(bitmap[word]) & (1 << (i & 63)) - 1).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bitmap, ones) in enumerate(self.levels):
            value |= int(low[i]) << 8 * k
            if not int(bitmap[i >> 6]) >> (i & 63) & 1:
                return value
            i = self._rank(bitmap, ones, i)
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``."""
        out = np.zeros(stop - start, dtype="<u4")
        place = np.arange(len(out))
        for k, (low, bitmap, ones) in enumerate(self.levels):
            if start >= stop:
                break
            out[place] |= low[start:stop].astype(np.uint32) << np.uint32(8 * k)
            first, last = start >> 6, (stop + 63) >> 6
            bits = np.unpackbits(bitmap[first:last].view(np.uint8), bitorder="little")
            go = np.flatnonzero(bits[start - 64 * first:stop - 64 * first])
            place, start = place[go], self._rank(bitmap, ones, start)
            stop = start + len(go)
        return out


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b",.|!?;:")] = True
# Bytes that surely are no part of white space: ASCII but for white space and separators.
_SOLID = np.ones(256, bool)
_SOLID[[*range(9, 14), *range(28, 33)]] = False


def _solid(buffer: np.ndarray) -> np.ndarray:
    """True where a byte is no part of white space, Unicode's included."""
    solid = _SOLID[buffer]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(buffer[:-2] == lead)
        a, b = buffer[at + 1], buffer[at + 2]
        if lead == 0xC2:
            space = (a == 0x85) | (a == 0xA0)
        elif lead == 0xE1:
            space = (a == 0x9A) & (b == 0x80)
        elif lead == 0xE2:
            space = (a == 0x80) & ((b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF)) | (a == 0x81) & (b == 0x9F)
        else:
            space = (a == 0x80) & (b == 0x80)
        for k in range(2 if lead == 0xC2 else 3):
            solid[at[space] + k] = False
    return solid


def cuts(buffer: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Starts of units: places where a byte-level tokenizer's pattern always starts a new piece.

    That is every text's start; a space before which or after which there is none; a line break
    alone, and what follows it; and a mark after an ASCII letter or digit. ``buffer`` holds the
    texts, each followed by a line break that belongs to none and so cuts on both sides.
    """
    own = np.zeros(len(buffer) + 1, bool)  # the line breaks between texts
    own[text_starts[1:] - 1] = True
    solid = _solid(buffer) if len(buffer) > 2 else _SOLID[buffer]
    before = np.concatenate(([True], solid[:-1])) | np.concatenate(([True], own[:len(buffer) - 1]))
    after = np.concatenate((solid[1:], [False]))
    start = (buffer == 32) & (before | after)
    alone = (buffer == 10) & before & after
    start |= alone
    start[1:] |= alone[:-1]
    start[1:] |= _MARK[buffer[1:]] & _ALNUM[buffer[:-1]]
    own = own[:len(buffer)]
    start |= own
    start[text_starts[:-1]] = True
    return np.flatnonzero(start)


# A unit without line breaks that starts with ASCII but not with white space, save one space.
_PLAIN = re.compile(rb" ?[!-\x7f][^\n]*\Z")


class ByteEncoder:
    """Whole texts to ids of a byte-level tokenizer, by way of the units of ``cuts``.

    The ids of a text are the ids of its units one after another, so the tokenizers library
    is asked only once for a unit that is still held.
    """

    def __init__(self, path: str, special: bool = False, room: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.room = Tokenizer.from_file(path), room
        # Strings of special tokens inside a text are text, unless ``special``.
        self.library.encode_special_tokens = not special
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.line = self._whole(["\n"])[0]
        self._clear()

    def _clear(self) -> None:
        self.lexicon = Lexicon()
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _fill(self) -> None:
        """Ids of the units met since the last call, many to a call of the library.

        A line break in front of a unit without one, and not before white space, is a piece of
        its own, so the breaks tell the units of one call apart.
        """
        new = self.lexicon.words(len(self.starts) - 1)
        plain = [_PLAIN.match(u) is not None for u in new]
        found: list = [None] * len(new)
        for at in range(0, len(new), 4096):
            mine = [k for k in range(at, min(at + 4096, len(new))) if plain[k]]
            ids = np.array(self._whole(["".join("\n" + new[k].decode("utf-8", "replace") for k in mine)])[0], dtype=np.uint32)
            place = [*np.flatnonzero(ids == self.line[0]).tolist(), len(ids)]
            if len(place) != len(mine) + 1:  # the vocabulary merges breaks with what follows: each unit by itself
                for k in mine:
                    plain[k] = False
                continue
            for k, a, b in zip(mine, place, place[1:]):
                found[k] = ids[a + 1:b]
        rest = [k for k in range(len(new)) if not plain[k]]
        for k, ids in zip(rest, self._whole([new[k].decode("utf-8", "replace") for k in rest])):
            found[k] = np.array(ids, dtype=np.uint32)
        if new:
            ends = self.starts[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)
            self.starts = np.concatenate((self.starts, ends))
            self.ids = np.concatenate([self.ids, *found])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.lexicon) > self.room:
            self._clear()
        odd = {k: t for k, t in enumerate(texts) if any(s in t for s in self.special)}
        buffer, ends = joined([b"" if k in odd else t for k, t in enumerate(texts)])
        if not len(buffer):
            return []
        bounds = np.concatenate(([0], ends))
        starts = cuts(buffer, bounds)
        stops = np.append(starts[1:], len(buffer))
        # The line break after a text is a unit of its own; an empty text is that alone.
        inside = ~_member(stops, ends, len(buffer))
        starts, stops = starts[inside], stops[inside]
        mine = self.lexicon.index(buffer, starts, stops)
        self._fill()
        sizes = self.starts[mine + 1] - self.starts[mine]
        ids = self.ids[flat(self.starts[mine], sizes)]
        before = np.concatenate(([0], np.cumsum(sizes)))
        edge = before[np.searchsorted(starts, bounds)]
        out = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        for k, found in zip(odd, self._whole([t.decode("utf-8", "replace") for t in odd.values()])):
            out[k] = np.array(found, dtype=np.uint32)
        return out


def _member(values: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    mark = np.zeros(size + 1, bool)
    mark[places] = True
    return mark[values]


_ENCODERS: dict[tuple[str, bool], ByteEncoder] = {}


def encoder(path: str, special: bool = False) -> ByteEncoder:
    """One encoder for a Python worker, so that tasks share its units."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = ByteEncoder(path, special)
    return _ENCODERS[path, special]


_BLOCKS = "part int, seq int, first long, n_ids long, doc_ids array<long>, bounds array<long>, payload binary"


def write_codes(
    docs: DataFrame, path: str, tokenizer: str, end: int | None = 0, doc_id: str = "doc_id",
    text: str = "text", special: bool = False, block: int = BLOCK,
) -> None:
    """Encode whole texts, append ``end`` to each, and write the files in order of ``doc_id``.

    A null text is empty; null ids come first; rows of one id follow one another, each with an
    index entry. An empty table gives files without blocks. Only ids are kept, no other column.
    """
    row = F.monotonically_increasing_id()  # tells rows of one id apart, so that they can be dealt out
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row.alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, tail = TaskContext.get().partitionId(), encoder(tokenizer, special), [] if end is None else [end]
        seq, first, names, held, size = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in held])))
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "first": first, "n_ids": len(ids), "doc_ids": names,
                "bounds": bounds.tolist(), "payload": pack(ids)}], schema=schema)

        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                for name, ids in zip(cut.column("doc_id").to_pylist(), own(octets(cut.column("text")))):
                    names.append(name)
                    held.append(np.concatenate((ids, np.array(tail, dtype=np.uint32))))
                    size += len(held[-1])
                    if size >= block:
                        yield flush()
                        seq, first, names, held, size = seq + 1, first + size, [], [], 0
        if names:
            yield flush()

    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())), ("payload", pa.binary())])
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(path)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part: one short row per part."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    ``start`` counts the ids of all documents before it; the checksum is over its ids as
    little-endian unsigned 32-bit integers, each document read by its own range.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in ("part", "first", "doc_ids", "bounds", "payload")}
                codes, bounds = Codes(one["payload"]), one["bounds"]
                spans = list(zip(bounds, bounds[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([one["part"]] * len(spans), pa.int32()), pa.array(one["doc_ids"], pa.int64()),
                    pa.array([one["first"] + a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([zlib.crc32(codes.range(a, b).tobytes()) for a, b in spans], pa.int64()),
                ], names=["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(_BLOCKS).parquet(path)
    docs = blocks.mapInArrow(run, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(offsets(spark, path), "part").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """Write the files to the shared folder and read every document back from them.

    With ``special`` ids are those of the library as loaded: strings of added tokens are those tokens.
    """
    path = shared_folder(docs.sparkSession, "codes")
    write_codes(docs, path, tokenizer, 0, doc_id, text, special)
    return read_codes(docs.sparkSession, path)
