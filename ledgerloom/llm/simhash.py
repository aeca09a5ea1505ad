"""SimHash near-duplicates through covering locality-sensitive hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its
word shingles. Fingerprints link at ``radius`` or fewer differing bits, and documents fall into
the connected components of those links.

Candidates come from a covering family of masks. Bit ``i`` gets a vector ``m(i)`` of
``radius + 1`` bits; the mask of a nonzero vector ``v`` keeps the bits with an odd ``m(i) & v``.
Up to ``radius`` differing bits give as many vectors, so some ``v`` is orthogonal to all of
them, and the pair agrees in that mask: every link is found in some table, none by luck.

A bucket of one table may hold any number of fingerprints. Small ones are compared inside a
task, which emits a spanning forest of the links, never all pairs. Larger ones are dealt out
again by the same construction over the bits their mask left free; that halves the free bits,
so after three levels a bucket cannot hold more than ``2 ** 8`` distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import octets, slices, staged, with_columns, words

BITS = 64
BUCKET = 512
_HASHES = 1 << 16


def fingerprint(text: bytes, size: int) -> int:
    """Signed 64-bit fingerprint of one text (see the module); no words give zero."""
    tokens = words(text)
    if not tokens:
        return 0
    join, digest = b" ".join, xxhash.xxh64_digest
    if len(tokens) <= size:
        hashes = [digest(join(tokens), 42)]
    else:
        hashes = [digest(join(s), 42) for s in zip(*(tokens[k:] for k in range(size)))]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _HASHES):
        part = np.frombuffer(b"".join(hashes[at:at + _HASHES]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 3, name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a long; a column of that name is replaced."""
    fields = [f for f in docs.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = [fingerprint(t, size) for t in octets(part.column(text))]
                yield with_columns(part, **{name: pa.array(found, pa.int64())})

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.LongType())]))


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the set bits of ``free``: any ``radius`` of those bits are outside one mask."""
    places = [i for i in range(BITS) if free >> i & 1]
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << p for k, p in enumerate(places) if ((k % vectors + 1) & v).bit_count() & 1)
        for v in range(1, vectors + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a breadth-first forest over the links among distinct fingerprints."""
    left, edges = members.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(left ^ u) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(u), int(v)) for v in found]
                queue.extend(found)
    return edges


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            values, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            edges = [e for a, b in zip(offsets[:-1], offsets[1:]) for e in _forest(values[a:b], radius)]
            pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["u", "v"])

    return run


def links(prints: DataFrame, radius: int = 3, limit: int = BUCKET) -> DataFrame:
    """Distinct edges ``u > v`` whose components are those of all links.

    ``prints``: one long column ``fp``, distinct. ``limit`` (256 at least) only says how large a
    bucket one task compares; larger ones go to the next level, so it changes no result.
    """
    every = (1 << BITS) - 1
    level = [(0, 0)]  # for each table: its number and the bits that its key holds
    source, edges = prints.select(F.lit(0).alias("table"), "fp"), None
    while True:
        made: list[tuple[int, int]] = []
        keyed = []
        for number, held in level:
            for mask in covering_masks(every & ~held, radius):
                made.append((len(made), held | mask))
                keyed.append((number, made[-1]))
        of_table = {
            number: F.array(*[
                F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                for n, (t, m) in keyed if n == number
            ]) for number, _ in level
        }
        choice = None
        for number, tables in of_table.items():
            when = F.col("table") == number
            choice = F.when(when, tables) if choice is None else choice.when(when, tables)
        rows = source.select("fp", F.explode(choice).alias("b")).select("b.table", "b.key", "fp")
        counts = rows.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
        known = staged(rows.join(counts, ["table", "key"]), "simhash-buckets")
        small = (
            known.filter(F.col("n") <= limit).groupBy("table", "key")
            .agg(F.collect_list("fp").alias("members")).select("members")
        )
        found = small.mapInArrow(_bucket_edges(radius), "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        source = known.filter(F.col("n") > limit).select("table", "fp")
        largest = sorted({r.table for r in source.select("table").distinct().collect()})
        if not largest:
            return edges.distinct()
        # A table number is one of 15, 225 or 3375: what the driver sees here is bounded.
        level = [made[t] for t in largest]


def star_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges``: longs ``u``, ``v``. Returns ``v``, ``root`` for every node but the roots, where
    the root is the smallest node. Each round is written out and read back.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = staged(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = staged(small.filter("u <> v").distinct(), label)
        if (after := state(now)) == seen:
            break
        seen = after
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _component_of(prints: DataFrame, radius: int) -> DataFrame:
    """``prints``: distinct ``fp`` with an orderable ``first``. Adds the component's least ``first``."""
    roots = star_components(links(prints.select("fp"), radius), "simhash-components")
    rooted = prints.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.join(least, "root").select("fp", "component")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id in the row's component, its own included. A null text
    is empty; texts without words share the fingerprint zero and are linked like any other.
    Rows of one id are rows like any other; a null id is never a component's smallest id unless
    the component has no other. An empty table gives no rows. Other columns are not read.
    """
    rows = staged(with_fingerprints(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", size, "fp"
    ).select("doc_id", "fp"), "simhash")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    return rows.join(_component_of(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """One row of every component: the smallest id's first row, with all columns as they were.

    Row numbers come from the staged copy, so that repeated rows and ids are told apart. An id
    that is null ranks last.
    """
    row, prints_name = "__row", "__fp"
    rows = staged(with_fingerprints(docs, text, size, prints_name).withColumn(
        row, F.monotonically_increasing_id()), "simhash-docs")
    rank = F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.col(row).alias("c"))
    prints = staged(rows.groupBy(F.col(prints_name).alias("fp")).agg(F.min(rank).alias("first")), "simhash-prints")
    keep = _component_of(prints, radius).select(F.col("component.c").alias(row)).distinct()
    return rows.join(keep, row, "left_semi").select(*docs.columns)
