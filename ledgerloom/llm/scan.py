"""Nearest neighbours by cosine with an adaptive dimension scan over probed lists.

Vectors are brought to length one and turned by a random rotation, and dealt to the list of
their nearest centroid. A query probes the lists nearest to it. Within a list, vectors lie in
blocks of columns. After each block a candidate's partial squared distance, scaled up to all
dimensions, is an estimate; a test on it drops the candidates that are farther than the best
ones found so far with near certainty (Gao and Long, SIGMOD 2023). What is left gets the cosine
of the original vectors in double precision.

Centroids are fitted on at most ``FIT_ROWS`` vectors, drawn by a hash of their row numbers; every
vector is dealt to a list. A list of more than ``BLOCK_ROWS`` vectors is split into blocks by a hash
of the row numbers. The index moves once: queries travel to the blocks that they probe, and a task
holds one block while they stream past. Equal query vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import against_blocks
from ledgerloom.llm.common import staged

FIT_ROWS = 20_000
BLOCK_ROWS = 4096
COLUMNS = 16
PROBE = 0.65  # the given vectors are close to evenly spread, which no coarse index separates well
LEAST_PROBE = 8
EPSILON = 2.1


LONG = 2**63 - 1


def _matrix(column: pa.ChunkedArray | pa.Array | list[bytes]) -> np.ndarray:
    """Rows of packed doubles."""
    packed = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(packed)).reshape(len(packed), -1) if packed else np.zeros((0, 0))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two keeps squares from overflowing."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of rows with one vector, each row summed alike wherever it stands."""
    a = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    b = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's method on unit vectors; empty lists keep their place."""
    sample = np.unique(sample, axis=0)
    found = sample[np.random.default_rng(lists).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        own = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.maximum(size, 1e-300), found)
    return found


def adaptive_scan(blocks: list[np.ndarray], query: np.ndarray, k: int, epsilon: float = EPSILON) -> np.ndarray:
    """Rows that may be among the ``k`` nearest to ``query``; both rotated, rows by column blocks.

    The ``4 * k`` rows nearest in the first block are measured in full, which gives the first
    limit; the others go on block by block while the test holds.
    """
    n, size, done = len(blocks[0]), len(query), blocks[0].shape[1]
    partial = ((blocks[0] - query[:done]) ** 2).sum(axis=1)
    first = min(n, 4 * k)
    rows = np.argpartition(partial, first - 1)[:first] if first < n else np.arange(n)
    full, at = partial[rows].copy(), done
    for block in blocks[1:]:
        full += ((block[rows] - query[at:at + block.shape[1]]) ** 2).sum(axis=1)
        at += block.shape[1]
    limit = np.partition(full, min(k, len(full)) - 1)[min(k, len(full)) - 1] + 1e-9
    alive = np.arange(n)
    for block in [*blocks[1:], None]:
        bound = limit if done == size else limit * (done / size) * (1 + epsilon / np.sqrt(done)) ** 2
        near = partial <= bound + 1e-9
        alive, partial = alive[near], partial[near]
        if block is None:
            return alive
        partial = partial + ((block[alive] - query[done:done + block.shape[1]]) ** 2).sum(axis=1)
        done += block.shape[1]


def usable(vectors: DataFrame, vec_id: str, embedding: str, queries: Column) -> DataFrame:
    """``row``, ``id``, ``named`` (if there is an id), ``asks`` (if it is a query) and ``c`` (array of double) of the rows that take part.

    Left out are vectors that are null, zero, or hold a component that is null or not finite.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("c"),
        F.coalesce(queries, F.lit(False)).alias("query"))
    rows = rows.filter(F.col("c").isNotNull()).filter(F.expr(
        "forall(c, x -> x IS NOT NULL AND x = x AND abs(x) < double('Infinity')) AND exists(c, x -> x <> 0)"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(LONG)).alias("id"), F.col("id").isNotNull().alias("named"),
        "query", "c")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """``c`` as ``v``: packed doubles, zeros behind the shorter vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("c")
            lengths = np.diff(column.offsets.to_numpy())
            whole = np.zeros((len(lengths), size))
            whole[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("row", "id", "named", "query")), pa.array([v.tobytes() for v in whole], pa.binary())],
                names=["row", "id", "named", "query", "v"])

    return rows.mapInArrow(run, "row long, id long, named boolean, query boolean, v binary")


def _dealt(rows: DataFrame, centers: np.ndarray, probe: int) -> DataFrame:
    """``rows`` with ``lists``: the numbers of the ``probe`` nearest lists, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)  # at most FIT_ROWS / 16 vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit(_matrix(batch.column("v"))) @ shared.value.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :probe].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, lists array<int>")


_FOUND = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("named", pa.bool_()), ("score", pa.float64())])


def _searched(index: DataFrame, queries: DataFrame, blocks: int, k: int, size: int, epsilon: float) -> DataFrame:
    """``query_row``, ``row``, ``id``, ``named``, ``score`` of the ``k`` best of each block that a query probes."""
    def held(rows: pa.Table) -> tuple:
        vectors, turn = _matrix(rows.column("v")), rotation(size)
        turned = unit(vectors) @ turn
        names = (rows.column(n).to_numpy() for n in ("row", "id", "named"))
        return turn, vectors, [np.ascontiguousarray(turned[:, a:a + COLUMNS]) for a in range(0, size, COLUMNS)], *names

    def answer(block: tuple, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        turn, vectors, columns, rows, ids, named = block
        wanted, out = _matrix(asked.column("v")), []
        for own, query, way in zip(asked.column("row").to_pylist(), wanted, unit(wanted) @ turn):
            found = adaptive_scan(columns, way, k, epsilon)
            score = cosines(vectors[found], query)
            best = np.lexsort((rows[found], ids[found], ~named[found], -score))[:k]
            found, score = found[best], score[best]
            out.append((np.full(len(best), own), rows[found], ids[found], named[found], score))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND)

    return against_blocks(index, queries, blocks, held, answer, "query_row long, row long, id long, named boolean, score double")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
    probe: float = PROBE, fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS, epsilon: float = EPSILON,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` nearest found.

    ``queries`` is a condition on the input; candidates are all rows but the query's own, so of two
    rows with one id each is a candidate of the other, and an id can occur twice in an answer. Ties go to
    the smaller id, rows without id last. ``probe`` is the share of lists probed, ``LEAST_PROBE`` lists at
    least; a query that finds fewer than ``k`` there is searched in all lists. A shorter vector counts as
    filled up with zeros. See ``usable`` for the vectors that take no part. Without usable vectors, or
    with one, there are no rows.
    """
    spark = vectors.sparkSession
    given = staged(usable(vectors, vec_id, embedding, queries), "scan-given")  # fixes row numbers
    total, size = given.agg(F.count("*"), F.max(F.size("c"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _packed(given.orderBy(F.xxhash64("row"), "row").limit(fit_rows), size).select("v").toArrow()
    sample = unit(_matrix(sample.column("v")))
    centers = centroids(sample, max(1, min(int(total ** 0.5), len(sample) // 16)))
    tried = min(len(centers), max(LEAST_PROBE, int(np.ceil(probe * len(centers)))))
    dealt = staged(_dealt(_packed(given, size), centers, 1).withColumn("list", F.col("lists")[0]).drop("lists"), "scan-lists")
    # A number per list, and the lists are as bounded as the sample.
    sizes = {r.list: r["count"] for r in dealt.groupBy("list").count().collect()}
    parts = [-(-sizes.get(i, 0) // block_rows) for i in range(len(centers))]
    first = np.concatenate(([0], np.cumsum(parts))).tolist()

    def of_list(values: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("list"))

    index = dealt.withColumn("part", (of_list(first) + F.pmod(F.xxhash64("row"), of_list(parts)).cast("int")))
    index = index.select("part", "row", "id", "named", "v")
    asked = staged(dealt.filter("query").select(F.col("row").alias("own_row"), F.col("id").alias("own_id"), F.col("named").alias("own_named"), "v"), "scan-queries")
    # Equal vectors ask once, by their first row, for one more row than wanted: one's own may be among them.
    once = staged(asked.groupBy("v").agg(F.min("own_row").alias("row")), "scan-once")

    def first_of(found: DataFrame, limit: int, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("named"), F.asc("id"), F.asc("row"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)

    def search(wanted: DataFrame, lists: int) -> DataFrame:
        near = _dealt(wanted.select("row", "v"), centers, lists).select("row", "v", F.explode("lists").alias("list"))
        near = near.withColumn("n", of_list(parts)).filter("n > 0")
        near = near.select("row", "v", F.explode(F.sequence(of_list(first), of_list(first) + F.col("n") - 1)).alias("part"))
        return staged(first_of(_searched(index, near, first[-1], k + 1, size, epsilon), k + 1, "query_row"), "scan-found")

    found = search(once, tried)
    if tried < len(centers):
        full = found.groupBy(F.col("query_row").alias("row")).count().filter(F.col("count") >= min(k + 1, total))
        short = staged(once.join(full, "row", "left_anti"), "scan-short")
        if not short.isEmpty():
            found = found.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(search(short, len(centers)))
            found = staged(found, "scan-found")
    # Tables on both sides, so that a vector of very many queries can be split.
    of_query = staged(asked.join(once, "v").select("own_row", "own_id", "own_named", F.col("row").alias("query_row")), "scan-askers")
    mine = of_query.join(found.drop("rank"), "query_row").filter("row <> own_row")
    return first_of(mine, k, "own_row").select(
        F.when(F.col("own_named"), F.col("own_id")).alias("query_id"), "rank", F.when(F.col("named"), F.col("id")).alias("vec_id"), "score")
