"""Hard negatives by rotated one-bit codes, with intervals that are certain.

Vectors are integers, a score is their inner product. A vector, turned by a random rotation, is
stored as signs: its unit code vector c, and the alignment a = <c, x>. What c leaves of x, a residual
at right angles to c, is coded again, a few times over. For a query q, quantised to eight bit planes,
popcounts of plane and code give <q, c> up to a known rounding error, and by Cauchy-Schwarz the last
residual r moves the score by at most |r| times the part of q at right angles to c. So each level of
codes gives an interval that holds the score (the estimate after Gao and Long, SIGMOD 2024, but with
a bound that never fails). Rows whose interval cannot matter go, and the rest are scored in integers.

Rows lie in blocks of bounded size, dealt by a hash of their row number; anchors travel to the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import against_blocks
from ledgerloom.llm.common import staged

BLOCK_ROWS = 16_384
LEVELS = 5
PLANES = 8
TURN = 1024
LONG = 2**63 - 1


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def turned(vectors: np.ndarray) -> np.ndarray:
    """Rows after a random rotation of every 1,024 columns."""
    return np.concatenate([part @ rotation(part.shape[1]) for part in (vectors[:, a:a + TURN] for a in range(0, vectors.shape[1], TURN))], axis=1)


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    bits = np.packbits(signs, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view("<u8")


def codes(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows: code words (row, level, word), alignments and lengths of residuals (row, level)."""
    rest, size, words, align, left = turned(vectors), vectors.shape[1], [], [], []
    for _ in range(levels):
        signs = rest >= 0
        unit = np.where(signs, 1.0, -1.0) / np.sqrt(size)
        a = (rest * unit).sum(axis=1)
        rest = rest - a[:, None] * unit
        words.append(packed(signs))
        align.append(a)
        left.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.stack(words, axis=1), np.stack(align, axis=1), np.stack(left, axis=1)


class Planes:
    """A turned query as bit planes, with the rounding error that it has against any code."""

    def __init__(self, query: np.ndarray, length: float):
        low, high = float(query.min()), float(query.max())
        self.low, self.step = low, max((high - low) / (2**PLANES - 1), np.finfo(float).tiny)
        levels = np.clip(np.rint((query - low) / self.step), 0, 2**PLANES - 1)
        rounded = low + self.step * levels
        self.sum, self.size, self.square = rounded.sum(), len(query), length * length
        self.error = np.abs(query - rounded).sum() / np.sqrt(len(query))
        levels = levels.astype(np.int64)
        self.bits = packed(np.stack([(levels >> k) & 1 for k in range(PLANES)]).astype(bool))
        self.weights = 2.0 ** np.arange(PLANES)

    def against(self, words: np.ndarray) -> np.ndarray:
        """Inner products with the code vectors of ``words``, by popcounts."""
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        counts = np.bitwise_count(words[None] & self.bits[:, None]).sum(axis=2, dtype=np.int64)
        inside = self.step * (self.weights @ counts) + self.low * ones
        return (2 * inside - self.sum) / np.sqrt(self.size)


class Block:
    """Rows of one block: vectors, codes, labels, ids and places of each label."""

    def __init__(self, rows: pa.Table, size: int, levels: int = LEVELS):
        def matrix(name: str, kind: str, *shape: int) -> np.ndarray:
            return np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind).reshape(rows.num_rows, *shape)

        self.vectors = matrix("vec", "<i8", size)
        self.words = matrix("words", "<u8", levels, -(-size // 64))
        self.align, self.left = matrix("align", "<f8", levels), matrix("left", "<f8", levels)
        self.row, self.label = rows.column("row").to_numpy(), rows.column("label").to_numpy()
        self.id, self.named = rows.column("id").to_numpy(), rows.column("named").to_numpy()
        self.floats = self.vectors.astype(np.float64)
        self.length = np.sqrt((self.floats ** 2).sum(axis=1))
        self.most = float(np.abs(self.floats).max(initial=0.0))
        self.all = np.arange(rows.num_rows)

    def alive(self, planes: Planes, rows: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Of ``rows`` those whose interval ``wanted`` keeps at every level of codes."""
        score = wide = np.zeros(len(rows))
        for level in range(self.words.shape[1]):
            if not len(rows):
                break
            dot, align = planes.against(self.words[rows, level]), self.align[rows, level]
            score, wide = score + align * dot, wide + np.abs(align) * planes.error
            across = np.sqrt(np.maximum(planes.square - np.maximum(np.abs(dot) - planes.error, 0) ** 2, 0))
            reach = wide + self.left[rows, level] * across + 1e-9 * (1 + self.length[rows] * np.sqrt(planes.square))
            keep = wanted(score - reach, score + reach)
            rows, score, wide = rows[keep], score[keep], wide[keep]
        return rows

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; those beyond a long stand at its ends."""
        largest = float(np.abs(query.astype(np.float64)).max(initial=0.0))
        if self.most * largest * len(query) < 2.0**53:  # every partial sum is a whole number that a double holds
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return np.array([min(max(sum(map(int.__mul__, v, query.tolist())), -LONG - 1), LONG) for v in self.vectors[rows].tolist()], dtype=np.int64)

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` best: largest score, then smallest id, rows without one last."""
        order = np.lexsort((self.id[rows], ~self.named[rows], -np.maximum(score, -LONG)))
        return order[:k]


def _at_least(low: np.ndarray, k: int) -> float:
    """A score that ``k`` rows reach for certain."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


def nearest_alike(block: Block, planes: Planes, query: np.ndarray, row: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows of the same label but ``row`` itself, and their scores."""
    rows = block.alive(planes, block.all[(block.label == label) & (block.row != row)], lambda low, high: high >= _at_least(low, k))
    score = block.scores(rows, query)
    best = block.best(rows, score, k)
    return rows[best], score[best]


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """Scores s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def nearest_within(block: Block, planes: Planes, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window the ``k`` best rows of another label whose score lies in it."""
    open_ = [w for w in windows if w[0] <= w[1]]

    def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), bool)
        for least, most in open_:
            floor = max(least, _at_least(low[(low >= least) & (high <= most)], k))
            keep |= (high >= floor) & (low <= most)
        return keep

    rows = block.alive(planes, block.all[block.label != label], wanted) if open_ else block.all[:0]
    score, found = block.scores(rows, query), []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        best = inside[block.best(rows[inside], score[inside], k)]
        found.append((rows[best], score[best]))
    return found


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: Column, anchors: Column, scale: int) -> DataFrame:
    """``row``, ``id``, ``named`` (if there is an id), ``label``, ``anchor``, ``v`` (array of long) of the rows that take part."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter("label IS NOT NULL AND v IS NOT NULL").filter(
        F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(LONG)).alias("id"),
        F.col("id").isNotNull().alias("named"), "label", "anchor", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def padded(column: pa.Array, size: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``size``, zeros behind the shorter ones."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = values
    return out


def _indexed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows with ``part`` and, as bytes, ``vec``, ``words``, ``align`` and ``left``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = padded(batch.column("v"), size)
            words, align, left = codes(whole.astype(np.float64))
            new = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (whole, words, align, left)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("part", "row", "id", "named", "label")), *new],
                names=["part", "row", "id", "named", "label", "vec", "words", "align", "left"])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    return dealt.mapInArrow(run, "part int, row long, id long, named boolean, label long, vec binary, words binary, align binary, left binary")


_FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, id long, named boolean, score long"
_FOUND_SCHEMA = pa.schema([
    ("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()),
    ("positive_score", pa.int64()), ("id", pa.int64()), ("named", pa.bool_()), ("score", pa.int64())])


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives the highest rows of other labels that score ``least`` to ``most`` percent of it.

    Columns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``,
    ``negative_score``. ``anchors`` is a condition on the input; positives are the first other
    rows of the anchor's label. Each component x counts as floor(scale * x), at the ends of a long
    beyond it, and so does a score. Higher scores come first, ties by smaller id, rows without id
    last. Every row is one of its own: of two rows with one id, each is a candidate of the other.
    Rows without label or vector, or with a component that is null or not finite, take no part. A
    shorter vector counts as filled up with zeros. A positive without such negatives has no rows; so
    has an empty table.
    """
    rows = staged(integer_vectors(vectors, vec_id, embedding, label, anchors, scale), "hardneg-rows")  # fixes row numbers
    total, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts, size = max(1, -(-total // block_rows)), max(1, size)
    index = staged(_indexed(rows, size, parts), "hardneg-index")
    asked = index.join(rows.filter("anchor").select("row"), "row", "left_semi").select("row", "id", "named", "label", "vec")
    asked = staged(asked, "hardneg-anchors")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")

    def held(block: pa.Table) -> Block:
        return Block(block, size)

    def queries(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, np.ndarray, Planes]]:
        vecs = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i8").reshape(-1, size)
        floats = vecs.astype(np.float64)
        lengths, ways = np.sqrt((floats ** 2).sum(axis=1)), turned(floats)
        for k, (row, name, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "id", "label")))):
            yield k, row, name, own, vecs[k], Planes(ways[k], lengths[k])

    def emitted(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of (anchor row, anchor, place, positive, its score, block, rows, scores)."""
        if found:
            sizes = [len(f[6]) for f in found]
            columns = [np.repeat(np.array([f[k] for f in found], dtype=np.int64), sizes) for k in range(5)]
            rest = [np.concatenate(c) for c in ([f[5].id[f[6]] for f in found], [f[5].named[f[6]] for f in found], [f[7] for f in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, *rest], _FOUND_SCHEMA.types)], schema=_FOUND_SCHEMA)

    def alike(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from emitted([
            (row, name, 0, 0, 0, block, *nearest_alike(block, planes, query, row, own, positives))
            for _, row, name, own, query, planes in queries(batch)])

    def others(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, found = batch.column("positives").to_pylist(), []
        for k, row, name, own, query, planes in queries(batch):
            spans = [window(p["score"], least, most) for p in of[k]]
            best = nearest_within(block, planes, query, own, spans, negatives)
            found += [(row, name, p["place"], p["id"], p["score"], block, *b) for p, b in zip(of[k], best)]
        yield from emitted(found)

    def first_of(found: DataFrame, keys: list[str], limit: int, rank: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("named"), F.asc("id"))
        return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= limit)

    near = against_blocks(index, asked.select("row", "id", "named", "label", "vec", everywhere), parts, held, alike, _FOUND)
    near = first_of(near.drop("place", "positive_id"), ["anchor_row"], positives, "place")
    chosen = near.groupBy(F.col("anchor_row").alias("row")).agg(
        F.collect_list(F.struct("place", F.when(F.col("named"), F.col("id")).alias("id"), "score")).alias("positives"))
    windowed = staged(asked.join(chosen, "row"), "hardneg-positives")
    far = against_blocks(index, windowed.select("row", "id", "named", "label", "vec", "positives", everywhere), parts, held, others, _FOUND)
    far = first_of(far, ["anchor_row", "place"], negatives, "rank")
    return far.select(
        "anchor_id", "positive_id", "rank", F.when(F.col("named"), F.col("id")).alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


ORACLE = """
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.row, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM pairs WHERE alike
  QUALIFY place <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.row, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.row = p.row AND NOT n.alike
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3"""
