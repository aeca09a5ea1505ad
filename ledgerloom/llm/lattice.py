"""Language-model scores from a lattice of subwords.

The vocabulary is that of a public tokenizer, with one piece for every byte besides. A word, a
space in front of it, is a lattice whose edges are the pieces that match; its probability is
the sum over all paths of the product of the pieces' probabilities, by a forward recursion in
log space. Pieces are drawn independently until an end, so a text's probability is the
product over its words, times that of the end.

The vocabulary's own scores give the weights to start from. They are ranks rather than
probabilities, so expectation-maximisation over all training words fits them: each round
sums over the distinct words how often each piece is expected.

With ``whole_words`` a word of the training texts is one more edge of its lattice, from its start
to its end, with its share of the training tokens. Pieces then stand for what is new: they are
fitted to distinct words, each once, and get the share T / (N + T) of new words among N tokens
of T kinds (Witten and Bell). Without it, pieces are fitted to all tokens and spell every word.

Words are counted in blocks of texts (``BLOCK_BYTES``), so that a word moves once for each block
that holds it and not once for each occurrence; a word as frequent as any is a row per block.
A word's lattice is run where its counts are, once, and both return to the blocks, where the
texts are scored, a block to a task. What the driver holds is one number per piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import _LOWER, octets, slices, staged
from ledgerloom.llm.lexicon import Lexicon, _SEED, _powers, joined, word_places

BLOCK_BYTES = 16 << 20
MOST_TASKS = 50_000
ROUNDS = 2
PRIOR = 0.5


class Vocabulary:
    """Pieces as bytes, and the natural logarithms of their probabilities."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.pieces, self.logs, self.longest = pieces, logs, max(map(len, pieces))
        buffer = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        self.numbers = Lexicon(1 << 18)  # sparse, as most lookups find nothing
        self.numbers.index(buffer, np.concatenate(([0], ends[:-1])), ends)

    def edges(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """For each length from 1: the piece that starts at each place of the buffer, or -1."""
        up, down = _powers(len(buffer))
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_SEED[buffer] * up[:len(buffer)], out=sums[1:])
        room = np.repeat(ends, ends - starts) - np.arange(len(buffer))  # bytes to the word's end
        out = []
        for size in range(1, min(self.longest, int((ends - starts).max())) + 1):
            at = np.flatnonzero(room >= size)
            found = np.full(len(buffer), -1, np.int32)
            found[at] = self.numbers._find((sums[at + size] - sums[at]) * down[at])
            out.append(found)
        return out

    def _pass(self, weights: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray, total: int, back: bool) -> np.ndarray:
        """Log sums of all paths from a word's start to each place, or from there to its end.

        Words lie end to end, each with a place more than bytes; longer words come first, so the
        words that reach a step are a prefix.
        """
        value = np.full(total, -np.inf)
        value[starts + sizes if back else starts] = 0.0
        reach = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
        for step, n in enumerate(reach, 1):
            here = starts[:n] + (sizes[:n] - step if back else step)
            terms = []
            for k in range(1, min(step, len(weights)) + 1):
                terms.append(weights[k - 1][here] + value[here + k] if back else weights[k - 1][here - k] + value[here - k])
            terms = np.stack(terms)
            top = terms.max(axis=0)
            value[here] = top + np.log(np.exp(terms - top).sum(axis=0))
        return value

    def run(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word, and with ``counts`` the expected number of each piece."""
        if not words:
            return np.zeros(0), None if counts is None else np.zeros(len(self.pieces))
        sizes = np.array([len(w) + 1 for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        buffer = np.frombuffer(b"".join([b" " + words[k] for k in order.tolist()]), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        edges = self.edges(buffer, starts, ends)
        # Places: a word's bytes and one more.
        spread = np.arange(len(buffer)) + np.repeat(np.arange(len(sizes)), sizes)
        total, first = len(buffer) + len(sizes), starts + np.arange(len(sizes))
        logs, weights = np.append(self.logs, -np.inf), []
        for found in edges:
            w = np.full(total, -np.inf)
            w[spread] = logs[found]
            weights.append(w)
        forward = self._pass(weights, first, sizes, total, False)
        out = np.empty(len(sizes))
        out[order] = forward[first + sizes]
        if counts is None:
            return out, None
        backward = self._pass(weights, first, sizes, total, True)
        share = np.repeat(np.asarray(counts, dtype=np.float64)[order], sizes)
        ending = np.repeat(forward[first + sizes], sizes)
        expected = np.zeros(len(self.pieces))
        for k, found in enumerate(edges, 1):
            at = np.flatnonzero(found >= 0)
            place = spread[at]
            odds = np.exp(forward[place] + logs[found[at]] + backward[place + k] - ending[at]) * share[at]
            expected += np.bincount(found[at], odds, len(self.pieces))
        return out, expected


def public_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece vocabulary and weights from its scores, and a piece for each byte.

    Scores of a merge vocabulary are ranks; a piece starts with the weight 1 / (rank + 2). Pieces
    that reach across words take no part.
    """
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(lib.get_piece_size()):
        if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)):
            piece = lib.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                found[piece] = 1 / (2 - lib.get_score(i))
    least = min(found.values())
    for b in range(256):
        found.setdefault(bytes([b]), least)
    weights = np.array(list(found.values()))
    return list(found), np.log(weights / weights.sum())


def _blocks(block_bytes: int):
    """Adds ``block``: texts in a row, about so many bytes; numbered within the task's part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text", min(block_bytes, 1 << 20)):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(part.num_rows, block))], names=[*part.schema.names, "block"])
                held += part.column("text").nbytes
                if held >= block_bytes:
                    block, held = block + 1, 0

    return run


def _dealt(both: DataFrame, rows: DataFrame) -> DataFrame:
    """``both`` with the blocks of ``rows`` one to a task; beyond ``MOST_TASKS``, neighbours one after the other.

    Blocks are numbered within each of the parts that made them, so part times the most blocks of
    a part, and the number within, tell them apart.
    """
    within = F.col("block").bitwiseAND((1 << 32) - 1)
    part = F.shiftright("block", 32)
    most = rows.agg(F.max(part).alias("part"), F.max(within).alias("within")).first()
    if most.part is None:
        return both.coalesce(1)
    parts, blocks = most.part + 1, most.within + 1
    together = -(-parts * blocks // MOST_TASKS)
    number = F.floor((part * blocks + within) / together).cast("int")
    return both.repartitionById(-(-parts * blocks // together), number)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block, with their number in its training texts."""
    own, block, counts = Lexicon(), None, np.zeros(0, np.int64)

    def ended() -> Iterator[pa.RecordBatch]:
        words = own.words()
        for at in range(0, len(words), 50_000):
            part = words[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), block)), pa.array(part, pa.binary()), pa.array(counts[at:at + 50_000])],
                names=["block", "word", "n"])

    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            numbers, held = part.column("block").to_numpy(), part.column("held_out").to_numpy(zero_copy_only=False)
            for one in np.unique(numbers):
                if one != block:
                    if block is not None:
                        yield from ended()
                    own, block, counts = Lexicon(), one, np.zeros(0, np.int64)
                mine = numbers == one
                found, text = _numbers(own, [t for t, m in zip(octets(part.column("text")), mine) if m])
                more = np.bincount(found[~held[mine][text]], minlength=len(own))
                more[:len(counts)] += counts
                counts = more
    if block is not None:
        yield from ended()


def _numbers(own: Lexicon, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, and the text it is in."""
    buffer, ends = joined([t.translate(_LOWER) for t in texts])
    a, b = word_places(buffer)
    return own.index(buffer, a, b), np.searchsorted(ends, a, side="right")


def _expected(vocabulary, each_once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = vocabulary.value, 0.0
        for batch in batches:
            for part in slices(batch, "word", 96 << 10):
                total = total + own.run(
                    octets(part.column("word")), np.ones(part.num_rows) if each_once else part.column("c").to_numpy())[1]
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["piece", "n"])

    return run


def _spelled(vocabulary, whole: tuple[float, float]):
    """Adds ``log``, a word's log probability, to rows of words.

    Equal words are next to each other, as the rows come from a window by word, so that nearly
    every word is run once, however many blocks hold it. ``whole``: the log weights of a training
    token as an edge, and of all pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = vocabulary.value, [], 0

        def ended() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            words = rows.column("word").combine_chunks().dictionary_encode()
            distinct = pa.RecordBatch.from_arrays([words.dictionary], names=["word"])
            logs = [model.run(octets(part.column("word")))[0] for part in slices(distinct, "word", 96 << 10)]
            logs = np.concatenate(logs)[words.indices.to_numpy()] + whole[1]
            with np.errstate(divide="ignore"):
                logs = np.logaddexp(logs, np.log(rows.column("c").to_numpy()) + whole[0])
            return rows.append_column("log", pa.array(logs)).to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("word").nbytes
            if size >= 1 << 20:
                yield ended()
                held, size = [], 0
        if held:
            yield ended()

    return run


def _scored(end: tuple[int, float], base: float):
    """Scores the texts of each block; its words, with their counts and logs, come before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = Lexicon(), None
        counts, logs = np.zeros(0, np.int64), np.zeros(0)
        end_base = np.log10(end[0] + 1) - base
        for batch in batches:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for at, to in zip([0, *edges], [*edges, len(numbers)]):
                if to <= at:
                    continue
                rows = batch.slice(at, to - at)
                if numbers[at] != block:
                    own, block, counts, logs = Lexicon(), numbers[at], np.zeros(0, np.int64), np.zeros(0)
                if kinds[at] == 0:
                    buffer, ends = joined(octets(rows.column("word")))
                    own.index(buffer, np.concatenate(([0], ends[:-1])), ends - 1)
                    counts = np.concatenate((counts, rows.column("c").to_numpy()))
                    logs = np.concatenate((logs, rows.column("log").to_numpy()))
                    continue
                word_base, word_score = np.log10(counts + 1) - base, logs / np.log(10)
                for part in slices(rows, "text", 1 << 20):
                    found, text = _numbers(own, octets(part.column("text")))
                    n = part.num_rows
                    tokens = np.bincount(text, minlength=n) + 1
                    known = np.bincount(text[counts[found] > 0], minlength=n) + (end[0] > 0)
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), part.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                        pa.array(np.bincount(text, word_base[found], n) + end_base),
                        pa.array(np.bincount(text, word_score[found], n) + end[1]),
                    ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def lattice_scores(
    docs: DataFrame, pieces: list[bytes], logs: np.ndarray, held_out, doc_id: str = "doc_id", text: str = "text",
    rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, whole_words: bool = True,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held_out`` is a condition on ``doc_id``; rows for which it is null train. ``score`` is the
    model's log10 probability of the text, ``base_score`` that of a word unigram with one added.
    A null or empty text is its end alone. Without training rows every piece keeps its weight
    and the end that of one more piece. Repeated rows count and are scored as often as they
    occur. An empty table gives no rows. Other columns are not read. A third of all rows with one
    text are counted in their blocks before they move, like any others.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = staged(rows.mapInArrow(_blocks(block_bytes), f"doc_id {kind}, text string, held_out boolean, block long"), "lattice-texts")
    words = rows.mapInArrow(_counted, "block long, word binary, n long")
    # A task's part of a block may be read by two tasks: its words then come twice.
    words = words.groupBy("word", "block").agg(F.sum("n").alias("n"))
    of_word = Window.partitionBy("word")
    words = staged(words.select(
        "block", "word", F.sum("n").over(of_word).alias("c"),
        (F.row_number().over(of_word.orderBy("block")) == 1).alias("first")), "lattice-words")
    known = words.filter("first AND c > 0").select("word", "c")
    stats = known.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    texts = rows.filter("NOT held_out").count()
    tokens, distinct = stats.n + texts, stats.v + (texts > 0)
    end_log = -np.log(len(pieces) + 1)
    for _ in range(rounds if texts else 0):
        model = sc.broadcast(Vocabulary(pieces, logs))
        found = known.mapInArrow(_expected(model, whole_words), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.full(len(pieces), PRIOR)
        for r in found.toLocalIterator():  # one row per piece of the vocabulary
            expected[r.piece] += r.n
        total = expected.sum() + (0 if whole_words else texts + PRIOR)
        logs, end_log = np.log(expected / total), np.log((texts + PRIOR) / total)
    whole = (-np.inf, 0.0)
    if whole_words and texts:
        whole = (-np.log(tokens + distinct), np.log(distinct / (tokens + distinct)))
        end_log = np.log(texts) + whole[0]
    model = sc.broadcast(Vocabulary(pieces, logs))
    logged = words.select("block", "word", "c").mapInArrow(_spelled(model, whole), "block long, word binary, c long, log double")
    none = {"doc_id": kind, "held_out": "boolean", "text": "string"}
    both = logged.select("block", F.lit(0).alias("kind"), "word", "c", "log", *[F.lit(None).cast(t).alias(n) for n, t in none.items()]).unionByName(
        rows.select("block", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("word"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("log"), *none))
    both = _dealt(both, rows).sortWithinPartitions("block", "kind")
    scores = both.mapInArrow(
        _scored((texts, end_log / np.log(10)), np.log10(tokens + distinct + 1)),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.withColumn("train_tokens", F.lit(tokens).cast("long"))
