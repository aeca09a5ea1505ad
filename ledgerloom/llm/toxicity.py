"""Toxicity scores of a bidirectional gated recurrent network with attention pooling.

A word's input is two vectors: the embedding of the whole word, and the mean of those of its
character 4- and 5-grams (bytes, with a space at either end), both by hashed buckets. A gated
recurrent unit reads a window of words in both directions, attention weighs the states, and
their weighted sum gives the window's logit. A text is read in overlapping windows from its first
word to its last; its score is that of its highest window.

Windows overlap by half, so every passage of up to half a window is whole in some window.

Training is in numpy, on at most ``FIT_ROWS`` labelled texts of each class, drawn by a hash of
their ids, and at most ``FIT_BYTES`` of text of each. A text's label belongs to some window of it, so
the loss is taken of the log-sum-exp of its windows' logits; of a text of more than ``FIT_WINDOWS``
windows all are read, and the highest of them are learned from. Scoring covers every window of
every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import octets, slices, with_columns
from ledgerloom.llm.lexicon import Lexicon, _SEED, _powers, joined, word_places
from ledgerloom.llm.suffix import _TABLE

FIT_ROWS = 1200
FIT_BYTES = 8 << 20
FIT_WINDOWS = 16
STEPS = 320
BATCH = 60
WINDOW, STRIDE = 64, 32
TOGETHER = 1024
BUCKETS = 1 << 15
DIM, HIDDEN, GLANCE = 8, 8, 8
_GRAMS = (4, 5)
_ROOM = 40_000


def word_features(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Bucket of each word; and for each gram length the word and the bucket of every gram."""
    buffer = np.frombuffer(b"".join([b" %b " % w for w in words]), np.uint8)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    up, down = _powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_SEED[buffer] * up[:len(buffer)], out=sums[1:])
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    whole = ((sums[ends] - sums[ends - sizes]) * down[ends - sizes]) >> shift
    room, owner = np.repeat(ends, sizes) - np.arange(len(buffer)), np.repeat(np.arange(len(words)), sizes)
    grams = []
    for n in _GRAMS:
        at = np.flatnonzero(room >= n)
        grams.append((owner[at], (((sums[at + n] - sums[at]) * down[at]) >> shift).astype(np.int64)))
    return whole.astype(np.int64), grams


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each window (-1 past the end) for texts of ``counts`` words in a row, and its text.

    A text of no words has one window without words.
    """
    number = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), number)
    within = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    place = within[:, None] * STRIDE + np.arange(WINDOW)
    first = np.cumsum(counts) - counts
    return np.where(place < counts[text][:, None], place + first[text][:, None], -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.maximum(x, -80)))


class Network:
    """Parameters, in float32 once trained; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[-2])
        self.p = {
            "word": rng.standard_normal((BUCKETS, DIM)) * 0.1, "gram": rng.standard_normal((BUCKETS, DIM)) * 0.1,
            "wx": draw(2, 2 * DIM, 3 * HIDDEN), "bx": np.zeros((2, 1, 3 * HIDDEN)), "u": draw(2, HIDDEN, 3 * HIDDEN),
            "wa": draw(2 * HIDDEN, GLANCE), "ba": np.zeros(GLANCE), "va": draw(GLANCE, 1)[:, 0], "wo": draw(2 * HIDDEN, 1)[:, 0],
            "bo": np.zeros(1)}

    def inputs(self, features) -> tuple[np.ndarray, np.ndarray]:
        """The two vectors of each word side by side, and its number of grams (1 at least)."""
        whole, grams = features
        n = len(whole)
        count = np.maximum(1, sum(np.bincount(owner, minlength=n) for owner, _ in grams))
        total = np.zeros((n, DIM))
        for owner, bucket in grams:
            for d in range(DIM):
                total[:, d] += np.bincount(owner, self.p["gram"][bucket, d], n)
        return np.concatenate((self.p["word"][whole], total / count[:, None]), axis=1), count

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The part of both directions' gates that depends on the word alone: (2, words + 1, gates).

        The last row is that of a place past the text's end.
        """
        out = x[None] @ self.p["wx"] + self.p["bx"]
        return np.concatenate((out, np.broadcast_to(self.p["bx"], (2, 1, out.shape[2]))), axis=1)

    def forward(self, gates: np.ndarray, place: np.ndarray, keep: bool = False):
        """Logit of each window; ``place`` has rows of ``gates``, -1 past the end."""
        n, steps, h = len(place), place.shape[1], HIDDEN
        state, inside = np.zeros((2, n, h), gates.dtype), place.T >= 0
        states = np.empty((steps, n, 2 * h), gates.dtype)
        trail, u, x = [], self.p["u"], np.empty((2, n, 3 * h), gates.dtype)
        for t in range(steps):
            gates[0].take(place[:, t], axis=0, out=x[0], mode="wrap")
            gates[1].take(place[:, steps - 1 - t], axis=0, out=x[1], mode="wrap")
            hu = state @ u
            zr = _sigmoid(x[..., :2 * h] + hu[..., :2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = 2 * _sigmoid(2 * (x[..., 2 * h:] + r * hu[..., 2 * h:])) - 1
            before, state = state, new + z * (state - new)
            states[t, :, :h], states[steps - 1 - t, :, h:] = state[0], state[1]
            if keep:
                trail.append((before, zr, new, hu[..., 2 * h:]))
        glance = np.tanh(states @ self.p["wa"] + self.p["ba"])
        weight = np.where(inside, glance @ self.p["va"], -1e4).astype(gates.dtype)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * states).sum(axis=0)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return (logit, (place, states, trail, glance, weight, pooled)) if keep else logit

    def backward(self, kept, d_logit: np.ndarray, size: int) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of ``gates`` (rows but the last)."""
        place, states, trail, glance, weight, pooled = kept
        p, h, steps = self.p, HIDDEN, place.shape[1]
        g = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_glance = d_score[..., None] * p["va"] * (1 - glance ** 2)
        g["va"] = np.einsum("tn,tng->g", d_score, glance)
        g["wa"] = np.einsum("tnh,tng->hg", states, d_glance)
        g["ba"] = d_glance.sum(axis=(0, 1))
        d_states = weight[..., None] * d_pooled + d_glance @ p["wa"].T
        g["u"], d_gates, d_state = np.zeros_like(p["u"]), np.zeros((2, size + 1, 3 * h)), np.zeros((2, len(place), h))
        every = np.empty((2, steps, len(place), 3 * h))
        for t in range(steps - 1, -1, -1):
            before, zr, new, hun = trail[t]
            z, r = zr[..., :h], zr[..., h:]
            d_state = d_state + np.stack((d_states[t, :, :h], d_states[steps - 1 - t, :, h:]))
            d_new = d_state * (1 - z) * (1 - new ** 2)
            d_z = d_state * (before - new) * z * (1 - z)
            d_r = d_new * hun * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_new), axis=2)
            d_hu = np.concatenate((d_z, d_r, d_new * r), axis=2)
            g["u"] += before.transpose(0, 2, 1) @ d_hu
            d_state = d_state * z + d_hu @ p["u"].transpose(0, 2, 1)
            every[0, t], every[1, steps - 1 - t] = d_x[0], d_x[1]
        at = np.where(place < 0, size, place).T.ravel()
        for k in range(2):
            for d in range(3 * h):
                d_gates[k, :, d] = np.bincount(at, every[k, :, :, d].ravel(), size + 1)
        g["bx"] = d_gates.sum(axis=1, keepdims=True)
        return g, d_gates[:, :size]


def _texts(own: Lexicon, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the texts in a row, and the number of words of each."""
    buffer, ends = joined([t.translate(_TABLE) for t in texts])
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = word_places(buffer)
    return own.index(buffer, a, b), np.bincount(np.searchsorted(ends, a, side="right"), minlength=len(texts))


def highest(net: Network, gates: np.ndarray, place: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """Places of the windows with the ``most`` highest logits of each text, in order."""
    logit = np.concatenate([net.forward(gates, place[at:at + TOGETHER]) for at in range(0, len(place), TOGETHER)])
    order = np.lexsort((-logit, text))
    first = np.searchsorted(text[order], text[order])  # where each text begins in that order
    return np.sort(order[np.arange(len(order)) - first < most])


def train(texts: list[bytes], labels: np.ndarray, least_steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over batches of whole texts, every text as often as makes up the steps."""
    net, rng, rate = Network(seed), np.random.default_rng(seed), 0.01
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps, batches = 0, -(-len(texts) // BATCH)
    epochs = -(-least_steps // batches) if batches else 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            own = Lexicon()
            found, counts = _texts(own, [texts[k] for k in rows])
            place, text = windows(counts)
            place = np.where(place < 0, -1, np.append(found, -1)[place])
            features = word_features(own.words()) if len(own) else (np.zeros(0, np.int64), [])
            x, grams = net.inputs(features)
            gates = net.gates(x)
            if (np.bincount(text) > FIT_WINDOWS).any():
                those = highest(net, gates, place, text, FIT_WINDOWS)
                place, text = place[those], text[those]
            logit, kept = net.forward(gates, place, True)
            top = np.full(len(rows), -np.inf)
            np.maximum.at(top, text, logit)
            odds = np.exp(logit - top[text])
            total = np.bincount(text, odds, len(rows))
            d_logit = (_sigmoid(top + np.log(total)) - labels[rows])[text] * odds / total[text] / len(rows)
            g, d_gates = net.backward(kept, d_logit, len(own))
            g["wx"] = x.T[None] @ d_gates
            d_x = (d_gates @ net.p["wx"].transpose(0, 2, 1)).sum(axis=0)
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            for d in range(DIM):
                g["word"][:, d] = np.bincount(features[0], d_x[:, d], BUCKETS)
                for owner, bucket in features[1]:
                    g["gram"][:, d] += np.bincount(bucket, (d_x[:, DIM + d] / grams)[owner], BUCKETS)
            steps += 1
            pace = rate * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999 ** steps) / (1 - 0.9 ** steps)
            for k, v in net.p.items():
                a, b = moment[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                v -= pace * a / (np.sqrt(b) + 1e-8)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    return net


class Scorer:
    """Scores texts with a trained network; holds the gates of the words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.own, self.gates = Lexicon(), np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if len(self.own) > _ROOM:
            self._clear()
        found, counts = _texts(self.own, texts)
        done = self.gates.shape[1]
        if len(self.own) > done:
            x, _ = self.net.inputs(word_features(self.own.words(done)))
            self.gates = np.concatenate((self.gates, self.net.gates(x.astype(np.float32))[:, :-1]), axis=1)
        gates = np.concatenate((self.gates, np.broadcast_to(self.net.p["bx"], (2, 1, 3 * HIDDEN))), axis=1)
        place, text = windows(counts)
        place = np.where(place < 0, -1, np.append(found, -1)[place])
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(place), TOGETHER):
            np.maximum.at(best, text[at:at + TOGETHER], self.net.forward(gates, place[at:at + TOGETHER]).astype(np.float64))
        return _sigmoid(best)


def fit(docs: DataFrame, labels: DataFrame, training, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = FIT_ROWS, room: int = FIT_BYTES) -> Network:
    """Train on up to ``rows`` labelled texts of each class; ``training`` is a condition on ``doc_id``.

    Texts are taken in the order of a hash of their ids while they fit into ``room`` bytes together. Labels that are null, and ids with labels of both classes, are not learned from. Without
    labels the network is that of its random start.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).filter("i IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("i").agg(F.max("y").alias("y"), F.min("y").alias("least")).filter("y = least").drop("least")
    known = known.withColumn(doc_id, F.col("i")).filter(training).select("i", "y")
    # Twice as many ids as wanted, as some have no text; few enough to broadcast.
    ids = [known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(2 * rows) for y in (0, 1)]
    texts = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    both = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "i").select("i", "t", "y")
    both = both.withColumn("size", F.octet_length("t"))
    # No more than twice ``rows`` texts and ``room`` bytes come to the driver, however often a row is repeated.
    before = Window.partitionBy("y").orderBy(F.xxhash64("i"), "i", "t").rowsBetween(Window.unboundedPreceding, 0)
    few = [both.filter((F.col("y") == y) & (F.col("size") <= room)).orderBy(F.xxhash64("i"), "i", "t").limit(rows) for y in (0, 1)]
    drawn = [df.withColumn("sum", F.sum("size").over(before)).filter(F.col("sum") <= room).select("t", "y") for df in few]
    got = sorted((r.t.encode(), r.y) for r in drawn[0].unionByName(drawn[1]).collect())
    return train([t for t, _ in got], np.array([y for _, y in got], dtype=np.float64)) if got else train([], np.zeros(0))


def with_scores(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each text, 0 to 1; a column of that name is replaced.

    A null text is empty; an empty text is scored as a window without words. Equal texts get
    equal scores wherever they stand, up to rounding in single precision.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    fields = [f for f in docs.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        net.p = shared.value
        own = Scorer(net)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                yield with_columns(part, **{name: pa.array(own(octets(part.column(text))))})

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def training_rows(doc_id: str = "doc_id") -> F.Column:
    """All but a fifth, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(True))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on) of every row.

    Repeated rows are scored as often as they occur; an empty table gives no rows; no column but
    the text goes into a score.
    """
    net = fit(docs, labels, training_rows())
    scored = with_scores(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (~training_rows()).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``, with their columns as they were."""
    net = fit(docs, labels, training_rows())
    return with_scores(docs, net, "text", "__score").filter(F.col("__score") < threshold).select(*docs.columns)
