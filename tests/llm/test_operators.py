"""The operators against brute force, and on nulls, empty and long texts, repeats and clashing names."""

from __future__ import annotations

import hashlib
import re
import xxhash
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import chat, dac, lattice, lexicon, linechunks, linehash, pieces, scan, simhash, suffix, toxicity
from ledgerloom.llm.queries import BYTE_BPE, ORACLE_SQL, PIECE_BPE, QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"
# Names that the operators use for columns of their own.
CLASHES = ("fingerprint", "component_id", "n_words", "spans", "items", "score", "block", "lines", "ends", "hash", "part", "word")
PASSAGE = "First line of it here.\nThe second line follows.\nA third one too.\nFourth and more.\nFifth.\nThe sixth ends."
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog for a long while."), (2, "The cat sat on the mat and looked at the dog for a long while."),
    (2, "The cat sat on the mat and looked at the dog for a long while."), (3, None), (4, ""), (None, "no id but\tsome  words \n\n here"),
    (None, None), (5, "x" * 200_000), (6, "many short words " * 20_000), (7, "é日本 ▁<s> <|endoftext|> \x00\x1c\x85 end"),
    (8, PASSAGE), (9, "Other start.\n" + PASSAGE), (10, PASSAGE + "\nOther end."), (11, " \n "), (-20, "Cat"), (12, "\n".join(["same line here now ok"] * 9)),
]


@pytest.fixture(scope="module")
def docs(spark):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    rows = [(i, t, *["c"] * len(CLASHES)) for i, t in TEXTS]
    return spark.createDataFrame(rows, T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in CLASHES]])).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_lexicon_numbers_equal_words_alike():
    own = lexicon.Lexicon(4)
    words = [b"a", b"b", b"a", b"", b"ccc", b"b", b""] * 50 + [str(i).encode() for i in range(500)]
    buffer, ends = lexicon.joined(words)
    got = own.index(buffer, np.concatenate(([0], ends[:-1])), ends - 1)
    assert [own.words()[k] for k in got] == words and len(own) == len(set(words))


def test_lexicon_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(lexicon, "_SEED", np.ones(256, np.uint64))
    own = lexicon.Lexicon()
    buffer, ends = lexicon.joined([b"ab", b"cd", b"ab"])
    got = own.index(buffer, np.concatenate(([0], ends[:-1])), ends - 1)
    assert [own.words()[k] for k in got] == [b"ab", b"cd", b"ab"]


def test_lattice_equals_brute_force(spark, docs):
    names, logs = lattice.public_pieces(vocabulary(PIECE_BPE))
    index = {p: i for i, p in enumerate(names)}

    def spelled(word: bytes) -> float:
        word, ways = b" " + word, [1.0]
        for j in range(1, len(word) + 1):
            ways.append(sum(ways[i] * np.exp(logs[index[word[i:j]]]) for i in range(max(0, j - 30), j) if word[i:j] in index))
        return np.log10(ways[-1])

    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    short = docs.filter("doc_id IS NULL OR doc_id <> 5")  # doubles cannot hold the product of 200,000 pieces
    got = lattice.lattice_scores(short, names, logs, held, rounds=0, whole_words=False, block_bytes=64).collect()
    texts = [(i, lower(t or "")) for i, t in TEXTS if i != 5]
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    split = {k: t.encode().split() for k, (_, t) in enumerate(texts)}
    train = Counter(w for k, (i, _) in enumerate(texts) if not out[i] for w in split[k])
    ends = sum(not out[i] for i, _ in texts)
    n, v = sum(train.values()) + ends, len(train) + 1
    want = [(i, out[i], len(split[k]) + 1, sum(train[w] > 0 for w in split[k]) + 1,
             sum(np.log10((train[w] + 1) / (n + v + 1)) for w in split[k]) + np.log10((ends + 1) / (n + v + 1)),
             sum(map(spelled, split[k])) - np.log10(len(names) + 1)) for k, (i, _) in enumerate(texts)]
    key = lambda r: (str(r[0]), r[2], r[4])
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert {r.train_tokens for r in got} == {n}


@pytest.mark.parametrize("most_tasks", [50_000, 3])
def test_registered_lattice_equals_brute_force(spark, docs, monkeypatch, most_tasks):
    monkeypatch.setattr(lattice, "MOST_TASKS", most_tasks)
    names, first = lattice.public_pieces(vocabulary(PIECE_BPE))
    texts = [(i, lower(t or "").encode().split()) for i, t in TEXTS if i != 5]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    train = Counter(w for o, (_, words) in zip(out, texts) if not o for w in words)
    ends = out.count(False)
    n, v = sum(train.values()) + ends, len(train) + 1
    weight = dict(zip(names, np.exp(first)))

    def sums(word: bytes) -> tuple[list[float], list[float]]:
        ahead, behind = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        for j in range(1, len(word) + 1):
            ahead[j] = sum(ahead[i] * weight.get(word[i:j], 0.0) for i in range(j))
        for i in range(len(word) - 1, -1, -1):
            behind[i] = sum(weight.get(word[i:j], 0.0) * behind[j] for j in range(i + 1, len(word) + 1))
        return ahead, behind

    for _ in range(lattice.ROUNDS):  # pieces are fitted to distinct training words, each once
        expected = dict.fromkeys(names, lattice.PRIOR)
        for word in (b" " + w for w in train):
            ahead, behind = sums(word)
            for i in range(len(word)):
                for j in range(i + 1, len(word) + 1):
                    if word[i:j] in weight:
                        expected[word[i:j]] += ahead[i] * weight[word[i:j]] * behind[j] / ahead[-1]
        total = sum(expected.values())
        weight = {p: e / total for p, e in expected.items()}
    spelled = {w: np.log10(sums(b" " + w)[0][-1] * v / (n + v) + train[w] / (n + v)) for w in {w for _, words in texts for w in words}}
    short = docs.filter("doc_id IS NULL OR doc_id <> 5")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lattice.lattice_scores(short, names, first, held, block_bytes=256).collect()
    want = [(i, len(words) + 1, sum(spelled[w] for w in words) + np.log10(ends / (n + v))) for i, words in texts]
    key = lambda r: (str(r[0]), r[1], r[2])
    for a, b in zip(sorted([(r.doc_id, r.n_tokens, r.score) for r in got], key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_lattice_fits_and_sums_to_at_most_one(spark, docs, none):
    names, logs = lattice.public_pieces(vocabulary(PIECE_BPE))
    got = {(r.doc_id, r.n_tokens): r for r in lattice.lattice_scores(docs, names, logs, F.lit(False)).collect()}
    assert all(r.score < 0 and np.isfinite(r.score) for r in got.values()) and got[5, 2].n_known == 2
    assert lattice.lattice_scores(none, names, logs, F.lit(False)).count() == 0
    # Expected numbers of pieces spell the words they were counted on.
    _, expected = lattice.Vocabulary(names, logs).run([b"the", b"mat"], np.array([2.0, 3.0]))
    assert sum(e * len(p) for e, p in zip(expected, names)) == pytest.approx(2 * 4 + 3 * 4)


def test_repeated_units(docs, none):
    got = [(r.doc_id, r.unit, r.start, r.n_chars, r.keep_doc_id, r.keep_unit) for r in linehash.repeated_units(docs, min_words=3).collect()]
    seen, want, done = {}, [], set()
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None or (i, t) in done:
            continue
        done.add((i, t))
        at = 0
        for k, line in enumerate(t.split("\n")):
            plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")
            if len(plain.split(" ")) >= 3:
                if plain in seen:
                    want.append((i, k, at, len(line), *seen[plain]))
                else:
                    seen[plain] = (i, k)
            at += len(line) + 1
    same(got, want)
    assert linehash.repeated_units(none).count() == 0
    kept = {r.doc_id: r.text for r in linehash.line_dedup(docs, min_words=3).collect()}
    assert kept[9] == "Other start.\nFifth." and kept[4] == "" and kept[3] is None


def test_short_units_and_texts_without_spaces_go(spark):
    lines = ["日本語の長い行です。" * 20, "https://example.org/" + "a" * 200, "Yes.", "", " \t"]
    rows = spark.createDataFrame([(i, "\n".join([f"own line of {i}", *lines])) for i in (1, 2)], "doc_id long, text string")
    got = [(r.doc_id, r.unit, r.keep_doc_id, r.keep_unit) for r in linehash.repeated_units(rows).collect()]
    same(got, [(2, k, 1, k) for k in (1, 2, 3)])
    assert linehash.repeated_units(rows, min_words=5).count() == 0
    kept = {r.doc_id: r.text for r in linehash.line_dedup(rows).collect()}
    assert kept == {1: "\n".join(["own line of 1", *lines]), 2: "own line of 2\n\n \t"}


def test_texts_of_one_id_lose_only_their_own_units(spark):
    texts = [(None, "unique one\ntwice here\nunique three"), (None, "other one\nother two\ntwice here"),
             (5, "a first\nshared by both"), (5, "shared by both\na last"), (5, "shared by both\na last"), (None, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    left = linehash.line_dedup(rows).collect()
    lines = lambda i: Counter(x for r in left if r.doc_id == i and r.text is not None for x in r.text.split("\n"))
    assert lines(None) == Counter(["unique one", "twice here", "unique three", "other one", "other two"])
    assert lines(5)["a first"] == 1 and lines(5)["a last"] == 2 and lines(5)["shared by both"] in (1, 2)
    assert len(left) == len(texts) and linehash.line_dedup(rows).columns == ["doc_id", "text"]


def test_network_gradients_and_windows():
    net, own = toxicity.Network(1), lexicon.Lexicon()
    found, counts = toxicity._texts(own, [b"one two three four " * 20, b"a b", b""])
    place, text = toxicity.windows(counts)
    assert sorted(set(place[place >= 0])) == list(range(82)) and list(text) == [0, 0, 1, 2]
    place = np.where(place < 0, -1, np.append(found, -1)[place])
    features, weights = toxicity.word_features(own.words()), np.array([1.0, -2.0, 0.5, 1.5])
    x, _ = net.inputs(features)
    gradient, d_gates = net.backward(net.forward(net.gates(x), place, True)[1], weights, len(own))
    gradient["wx"] = x.T[None] @ d_gates
    for name, by in gradient.items():
        values, at = net.p[name], tuple(s // 2 for s in net.p[name].shape)
        pair = []
        for step in (1e-5, -2e-5):
            values[at] += step
            pair.append(net.forward(net.gates(net.inputs(features)[0]), place) @ weights)
        values[at] += 1e-5
        if name != "bx":  # places past the end have the bias for their gates, too
            assert (pair[0] - pair[1]) / 2e-5 == pytest.approx(by[at], rel=1e-3, abs=1e-8)


def test_network_is_a_plain_recurrence():
    """The same network, a word and a window at a time."""
    net, own, h = toxicity.Network(3), lexicon.Lexicon(), toxicity.HIDDEN
    found, counts = toxicity._texts(own, [b"one two three four five " * 30, b"a b", b""])
    place, _ = toxicity.windows(counts)
    place = np.where(place < 0, -1, np.append(found, -1)[place])
    gates = net.gates(net.inputs(toxicity.word_features(own.words()))[0])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for got, window in zip(net.forward(gates, place), place):
        steps = len(window)
        states = np.zeros((steps, 2 * h))
        for way, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                x, hu = gates[way][window[t]], state @ net.p["u"][way]
                z, r = sigmoid(x[:h] + hu[:h]), sigmoid(x[h:2 * h] + hu[h:2 * h])
                new = np.tanh(x[2 * h:] + r * hu[2 * h:])
                state = (1 - z) * new + z * state
                states[t, way * h:(way + 1) * h] = state
        scores = np.array([np.tanh(s @ net.p["wa"] + net.p["ba"]) @ net.p["va"] if w >= 0 else -np.inf for s, w in zip(states, window)])
        if np.isinf(scores).all():
            scores[:] = 0
        weight = np.exp(scores - scores.max())
        assert got == pytest.approx(float((weight / weight.sum()) @ states @ net.p["wo"] + net.p["bo"][0]), rel=1e-6, abs=1e-9)


def test_windows_overlap_by_half_and_long_texts_are_learned_from(monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_WINDOWS", 3)
    place, text = toxicity.windows(np.array([1000, 3]))
    for start in range(1000 - 32):
        assert any(start in set(w) and start + 31 in set(w) for w in place[text == 0]), start
    rng, words = np.random.default_rng(8), [b"tree", b"water", b"stone", b"light", b"green", b"house", b"walk", b"seven"]
    texts = []
    for k in range(120):
        text = [words[i] for i in rng.integers(0, 8, 300)]  # nine windows
        if k % 2:
            text[rng.integers(300)] = b"grumbo"
        texts.append(b" ".join(text))
    net = toxicity.train(texts, np.array([k % 2 for k in range(120)], float), least_steps=200)
    plain = b" ".join(words * 60)
    scores = toxicity.Scorer(net)([plain, plain + b" grumbo", plain[:300]])
    assert scores[1] > 0.5 > max(scores[0], scores[2])


def test_highest_windows_of_each_text():
    net, own = toxicity.Network(4), lexicon.Lexicon()
    found, counts = toxicity._texts(own, [b"a b c d e f g h i j k " * 90, b"x y", b"l m n o p q r s " * 70])
    place, text = toxicity.windows(counts)
    place = np.where(place < 0, -1, np.append(found, -1)[place])
    gates = net.gates(net.inputs(toxicity.word_features(own.words()))[0])
    logit, kept = net.forward(gates, place), toxicity.highest(net, gates, place, text, 5)
    for k in range(3):
        mine = [i for i in kept if text[i] == k]
        assert sorted(logit[mine]) == sorted(np.sort(logit[text == k])[-5:])


def test_toxicity_learns_and_keeps_clean_documents(spark, docs, none):
    rng = np.random.default_rng(5)
    plain = ["tree", "water", "stone", "light", "green", "house", "walk", "seven"]
    rows = []
    for i in range(400):
        words = list(rng.choice(plain, rng.integers(5, 150)))
        if i % 4 == 0:
            words[rng.integers(len(words))] = "grumbo" + rng.choice(["x", "ly", "zed", "tu"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(made, made, toxicity.training_rows())
    scored = toxicity.with_scores(made, net).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == r.toxic for r in held]) > 0.95
    odd = toxicity.with_scores(docs, net).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    labels = made.select("doc_id", "toxic").union(spark.sql("SELECT 1L, CAST(null AS INT)"))
    assert toxicity.toxicity_scores(none, labels).count() == 0
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns


def test_codes_read_any_token():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        codes = dac.Codes(dac.pack(ids))
        assert len(codes) == n and [codes[i] for i in range(n)] == ids.tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert codes.range(a, b).tolist() == ids[a:b].tolist()


def byte_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(BYTE_BPE))
    library.encode_special_tokens = True
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = ["a", "b1", " ", "  ", "\n", "\t", "é", "'s", " x", "<|endoftext|>", "日本", "!", "\r\n", "▁", "<s>", "\x00", "😀", "\x1c", "\x85", " ", ",", ".", "»", "\\"]


def odd_texts(n: int) -> list[str]:
    rng = np.random.default_rng(11)
    return ["".join(rng.choice(ODD, rng.integers(0, 14))) for _ in range(n)] + [t or "" for _, t in TEXTS]


def test_units_give_the_ids_of_whole_texts():
    texts, own = odd_texts(5000), dac.ByteEncoder(vocabulary(BYTE_BPE), room=500)
    got = [x.tolist() for at in range(0, len(texts), 100) for x in own([t.encode() for t in texts[at:at + 100]])]
    assert got == byte_ids(texts)


def test_units_are_encoded_alone_where_breaks_do_not_tell_them_apart():
    own = dac.ByteEncoder(vocabulary(BYTE_BPE))
    own.line = [(1 << 32) - 1]  # as in a vocabulary where a break is never a token of its own
    texts = [t for _, t in TEXTS if t and len(t) < 1000]
    got = own([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


def test_codes_of_documents(docs, none):
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    got = dac.roundtrip(docs, vocabulary(BYTE_BPE)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    ids = {t or "": [*x, 0] for (_, t), x in zip(rows, byte_ids([t or "" for _, t in rows]))}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(ids[t or ""]), crc(ids[t or ""])) for i, t in rows])
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    assert dac.roundtrip(none, vocabulary(BYTE_BPE)).count() == 0


def test_codes_query_equals_the_library_as_loaded(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(BYTE_BPE))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>\n<|endoftext|> y", "none here", "", None, "<|endoftext|", *odd_texts(300)]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_direct_codes"](spark, str(tmp_path)).orderBy("doc_id").collect()
    start = 0
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_agenda_equals_the_library():
    own, texts = pieces.Pieces(vocabulary(PIECE_BPE), room=500), odd_texts(5000)
    got = [x for at in range(0, len(texts), 100) for x in own.encode(texts[at:at + 100])]
    assert got == own.library.encode(texts)


def test_piece_digests(docs, none):
    library = pieces.pieces(vocabulary(PIECE_BPE)).library
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    same(pieces.piece_digests(docs, vocabulary(PIECE_BPE)).collect(), want)
    assert pieces.piece_digests(none, vocabulary(PIECE_BPE)).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs, vocabulary(PIECE_BPE)), vocabulary(PIECE_BPE)).collect()
    same([(r.doc_id, sha(r.text)) for r in back], [(w[0], w[3]) for w in want])


ITEMS = [(1, "the cat sat on the mat and looked at the dog for a long while"), (2, "looked at the dog"), (3, "Cat"), (4, ""), (5, None),
         (6, "the cat sat on the mat and looked at the dog for a long while"), (None, "short words many"), (7, " ".join(["same line here now ok"] * 5))]


def windows_of(window: int):
    found = {}
    for i, t in ITEMS:
        words = suffix.item_words((t or "").encode())
        size = min(window, len(words))
        for a in range(len(words) - size + 1) if words else ():
            found.setdefault(tuple(words[a:a + size]), set()).add(i)
    return found


@pytest.mark.parametrize("block_words", [100_000, 20])
def test_contamination_equals_brute_force(spark, docs, none, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found, want = windows_of(13), []
    for i, t in TEXTS:
        words, own = suffix.item_words((t or "").encode()), set()
        hit = [0] * len(words)
        for size in {len(w) for w in found}:
            for a in range(len(words) - size + 1):
                if items_ := found.get(tuple(words[a:a + size])):
                    own |= items_
                    hit[a:a + size] = [1] * size
        want.append((i, len(words), sum(hit), ",".join(sorted(str(x) for x in own if x is not None))))
    got = suffix.match_benchmark(docs, items, block_words=block_words).select(
        "doc_id", "n_words", suffix.hit_words().alias("h"), F.array_join("items", ",").alias("i")).collect()
    same(got, want)
    report = suffix.contamination_report(docs, items).collect()
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report], [
        (i, n, hit, len(own.split(",")) if own else 0, hashlib.sha256(own.encode()).hexdigest(), hit > 0 and 20 * hit >= n)
        for i, n, hit, own in want])
    assert suffix.match_benchmark(none, items).count() == 0
    assert suffix.match_benchmark(docs, items.limit(0)).filter(F.size("spans") > 0).count() == 0


def test_decontaminate_drops_and_cuts(spark, docs):
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    kept = suffix.decontaminate(docs, items)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in TEXTS if i not in (1, 2)])
    cut = suffix.decontaminate(docs, items, coverage=0, longest=4).filter("doc_id = 1").first()
    assert cut.text == "."
    assert suffix._cut("One, TWO three four!", [[1, 3]], 2) == "One,  four!"


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|im_end|> \\ <|"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello <|im_end|> \\ <|"),
    (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (None, 0, "ro\nle\\n", "日本 \n x"), (4, None, None, ""),
    (4, 1, "assistant", "a\\nb"), (4, 1, "assistant", "a\\nb"), (5, 0, "assistant", "z " * 9000), (6, 5, "user", "hi"),
]


def test_chats_come_back(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).repartition(3)
    want = {}
    for i, _, role, text in sorted(CHATS, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want.setdefault(i, []).append((role or "", text or ""))
    got = chat.roundtrip(rows, vocabulary(BYTE_BPE)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = {i: "".join(t for r, t in turns if r == "assistant") for i, turns in want.items()}
    same(got, [(i, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss[i]), sha(loss[i]),
                sum(len("".join(chat.formatted(r, t))) for r, t in turns)) for i, turns in want.items()])
    assert chat.roundtrip(rows.limit(0), vocabulary(BYTE_BPE)).count() == 0


def test_shared_turns_are_emitted_once_depth_first(spark, tmp_path):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    chat.write_chats(rows, str(tmp_path), vocabulary(BYTE_BPE))
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    nodes = nodes.join(chat.starts(nodes), "part").withColumn("start", F.col("before") + F.col("inside")).orderBy("start").collect()
    place = {bytes(n.node): n for n in nodes}
    assert len(place) == len(nodes) == 9
    assert [n.start for n in nodes] == np.concatenate(([0], np.cumsum([len(n.ids) for n in nodes])[:-1])).tolist()
    paths = {}
    for r in spark.read.parquet(f"{tmp_path}/paths").orderBy("conv_id", "place").collect():
        paths.setdefault(r.conv_id, []).append(place[bytes(r.node)])
    for path in paths.values():
        seen, position = [], 0
        for n in path:
            assert n.position == position
            assert [t for a, b in n.attention for t in range(a, b)] == sorted(seen) and all(t < n.start for t in seen)
            seen += range(n.start, n.start + len(n.ids))
            position += len(n.ids)


def test_any_tree_is_emitted_depth_first_by_short_keys(spark, tmp_path):
    turns = []
    for i in range(60):  # one conversation leaves a long chain at each turn
        turns += [(i, t, "user", f"turn {t}" if t < i else f"own {i}") for t in range(i + 1)]
    draw = np.random.default_rng(3)
    for i in range(100, 220):  # a random tree with whole repeats
        turns += [(i, t, "user", "abc"[k]) for t, k in enumerate(draw.choice(3, draw.integers(1, 7), p=[0.6, 0.3, 0.1]))]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    chat.write_chats(rows, f"{tmp_path}/all", vocabulary(BYTE_BPE))
    nodes = spark.read.parquet(f"{tmp_path}/all/nodes")
    order = [bytes(n.node) for n in nodes.orderBy("part", "inside").collect()]
    paths, parent = {}, {}
    for r in spark.read.parquet(f"{tmp_path}/all/paths").orderBy("conv_id", "place").collect():
        path = paths.setdefault(r.conv_id, [])
        parent[bytes(r.node)] = path[-1] if path else None
        path.append(bytes(r.node))
    assert len({tuple(t[2:]) for t in turns}) <= len(order) == len(parent) and set(order) == set(parent)
    stack = []
    for node in order:
        while stack and stack[-1] != parent[node]:
            stack.pop()
        assert (stack[-1] if stack else None) == parent[node]
        stack.append(node)
    walked = rows.selectExpr("conv_id AS conv", "turn", "role", "text")
    walked = chat._by_conversation(walked, "turn").mapInArrow(chat._walk(vocabulary(BYTE_BPE)), chat._WALKED)
    sizes = [(len(r.key) - 16) / 48 for r in chat._keys(walked)[1].collect()]
    assert len(sizes) == 180 and max(sizes) <= np.log2(180)


def test_adaptive_scan_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((3000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(10_000 + i, vectors[7].tolist()) for i in range(900)]
    # Of one id: other vectors, the same vector twice, no id at all, and fewer dimensions.
    rows += [(0, rows[0][1]), (1, rows[0][1]), (50, rows[9][1]), (50, rows[9][1]), (None, rows[100][1]), (None, rows[0][1]), (-5, [1.0]), (-50, rows[3][1][:7])]
    odd = [(-1, None), (-2, [0.0] * 24), (-3, [float("nan")] * 24), (-4, [None] * 24), (-6, [float("inf")] * 24), (-50, []), (0, [0.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("v", F.lit("x"))
    frame = frame.withColumn("row", F.lit(2)).repartition(3)
    ids = [r[0] for r in rows]
    all_ = np.array([r[1] + [0.0] * (24 - len(r[1])) for r in rows])
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)

    def by_hand(k):
        scores = np.round(unit @ unit[k], 12)
        order = sorted((j for j in range(len(rows)) if j != k), key=lambda j: (-scores[j], ids[j] is None, ids[j] or 0))[:5]
        return tuple((ids[j], scores[j]) for j in order)

    def answers(found):
        by = {}  # an id that asks twice has two answers; ranks tell them apart only together
        for r in found:
            by.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
        return {q: Counter(a) for q, a in by.items()}

    want = {}
    for k, name in enumerate(ids):
        if name is not None and name % 50 == 0:
            want.setdefault(name, Counter()).update((n, *a) for n, a in enumerate(by_hand(k), 1))
    asks = F.col("vec_id") % 50 == 0
    assert answers(scan.nearest(frame, asks, block_rows=500, probe=1.0, epsilon=1e9).collect()) == want
    got = answers(scan.nearest(frame, asks, block_rows=500).collect())
    assert set(got) == set(want)
    hits = sum(sum((Counter(i for _, i, _ in got[q].elements()) & Counter(i for _, i, _ in want[q].elements())).values()) for q in want)
    assert hits / sum(sum(c.values()) for c in want.values()) >= 0.9
    assert all(got[q] == want[q] for q in want if q >= 10_000)  # copies tie: the smaller ids come first
    few = scan.nearest(frame.filter("vec_id IN (0, 50, 60) AND embedding[0] <> 0 AND size(embedding) = 24"), asks).collect()
    assert Counter(r.query_id for r in few) == {0: 10, 50: 15} and all(r["rank"] <= 5 for r in few)
    assert scan.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_every_row_of_an_id_is_a_candidate(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = scan.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 5)) for r in got] == [(1, 0.99995), (1, 0.0)]


def chunks_of(text: str) -> list[tuple[int, list[str]]]:
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in lines]
    r = [h[i] ^ ((h[i - 1] << 1) if i else 0) for i in range(len(h))]
    out, first = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or 0 < i and r[i] < r[i - 1] and r[i] < r[i + 1]:
            out.append((first, lines[first:i + 1]))
            first = i + 1
    return out


def test_chunks_equal_brute_force(docs, none):
    seen, want, texts = {}, [], {}
    for i, t in sorted(set(TEXTS), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for k, (first, lines) in enumerate(chunks_of(t)) if t is not None else ():
            body = "\n".join(lines)
            if len(lines) > 1 and body in seen:
                want.append((i, k, first, len(lines), len(body), *seen[body]))
            else:
                kept.append(body)
                if len(lines) > 1:
                    seen[body] = (i, k)
        texts[i, t] = None if t is None else "\n".join(kept)
    assert want
    same(linechunks.chunk_report(docs).collect(), want)
    assert linechunks.chunk_report(none).count() == 0
    got = linechunks.chunk_dedup(docs)
    assert got.columns == docs.columns
    same([(r.doc_id, r.text) for r in got.collect()], [(i, texts[i, t]) for i, t in TEXTS])


def passages_of(texts: list[tuple[int, str]]) -> list[tuple]:
    """First line, lines and words of each repeated passage, from every pair of lines and every long line."""
    seen, found = set(), []
    for i, t in texts:
        lines, covered = t.split("\n"), []
        spans = [(k, k + 2) for k in range(len(lines) - 1)] + [(k, k + 1) for k, x in enumerate(lines) if len(x) > 250 or len(x.split()) > 50]
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if tuple(lines[a:b]) not in seen:
                seen.add(tuple(lines[a:b]))
            elif covered and a < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
        for a, b in covered:
            body = "\n".join(lines[a:b])
            if len(body) > 250 or len(body.split()) > 50:
                found.append((i, a, b - a, len(body.split()), len(body)))
    return found


def test_passages_are_found_wherever_chunks_end(spark, none):
    rng = np.random.default_rng(9)
    line = lambda n: " ".join("w%x" % x for x in rng.integers(0, 1 << 40, n))
    planted = [[line(60 // k + 1) for _ in range(k)] for k in (1, 2, 3, 4, 5, 6, 7, 8) for _ in range(5)]
    planted += [["日" * 150 + str(k), "本" * 150 + str(k)] for k in range(3)] + [["語" * 260]]
    texts = []
    for k, passage in enumerate(planted):
        for doc_id in (k, 1000 + k):
            texts.append((doc_id, "\n".join([*[line(7) for _ in range(3)], *passage, *([line(7)] if k % 2 else [])])))
    texts += [(2000, "\n".join(["again and again the same five words"] * 20)), (2001, ""), (2002, "a\nb"), (2003, "a\nb")]
    rows = spark.createDataFrame(texts + [texts[3], (None, None)], "doc_id long, text string").repartition(3)
    got = linechunks.passage_report(rows)
    found = [(r.doc_id, r.first_line, r.n_lines, r.n_words, r.n_chars) for r in got.collect()]
    same(found, passages_of(sorted(texts)))
    assert {i for i, *_ in found} == {*range(1000, 1000 + len(planted)), 2000}
    assert linechunks.passage_report(none.select("doc_id", "text")).count() == 0
    alone = {r.doc_id: r.text for r in linechunks.chunk_dedup(rows).collect()}
    kept = {r.doc_id: r.text for r in linechunks.repeat_dedup(rows).collect()}
    held = lambda of, k: set(planted[k]) & set((of[1000 + k] or "").split("\n"))
    assert any(held(alone, k) for k in range(len(planted))) and not any(held(kept, k) for k in range(len(planted)))
    assert {x for _, t in texts for x in t.split("\n")} == {x for t in kept.values() if t is not None for x in t.split("\n")}
    assert kept[None] is None and kept[2001] == ""


def print_of(text: str) -> int:
    words = lower(text).encode().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints_and_components(docs, none):
    texts = [(i, t) for i, t in TEXTS if i not in (5, 6)]
    got = simhash.simhash_components(docs.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)")).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{print_of(t or ''):016x}") for i, t in texts)
    of = {}
    for r in got:
        of.setdefault(r.fingerprint, set()).add(r.component_id)
    assert of["0" * 16] == {3} and all(len(c) == 1 for c in of.values())
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id IN (1, 2, 3, 4, 11)").collect()) == [1, 3]


def test_registered_components_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    texts = [(i, t or "") for i, t in TEXTS if i is not None]
    for k in range(12):  # chains of copies, each with a word of the one before changed
        words = [f"w{x}" for x in draw.integers(0, 500, 300)]
        for step in range(10):
            texts.append((1000 + 20 * k + step, " ".join(words)))
            words[draw.integers(0, 300)] = f"new{step}"
    prints = {t: print_of(t) for _, t in texts}
    group = {f: f for f in prints.values()}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= 3:
                group[top(a)] = top(b)
    least = {}
    for i, t in texts:
        least[top(prints[t])] = min(i, least.get(top(prints[t]), i))
    assert len(least) < len(group)  # some links are between different fingerprints
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = simhash.simhash_components(rows).select("doc_id", "fingerprint", "component_id").collect()
    same(got, [(i, f"{prints[t]:016x}", least[top(prints[t])]) for i, t in texts])


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    masks = simhash.covering_masks((1 << 64) - 1, 3)
    for _ in range(2000):
        differing = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & differing for m in masks)


def test_dense_buckets_lose_no_link(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 62, 3)]
    found = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (900, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 500)}
    prints = spark.createDataFrame([(f,) for f in found], "fp long")
    roots = {r.v: r.root for r in simhash.star_components(simhash.links(prints, limit=256)).collect()}
    values, parent = np.array(sorted(found)), {f: f for f in found}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, f in enumerate(values):
        for other in values[:k][np.bitwise_count(values[:k] ^ f) <= 3]:
            a, b = sorted((top(int(f)), top(int(other))))
            parent[b] = a
    assert {f: roots.get(f, f) for f in found} == {f: top(f) for f in found}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    from oracle import compare, duck

    frame = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        assert compare(frame, duck(DATA), ORACLE_SQL[name]) is None
    else:
        assert frame.count() > 0


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline

    plain = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), "score", "spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, DATA)
        assert kept.columns == odd.columns and 0 < kept.count() <= odd.count(), name
        assert stage(spark, odd.limit(0), DATA).count() == 0, name
    kept = corpus_pipeline.run(spark, DATA)
    assert 0 < kept.count() <= plain.count() and "ids_sha256" in kept.columns
