"""WARC archives, hard negatives and whitening against brute force, and on odd rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import hardneg, warc, whiten
from ledgerloom.llm.queries import QUERIES
from ledgerloom.session import shared_folder

# Names that the operators use for columns of their own.
CLASHES = ("row", "body", "sha", "n", "keep", "page", "id", "named", "v", "part", "x", "dim", "anchor")


def frame(spark, rows, kinds: str):
    fields = [T.StructField(*k) for k in zip(kinds.split()[::2], ({"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "floats": T.ArrayType(T.DoubleType())}[k] for k in kinds.split()[1::2]))]
    schema = T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in CLASHES]])
    return spark.createDataFrame([(*r, *["c"] * len(CLASHES)) for r in rows], schema).repartition(3)


# WARC

LONG, SHARED = "<p>" + "long page " * 40_000, "é" * 500
PAGES = [
    (1, "http://a/1", SHARED), (2, "http://a/2", SHARED), (2, "http://a/2", SHARED), (7, None, SHARED), (7, "http://a/7", SHARED),
    (None, "http://a/none", SHARED), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://a/5", None), (6, "http://a/6", ""),
    (8, "http://a/8?q=%20\r\nWARC-Type: x\t", "x" * 999), (9, "http://a/9", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000),
    (12, "u", LONG), (-13, "u", LONG), (14, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 \x00" * 200),
]


def pages_by_hand(pages):
    """Rows of the contract: the last of equal bodies by id answers, in the order of ids with null first."""
    out, rest = [], Counter()
    for page, _, body in sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0), reverse=True):
        data = (body or "").encode()
        rest[data] += 1
        revisit = len(data) >= 1000 and rest[data] > 1
        newest = max((p[0] for p in pages if (p[2] or "").encode() == data and p[0] is not None), default=None)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", newest if revisit else None))
    return out


def test_pages_come_back_from_archives(spark):
    pages = frame(spark, PAGES, "page_id long url string html string")
    assert Counter(map(tuple, warc.roundtrip(pages).collect())) == Counter(pages_by_hand(PAGES))
    assert warc.roundtrip(pages.limit(0)).collect() == []


def test_archives_are_gzip_members_of_whole_records(spark):
    pages = frame(spark, PAGES, "page_id long url string html string")
    archives = warc.write_warc(pages, shared_folder(spark, "test-warc"), archive_bytes=2000)
    found = archives.collect()
    assert sum(a.n_records for a in found) == len(PAGES) + len(found) and len(found) > 3
    for a in found:
        with open(a.path.removeprefix("file://"), "rb") as file:
            raw = file.read()
        assert len(raw) == a.n_bytes and gzip.decompress(raw).count(b"\r\nWARC-Record-ID: ") == a.n_records
    rows = [r for r in warc.read_warc(archives, payload=True).collect() if r.record_type != "warcinfo"]
    full = {p: r.payload for r in rows if r.record_type == "response" for p in [r.record_id]}
    # Every page's body, of a revisit by way of the record that it names, and the URL as it was.
    got = Counter(((full[r.refers_to_id] if r.refers_to_id else r.payload).decode(), r.url) for r in rows)
    assert got == Counter((h or "", u) for _, u, h in PAGES)


def test_query_of_pages_has_a_row_each(spark):
    got = QUERIES["op11_warc"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


class Trickle(io.BytesIO):
    """A file that hands out a few bytes at a time."""

    def read(self, size=-1):
        return super().read(min(size, 7) if size > 0 else size)


def members():
    return [warc.page_record(k, k, f"http://h/{k}", f"body {k}".encode() * 50, (1, 1) if k == 3 else None, "2000-01-01T00:00:00Z") for k in range(5)]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 16])
def test_reader_needs_no_more_than_a_piece(piece):
    got = list(warc.records(Trickle(b"".join(members())), payload=True, piece=piece))
    assert [r["payload"] for r in got] == [None if k == 3 else f"body {k}".encode() * 50 for k in range(5)]
    assert [r["offset"] for r in got] == np.cumsum([0, *map(len, members()[:-1])]).tolist()
    assert got[3]["payload_bytes"] == 300 and got[3]["payload_digest"] == hashlib.sha1(b"body 3" * 50).hexdigest()


def broken(kind: str) -> bytes:
    all_ = members()
    plain = gzip.decompress(all_[2])
    if kind == "cut":
        return b"".join(all_[:2]) + all_[2][:-20]
    if kind == "flipped":
        return b"".join(all_[:2]) + all_[2][:60] + bytes([all_[2][60] ^ 255]) + all_[2][61:] + b"".join(all_[3:])
    new = {"digest": plain.replace(b"body 2body 2", b"body 2body X"), "longer": plain.replace(b"Content-Length: 363", b"Content-Length: 400"),
           "shorter": plain.replace(b"body 2body 2", b"body 2body 2!!"), "no length": plain.replace(b"Content-Length: 3", b"Content-Size: 3"),
           "not warc": b"GET / HTTP/1.1\r\n\r\n", "empty": b""}[kind]
    assert new != plain
    return b"".join([*all_[:2], gzip.compress(new), *all_[3:]])


@pytest.mark.parametrize("kind", ["cut", "flipped", "digest", "shorter", "no length", "not warc", "empty"])
def test_damage_is_named_and_reading_goes_on(kind):
    raw = broken(kind)
    with pytest.raises(warc.Damaged, match=f"byte {sum(map(len, members()[:2]))}"):
        list(warc.records(io.BytesIO(raw)))
    got = list(warc.records(io.BytesIO(raw), strict=False))
    assert [r["offset"] for r in got if r["error"]] == [sum(map(len, members()[:2]))]
    assert len([r for r in got if not r["error"]]) == (2 if kind == "cut" else 4)


# Hard negatives


def negatives_by_hand(rows, positives=5, negatives=3):
    usable = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows
              if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, v) for i, l, v in usable]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, l, v) in enumerate(usable):
        if i is None or i % 50:
            continue
        scored = [(sum(map(int.__mul__, v, w)), j, m) for b, (j, m, w) in enumerate(usable) if b != a]
        near = sorted((s for s in scored if s[2] == l), key=lambda s: (-s[0], last(s[1])))[:positives]
        for p, j, _ in near:
            far = sorted((s for s in scored if s[2] != l and 50 * p <= 100 * s[0] <= 95 * p), key=lambda s: (-s[0], last(s[1])))[:negatives]
            out += [(i, j, r, k, p, s) for r, (s, k, _) in enumerate(far, 1)]
    return out


def vectors_like(n, size, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.standard_normal(size) * scale + 0.3).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def mined(spark, rows, **more):
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    df = frame(spark, rows, "vec_id long embedding floats label int")
    return hardneg.hard_negatives(df, vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label), **more)


@pytest.mark.parametrize("size, scale", [(1, 1.0), (64, 0.1), (70, 1.0), (8, 1e6)])
def test_hard_negatives_equal_brute_force(spark, size, scale):
    rows = vectors_like(260, size, size, scale)
    rows += [r for r in rows[:60]] + [(0, [0.0] * size, 1), (50, [0.5] * size, None), (50, None, 2), (100, [math.nan] * size, 1),
                                     (150, [None] * size, 1), (None, [0.4 * scale] * size, 0), (None, [0.4 * scale] * size, 1), (200, [math.inf] * size, 1)]
    rows += [(1000 + k, [0.25 * scale] * size, k % 2) for k in range(40)] + [(250, [0.25 * scale] * size, 0)]
    got = Counter(map(tuple, mined(spark, rows, block_rows=64).collect()))
    assert got == Counter(negatives_by_hand(rows))


def test_hard_negatives_of_odd_tables(spark):
    assert mined(spark, []).collect() == []
    assert mined(spark, [(50, [], 1), (1, [], 1), (2, [], 3)]).collect() != []  # all scores are zero
    assert mined(spark, [(50, [1.0], 1)]).collect() == []
    # A shorter vector counts as filled up with zeros.
    rows = [(50, [1.0, 1.0], 1), (3, [1.0], 1), (5, [0.75], 2), (4, [0.9, 0.0, 5.0], 2)]
    assert Counter(map(tuple, mined(spark, rows).collect())) == Counter([(50, 3, 1, 4, 65536, 230 * 256), (50, 3, 2, 5, 65536, 192 * 256)])
    # Beyond a long, scores stand at its ends.
    huge = [(50, [1e300], 1), (1, [1e300], 1), (2, [1e-2], 2), (3, [3e7], 2)]
    assert [r.negative_id for r in mined(spark, huge).collect()] == []
    assert [tuple(r) for r in mined(spark, [(50, [6e7], 1), (1, [1e300], 1), (2, [1e9], 2), (3, [3e7], 2)]).collect()] == []


def test_intervals_hold_the_score_and_drop_rows():
    rng = np.random.default_rng(5)
    rows, query = rng.integers(-80, 80, (3000, 64)), rng.integers(-80, 80, 64)
    words, align, left = hardneg.codes(rows.astype(float))
    planes = hardneg.Planes(hardneg.turned(query[None].astype(float))[0], float(np.linalg.norm(query)))
    score, true = np.zeros(3000), rows @ query
    error, shrink = np.zeros(3000), []
    for level in range(hardneg.LEVELS):
        dot = planes.against(words[:, level])
        unit = np.where(np.unpackbits(words[:, level].view(np.uint8), axis=1, bitorder="little")[:, :64] == 1, 1, -1) / 8
        exact = unit @ hardneg.turned(query[None].astype(float))[0]
        assert (np.abs(dot - exact) <= planes.error + 1e-9).all()
        score, error = score + align[:, level] * dot, error + np.abs(align[:, level]) * planes.error
        across = np.sqrt(np.maximum(planes.square - np.maximum(np.abs(dot) - planes.error, 0) ** 2, 0))
        reach = error + left[:, level] * across
        assert (np.abs(score - true) <= reach + 1e-6).all()
        shrink.append((np.abs(true - true.max()) > 2 * reach).mean())
    assert shrink[-1] > 0.5  # most rows are told from the best without scoring them


# Whitening


def check_whitening(spark, rows, components=8):
    got = whiten.whitened(frame(spark, rows, "vec_id long embedding floats"), components).collect()
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max(map(len, (v for _, v in kept)))
    x = np.array([[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (size - len(v))]] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    y = (away / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > values.sum() * 1e-13).sum()))
    assert len(got) == n * count and {r.component for r in got} == set(range(1, count + 1)) and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 for r in got)
    exact = Counter((i, int(d)) for (i, _), d in zip(kept, (away * away).sum(axis=1)))
    for k in range(count):
        mine = [r for r in got if r.component == k + 1]
        assert Counter((r.vec_id, int(r.deviation_exact)) for r in mine) == exact
        assert all(r.deviation == (int(r.deviation_exact) if int(r.deviation_exact) < 2**63 else None) for r in mine)
        assert all(abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9 for r in mine)
        w = np.sort(y @ vectors[:, k] / np.sqrt(values[k]))
        own = np.sort([r.whitened for r in mine])
        assert min(np.abs(own - w).max(), np.abs(own + w[::-1]).max()) < 1e-8


@pytest.mark.parametrize("n, size", [(400, 64), (30, 20), (12, 40), (50, 1), (500, 9)])
def test_whitening_equals_a_dense_solver(spark, n, size):
    rng = np.random.default_rng(n)
    rows = [(int(i), (rng.standard_normal(size) * np.linspace(1, 2, size)).tolist()) for i in range(n)]
    check_whitening(spark, rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 20, rng.standard_normal(6).tolist()) for k in range(100)] + [(None, [0.5] * 6), (3, None), (4, [math.nan] * 6), (5, [None] * 6),
            (6, [math.inf] + [0.0] * 5), (7, [1.0, 2.0]), (8, []), *[(9, [0.25] * 6)] * 60]
    check_whitening(spark, rows)


def test_whitening_of_large_entries_is_exact(spark):
    rng = np.random.default_rng(4)
    check_whitening(spark, [(k, (rng.standard_normal(4) * 1e13).tolist()) for k in range(40)])
    whiten.whitened(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long embedding floats")).collect()


def test_whitening_without_variance_has_no_components(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten.whitened(frame(spark, rows, "vec_id long embedding floats")).collect() == []


@pytest.mark.parametrize("size, spread", [(40, "flat"), (120, "falling"), (30, "equal")])
def test_solver_reaches_double_precision(size, spread):
    rng = np.random.default_rng(size)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = {"flat": np.linspace(1, 1.5, size), "falling": 0.7 ** np.arange(size), "equal": np.repeat([3.0, 2.0, 1.0], size // 3)}[spread]
    matrix = (turn * values) @ turn.T
    got, vectors = whiten.jacobi_davidson(lambda b: matrix @ b, size, 6)
    assert np.abs(got - np.sort(values)[::-1][:6]).max() < 1e-13 * values.max()
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 2e-13 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-13
