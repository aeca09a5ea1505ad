"""Joins that do not depend on how the keys are spread."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 0.02
# Of all rows, what one slot of a heavy key may hold.
SLOT_SHARE = 0.01
_SLOT = "_slot"
_SKETCH_ITEMS = 10_000


def planned_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a frame."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= limit


def heavy_shares(df: DataFrame, key: Column, share: float = HEAVY_SHARE) -> dict[int, float]:
    """Key hashes that each hold at least ``share`` of the rows, with the share: at most ``1/share``.

    One map-side sketch over the key columns. It only routes rows; a key the sketch
    over- or underrates takes the other, equally exact, route.
    """
    k = int(1 / share) + 1
    counted = df.select(key.alias("h")).agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(h, {k}, {_SKETCH_ITEMS})").alias("top"),
    )
    row = counted.first()
    floor = max(2, share * row.n)
    return {item["item"]: item["count"] / row.n for item in (row.top or []) if item["count"] >= floor}


def heavy_hashes(df: DataFrame, key: Column, share: float = HEAVY_SHARE) -> list[int]:
    """The key hashes of ``heavy_shares``."""
    return sorted(heavy_shares(df, key, share))


def slots_of(digest: Column, shares: dict[int, float], slot: float = SLOT_SHARE) -> Column:
    """In how many slots the rows of a key are dealt, so that none holds more than ``slot`` of all rows."""
    if not shares:
        return F.lit(1)
    slots = F.create_map(*[F.lit(x) for h, part in shares.items() for x in (h, max(1, math.ceil(part / slot)))])
    return F.coalesce(F.try_element_at(slots, digest), F.lit(1))


def row_hash(df: DataFrame) -> Column:
    """A number for each row by its values, the same when a lost task is run again."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def lookup_join(
    left: DataFrame, right: DataFrame | list[DataFrame], on: str | list[str], share: float = HEAVY_SHARE
) -> DataFrame:
    """``left`` left-joined to ``right``, or to each of several, which hold at most one row per key.

    A right side under the session's broadcast limit is left to Spark. Beyond it, the rows of
    heavy keys (null counts as a key) are dealt to slots by a hash of the row, as many as the key's
    share of all rows asks for, and the key's row on the right goes to each of its slots. So the
    left side is read once for the join, after one narrow pass over its keys, and moves once for all
    the right sides.
    """
    keys, rights = [on] if isinstance(on, str) else list(on), right if isinstance(right, list) else [right]
    small = {id(r): fits_broadcast(r) for r in rights}
    large = [r for r in rights if not small[id(r)]]
    digest = F.xxhash64(*[F.col(k) for k in keys])
    shares = heavy_shares(left, digest, share) if large else {}
    joined = left
    if shares:
        slots = slots_of(digest, shares)
        joined = left.withColumn(_SLOT, F.pmod(row_hash(left), slots).cast("int"))
        large = [r.withColumn(_SLOT, F.explode(F.sequence(F.lit(0), slots - 1))) for r in large]
    for one in large:
        joined = joined.join(one, [*keys, _SLOT] if shares else keys, "left")
    for one in rights:
        joined = joined.join(one, keys, "left") if small[id(one)] else joined
    columns = [*left.columns, *[c for r in rights for c in r.columns if c not in keys]]
    return joined.select(*keys, *[f"`{c}`" for c in columns if c not in keys])
