"""Counts, sums, top lists and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import as_double, as_money, clamp, total, whole_amount, whole_text
from ledgerloom.functions.text import cut, label_or, named
from ledgerloom.operators.predicates import nonempty_key
from ledgerloom.operators.skew import lookup_join
from ledgerloom.operators.windows import last_wins, ranked
from ledgerloom.sources.csv_files import file_order


def _unit(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def sum_lenient(df: DataFrame, column: str) -> DataFrame:
    """Sum of the parseable values; 0 when the column is absent or nothing parses.

    Finite values of 1e26 and more, beyond exact money, are added up as doubles. The sum is null if
    it does not fit DECIMAL(38,2).
    """
    if column not in df.columns:
        return _unit(df).select(F.lit(0).cast("decimal(38,2)").alias("total"))
    money, value = as_money(df, column), as_double(df, column)
    beyond = F.when(money.isNull() & (F.abs(value) < F.lit(float("inf"))), value)
    sums = df.agg(F.coalesce(total(money), F.lit(0)).cast("decimal(38,2)").alias("exact"), F.sum(beyond).alias("beyond"))
    both = F.try_add("exact", F.col("beyond").try_cast("decimal(38,2)"))
    return sums.select(F.when(F.col("beyond").isNull(), F.col("exact")).otherwise(both).cast("decimal(38,2)").alias("total"))


def overview_kpis(frames: dict[str, DataFrame]) -> DataFrame:
    """Five row counts and two whole-number totals, one scan per table."""
    facts = {
        "tx": frames["fact_transactions"].agg(
            F.count("*").alias("n"), total(as_money(frames["fact_transactions"], "amount")).alias("s")
        ),
        "loans": frames["fact_loans"].agg(
            F.count("*").alias("n"), total(as_money(frames["fact_loans"], "principal_amount")).alias("s")
        ),
    }
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    whole = lambda df: F.coalesce(df.select("s").scalar(), F.lit(0)).cast("bigint")
    return _unit(frames["fact_transactions"]).select(
        count(frames["dim_customers"]).alias("customers"),
        count(frames["dim_accounts"]).alias("accounts"),
        facts["tx"].select("n").scalar().alias("transactions"),
        facts["loans"].select("n").scalar().alias("loans"),
        count(frames["fact_fraud_alerts"]).alias("fraud_alerts"),
        whole(facts["tx"]).alias("transaction_volume_ugx"),
        whole(facts["loans"]).alias("loan_principal_ugx"),
    )


# Labels of the entity-count chart, in chart order.
ENTITIES = [
    ("Customers", "dim_customers"), ("Accounts", "dim_accounts"), ("Txns", "fact_transactions"),
    ("Loans", "fact_loans"), ("Fraud", "fact_fraud_alerts"),
]


def entity_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(ord, label, value) with one row per entity."""
    parts = [
        frames[table].agg(F.count("*").cast("double").alias("value"))
        .select(F.lit(i).alias("ord"), F.lit(label).alias("label"), "value")
        for i, (label, table) in enumerate(ENTITIES, 1)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as labelled rows (UNION ALL)."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        out = row if out is None else out.unionByName(row)
    return out


def top_merchants(
    tx: DataFrame, merchants: DataFrame | None, limit: int = 5, seq: str | None = None
) -> DataFrame:
    """Merchants by transaction count, then by the sum of truncated amounts.

    Only the ``limit`` winners are looked up in the merchant dimension. Without a merchant
    dataset (None) there is no list.
    """
    if merchants is None:
        return _unit(tx).filter("false").select(
            F.lit("").alias("merchant_id"), F.lit("").alias("merchant_name"),
            F.lit(0).cast("bigint").alias("transaction_count"),
            F.lit(0).cast("bigint").alias("total_amount_ugx"),
        )
    amount = whole_amount(tx, "amount")
    best = (
        nonempty_key(tx, "merchant_id").groupBy("merchant_id")
        .agg(F.count("*").alias("transaction_count"), F.sum(amount).alias("total_amount_ugx"))
        .orderBy(F.desc("transaction_count"), F.desc("total_amount_ugx"), "merchant_id")
        .limit(clamp(limit, 1, 20))
    )
    return named_merchants(best, merchants, seq).select(
        "merchant_id", "merchant_name", "transaction_count", "total_amount_ugx"
    )


def named_merchants(
    df: DataFrame, merchants: DataFrame, seq: str | None, many: bool = False
) -> DataFrame:
    """Add ``merchant_name``: last dimension row wins, the id stands in for no match.

    ``seq`` orders the dimension's rows (their order in its files when not given);
    ``many`` says that ``df`` may hold many rows per merchant.
    """
    order = file_order(merchants) if seq is None else F.col(seq)
    if "merchant_name" not in merchants.columns:
        merchants = merchants.withColumn("merchant_name", F.col("merchant_id").cast("string"))
    names = last_wins(merchants.withColumn("_seq", order), "merchant_id", "merchant_name", "_seq")
    joined = lookup_join(df, names, "merchant_id") if many else df.join(names, "merchant_id", "left")
    return joined.withColumn(
        "merchant_name", F.coalesce("merchant_name", F.col("merchant_id").cast("string"))
    )


LABEL_WIDTH = 24


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Top-k (ord, label, value) of a categorical column; labels are cut after counting."""
    return category_counts(df, {column: k}).select("ord", "label", "value")


def label_parts(
    df: DataFrame, columns: dict[str, str], amount: Column | None = None, total: tuple[str, str] | None = None,
    ids: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (and an amount sum) per raw value of several columns, in one pass.

    ``columns`` maps a kind to a column; ``total`` is the kind and label of one more row for
    the whole table. Returns kind, label, n, amt. Only distinct raw values are stripped to
    labels, so a label may come in several rows, to be summed by the caller; blank values
    are labelled ``(empty)``. The kinds in ``ids`` are keys: they are not stripped, and only null and the empty
    text count as blank.
    """
    kinds = list(columns)
    keys = [f"k{i}" for i in range(len(kinds))]
    base = df.select(
        *[named(c).alias(k) for c, k in zip(columns.values(), keys)],
        *([] if amount is None else [amount.alias("amount")]),
    )
    measures = [
        F.count("*").alias("n"),
        (F.lit(None).cast("bigint") if amount is None else F.sum("amount")).alias("amt"),
    ]
    if len(keys) + bool(total) == 1:
        raw = base.groupBy(*keys).agg(*measures).withColumn("kept", F.lit(0 if keys else -1))
    else:
        # Bit i of the id, from the left, says that column i was rolled up.
        everything = (1 << len(keys)) - 1
        kept = F.coalesce(*[
            F.when(F.col("id") == everything - (1 << (len(keys) - 1 - i)), i) for i in range(len(keys))
        ], F.lit(-1))
        raw = (
            base.groupingSets([[k] for k in keys] + ([[]] if total else []), *keys)
            .agg(*measures, F.grouping_id().alias("id")).withColumn("kept", kept)
        )
    all_kind, all_label = total or ("", "")
    labels = [
        F.when(F.col("kept") == i, F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("(empty)")) if kind in ids else label_or(F.col(k), "(empty)"))
        for i, (kind, k) in enumerate(zip(kinds, keys))
    ]
    names = [F.when(F.col("kept") == i, k) for i, k in enumerate(kinds)]
    return raw.select(
        F.coalesce(*names, F.lit(all_kind)).alias("kind"),
        F.coalesce(*labels, F.lit(all_label)).alias("label"), "n", "amt",
    )


def best_labels(parts: DataFrame, limits: dict[str, int], by_amount: str = "") -> DataFrame:
    """The top labels of each kind as ord 1..limit; ties of ``by_amount`` go to the amount."""
    counted = parts.groupBy("kind", "label").agg(F.sum("n").alias("n"), F.sum("amt").alias("amt"))
    limit = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in limits.items()])
    amount = F.when(F.col("kind") == by_amount, F.col("amt"))
    order = [F.desc("n"), *([F.desc(amount)] if by_amount else []), F.col("label")]
    return ranked(counted, max(limits.values()), F.col("kind"), *order).filter(F.col("ord") <= limit)


def category_counts(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Top values of several columns in one pass: (column, ord, label, value)."""
    wanted = {c: k for c, k in limits.items() if c in df.columns}
    if not wanted:
        return _unit(df).filter("false").selectExpr(
            "'' AS `column`", "0 AS ord", "'' AS label", "CAST(0 AS DOUBLE) AS value"
        )
    return best_labels(label_parts(df, {c: c for c in wanted}), wanted).select(
        F.col("kind").alias("column"), "ord", cut(F.col("label"), LABEL_WIDTH).alias("label"),
        F.col("n").cast("double").alias("value"),
    )


def histogram(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """Equal-width (ord, label, value) bins; the last is closed, empty bins count 0.

    Blank cells count as 0, unparseable ones are left out. The bounds are scalar
    subqueries, so placing a value needs no join; bins merge map-side, and what is left
    to lay out is one row of at most ``bins`` counts.
    """
    if column not in df.columns:
        return _unit(df).filter("false").selectExpr(
            "1 AS ord", "'' AS label", "CAST(0 AS DOUBLE) AS value"
        )
    bins = max(1, bins)
    values = df.select(as_double(df, column, blank=0.0).alias("v")).filter(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    slot = F.coalesce(F.floor(F.try_divide(F.col("v") - lo, (hi - lo) / bins)), F.lit(0))
    counted = (
        values.select("v", F.least(slot, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"),
        )
    )
    shown = (
        F.when(F.col("lo").isNull(), F.array().cast("array<int>"))
        .when(F.col("lo") == F.col("hi"), F.array(F.lit(0)))
        .otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    laid_out = counted.select(
        "lo", "hi", "n", ((F.col("hi") - F.col("lo")) / bins).alias("step"),
        F.explode(shown).alias("bin"),
    )
    edges = F.concat(
        whole_text(F.col("lo") + F.col("bin") * F.col("step")), F.lit("-"),
        whole_text(F.col("lo") + (F.col("bin") + 1) * F.col("step")),
    )
    single = F.col("lo").cast("bigint").cast("string")
    return laid_out.select(
        (F.col("bin") + 1).alias("ord"),
        F.when(F.col("lo") == F.col("hi"), single).otherwise(edges).alias("label"),
        F.coalesce(F.try_element_at("n", F.col("bin")), F.lit(0)).cast("double").alias("value"),
    )
