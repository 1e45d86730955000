"""Profiling and data-quality tables. Wide one-pass aggregates, turned into rows afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.numbers import count_rows, count_where, rate_pct, round_half_up
from riskflow.operators.cleaning import iqr_bounds
from riskflow.operators.ordered import exact_quantiles
from riskflow.schema import CURRENCIES, MAX_AMOUNT, PAYMENT_FORMATS


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def rows_of(one: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One aggregate row to several rows."""
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Total and distinct row counts; equal rows are combined before the shuffle."""
    groups = df.groupBy(*(columns or df.columns)).agg(count_rows().alias("copies"))
    return groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), count_rows().alias("distinct_rows"))


def health_dashboard(df: DataFrame) -> DataFrame:
    kinds = [f.dataType for f in df.schema.fields]
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    one = df.agg(count_rows().alias("n"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells")).crossJoin(distinct_rows(df))
    def count_kind(*types: type) -> Column:
        return F.lit(sum(isinstance(k, types) for k in kinds)).cast("long")
    metrics = [
        ("Total Rows", F.col("n")), ("Total Columns", F.lit(len(kinds)).cast("long")),
        ("Numeric Columns", count_kind(T.NumericType)), ("Categorical Columns", count_kind(T.StringType)),
        ("Datetime Columns", count_kind(T.TimestampType, T.TimestampNTZType, T.DateType)),
        ("Boolean Columns", count_kind(T.BooleanType)), ("Null Cells", F.col("null_cells").cast("long")),
        ("Duplicate Rows", F.col("rows") - F.col("distinct_rows"))]
    return rows_of(one, [F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in metrics])


def missing_values(df: DataFrame) -> DataFrame:
    one = df.agg(count_rows().alias("_n"), *[count_where(F.col(c).isNull()).alias(c) for c in df.columns])
    table = rows_of(one, [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing"), F.col("_n").alias("n")) for c in df.columns])
    share = F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("n")), F.lit(0.0))
    level = F.when(share == 0, 0).when(share < 5, 1).when(share < 20, 2).otherwise(3)
    severity = F.array(F.lit("Informational"), F.lit("Low"), F.lit("Medium"), F.lit("High"))
    action = F.array(F.lit("None required"), F.lit("Impute median / mode"), F.lit("Flag with indicator column"),
                     F.lit("Investigate source pipeline / Drop if non-critical"))
    return table.select("column_name", "missing", round_half_up(share).alias("missing_pct"), severity[level].alias("severity"),
                        action[level].alias("recommended_action")).orderBy(F.desc("missing"), "column_name")


def duplicates(df: DataFrame, key: str = "transaction_id", pair: Sequence[str] = ("from_account", "to_account")) -> DataFrame:
    parts = [("Exact Rows", df.columns, False), ("Transaction IDs", [key], False), ("Account Pairs", list(pair), True)]
    out = None
    for name, columns, informational in parts:
        one = distinct_rows(df, columns)
        extra = F.col("rows") - F.col("distinct_rows")
        share = F.coalesce(rate_pct(extra, F.col("rows")), F.lit(0.0))
        severity = F.lit("Informational") if informational else (
            F.when(share > 10, "Critical").when(share > 5, "High").when(share > 1, "Medium").when(share > 0, "Low").otherwise("Passed"))
        row = one.select(F.lit(name).alias("duplicate_type"), extra.alias("count"), share.alias("pct_of_dataset"),
                         severity.alias("severity"))
        out = row if out is None else out.unionByName(row)
    return out


def domain_rules(df: DataFrame, as_of: str, currencies: Sequence[str] = CURRENCIES, formats: Sequence[str] = PAYMENT_FORMATS,
                 max_amount: float = MAX_AMOUNT, key: str = "transaction_id") -> DataFrame:
    """Violations per rule with the smallest offending id as the sample record."""
    paid = F.col("amount_paid")
    broken = paid.isNull()
    if isinstance(df.schema["amount_paid"].dataType, (T.DoubleType, T.FloatType)):
        broken = broken | F.isnan(paid)
    rules = [
        ("negative_amounts", paid < 0, "Critical"),
        ("zero_amounts", paid == 0, "Low"),
        ("nan_inf_amounts", broken, "Critical"),
        ("exceeds_max_limit", paid > F.lit(max_amount), "High"),
        ("negative_received_amounts", F.col("amount_received") < 0, "Critical"),
        ("same_sender_receiver", F.col("from_account") == F.col("to_account"), "Critical"),
        ("invalid_currencies_count", ~F.col("payment_currency").isin(list(currencies)), "High"),
        ("invalid_payment_formats_count", ~F.col("payment_format").isin(list(formats)), "Medium"),
        ("future_timestamps_count", F.col("ts") > F.lit(as_of).cast("timestamp_ntz"), "High"),
    ]
    one = df.agg(
        *[count_where(bad).alias(f"n_{name}") for name, bad, _ in rules],
        *[F.min(F.when(bad, F.col(key))).alias(f"s_{name}") for name, bad, _ in rules])
    return rows_of(one, [
        F.struct(F.lit(name).alias("validation_check"), F.col(f"n_{name}").alias("violations"), F.lit(severity).alias("severity"),
                 F.coalesce(F.col(f"s_{name}"), F.lit("None")).alias("sample_record")) for name, _, severity in rules])


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments in one pass; exact quantiles from the distributed position table."""
    one = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        count_rows().alias("_n"),
        *[f(F.col(c)).alias(f"{c}__{n}") for c in columns for n, f in (
            ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max),
            ("skew", F.skewness), ("kurt", F.kurtosis))])
    moments = rows_of(one, [
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__count").alias("count"), F.col(f"{c}__mean").alias("mean"),
                 F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                 rate_pct(F.col("_n") - F.col(f"{c}__count"), F.col("_n")).alias("missing_pct"),
                 F.col(f"{c}__skew").alias("skewness"), F.col(f"{c}__kurt").alias("kurtosis")) for c in columns])
    return moments.join(quantile_columns(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "median", "max", (F.col("q3") - F.col("q1")).alias("iqr"), "missing_pct",
        "skewness", "kurtosis")


def quantile_columns(df: DataFrame, columns: Sequence[str], names: dict[str, float]) -> DataFrame:
    q = exact_quantiles(df, columns, list(names.values()))
    return q.groupBy("column_name").agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for n, p in names.items()])


def outlier_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two passes: bounds and moments (one row per column), then counts against them."""
    bounds = iqr_bounds(df, columns, 1.5)
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    moments = rows_of(one, [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
                            for c in columns])
    limits = bounds.join(moments, "column_name").agg(*[
        F.max(F.when(F.col("column_name") == c, F.struct("lower_bound", "upper_bound", "mean", "std"))).alias(f"_{c}") for c in columns])
    counted = df.crossJoin(F.broadcast(limits)).agg(*[
        expr.alias(f"{c}__{n}") for c in columns for n, expr in (
            ("n", F.count(c)),
            ("iqr", count_where((F.col(c) < F.col(f"_{c}.lower_bound")) | (F.col(c) > F.col(f"_{c}.upper_bound")))),
            ("z", count_where(F.abs((F.col(c).cast("double") - F.col(f"_{c}.mean")) / F.nullif(F.col(f"_{c}.std"), F.lit(0.0))) > 3)))])
    return rows_of(counted, [
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__iqr").alias("iqr_outliers"), F.col(f"{c}__z").alias("zscore_outliers"),
                 rate_pct(F.col(f"{c}__iqr"), F.col(f"{c}__n")).alias("pct_of_data"),
                 F.lit("Flag & Retain (Fraud Signal)").alias("action")) for c in columns])


def quality_dimensions(df: DataFrame, valid: Column, business: Sequence[str] | None = None) -> DataFrame:
    """``valid`` is the row rule behind validity. ``uniqueness_pct_ref`` keeps the original formula, whose
    denominator counts removed rows twice."""
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    one = df.agg(count_rows().alias("n"), F.sum(nulls).alias("null_cells"), count_where(valid).alias("valid")).crossJoin(
        distinct_rows(df, business).select((F.col("rows") - F.col("distinct_rows")).alias("dups")))
    cells = F.col("n") * len(df.columns)
    scored = one.select(
        rate_pct(cells - F.col("null_cells"), cells).alias("completeness"), rate_pct(F.col("valid"), F.col("n")).alias("validity"),
        F.lit(100.0).alias("consistency"),
        rate_pct(F.col("n"), F.col("n") + F.col("dups")).alias("uniqueness_pct_ref"))
    overall = (F.col("completeness") + F.col("validity") + F.col("consistency") + F.col("uniqueness_pct_ref")) / 4
    def status(score: Column) -> Column:
        return F.when(score >= 99, "Excellent").when(score >= 95, "Good").when(score >= 90, "Acceptable").otherwise("Action Required")
    rows = [("Completeness", F.col("completeness")), ("Validity", F.col("validity")), ("Consistency", F.col("consistency")),
            ("Uniqueness", F.col("uniqueness_pct_ref")), ("Overall Quality Score", round_half_up(overall))]
    fixed = [("Accuracy", None, "Gold Label Required"), ("Timeliness", 100.0, "Verified (Batch Ingest)")]
    return rows_of(scored, [
        *[F.struct(F.lit(n).alias("dimension"), v.alias("score_pct"), status(v).alias("status")) for n, v in rows],
        *[F.struct(F.lit(n).alias("dimension"), F.lit(v).cast("double").alias("score_pct"), F.lit(s).alias("status")) for n, v, s in fixed]])


def before_after(before: DataFrame, after: DataFrame, business: Sequence[str] | None = None, copies: str | None = None) -> DataFrame:
    """``copies`` names the count of rows in ``before``, if that holds every distinct row once."""
    def one(df: DataFrame, side: str) -> DataFrame:
        groups = df.groupBy(*(business or df.columns)).agg(count_rows().alias("copies"), F.sum(_null_cells(df)).alias("nulls"))
        return groups.agg(_side(len(df.columns), F.sum("copies"), F.sum("nulls"), count_rows()).alias(side))
    if copies is None:
        first = one(before, "b")
    else:
        rows = before.drop(copies)
        first = before.agg(_side(len(rows.columns), F.sum(copies), F.sum(F.col(copies) * _null_cells(rows)), count_rows()).alias("b"))
    return _reductions(first.crossJoin(one(after, "a")))


def before_after_filter(df: DataFrame, kept: Column, business: Sequence[str] | None = None) -> DataFrame:
    """``before_after`` of the rows and of those that meet ``kept``, from one pass and one shuffle."""
    nulls, columns = _null_cells(df), len(df.columns)
    groups = df.groupBy(*(business or df.columns)).agg(
        count_rows().alias("copies"), F.sum(nulls).alias("nulls"),
        count_where(kept).alias("kept"), F.sum(F.when(kept, nulls)).alias("kept_nulls"))
    return _reductions(groups.agg(
        _side(columns, F.sum("copies"), F.sum("nulls"), count_rows()).alias("b"),
        _side(columns, F.sum("kept"), F.sum("kept_nulls"), count_where(F.col("kept") > 0)).alias("a")))


def _null_cells(df: DataFrame) -> Column:
    return sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))


def _side(columns: int, rows: Column, nulls: Column, distinct: Column) -> Column:
    rows = F.coalesce(rows, F.lit(0))
    return F.struct(rows.alias("Rows"), F.lit(columns).cast("long").alias("Columns"), nulls.cast("long").alias("Missing Values"),
                    (rows - distinct).alias("Exact Duplicate Rows"))


def _reductions(both: DataFrame) -> DataFrame:
    names = ["Rows", "Columns", "Missing Values", "Exact Duplicate Rows"]
    table = rows_of(both, [F.struct(F.lit(n).alias("metric"), F.col("b")[n].alias("before"), F.col("a")[n].alias("after")) for n in names])
    return table.withColumn("reduction_pct", F.coalesce(rate_pct(F.col("before") - F.col("after"), F.nullif(F.col("before"), F.lit(0))), F.lit(0.0)))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (
        ("mean", F.avg), ("std", F.stddev_samp), ("skew", F.skewness))])
    return rows_of(one, [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                                  F.col(f"{c}__skew").alias("skew")) for c in columns])


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free: the same rows give the same fingerprint however they are partitioned."""
    row_hash = F.xxhash64(*(columns or df.columns))
    return df.agg(count_rows().alias("row_count"), F.hex(F.bit_xor(row_hash)).alias("hash_xor"),
                  F.sum(row_hash.cast("decimal(20,0)")).cast("string").alias("hash_sum"))


def label_profile(tx: DataFrame) -> DataFrame:
    return tx.agg(
        count_rows().alias("total_rows"), F.sum("is_laundering").alias("laundering_count"),
        rate_pct(F.sum("is_laundering"), count_rows()).alias("laundering_pct"), F.min("ts").alias("min_timestamp"),
        F.max("ts").alias("max_timestamp"), F.count_distinct("from_account").alias("unique_senders"),
        F.count_distinct("to_account").alias("unique_receivers"), F.count_distinct("from_bank").alias("unique_from_banks"),
        F.count_distinct("to_bank").alias("unique_to_banks"))


def format_distribution(tx: DataFrame) -> DataFrame:
    return tx.groupBy("payment_format").agg(count_rows().alias("tx_count"))
