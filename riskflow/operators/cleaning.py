"""Cleaning steps. Each takes a DataFrame and returns a DataFrame; counts are aggregates, never collected rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.numbers import count_rows, count_where
from riskflow.operators.ordered import exact_quantiles, global_index
from riskflow.schema import (
    HIGH_VALUE, OUTLIER_IQR_FACTOR, RAW_DEFAULTS, RAW_TIME_FORMAT, RENAMES, REQUEST_CURRENCIES, REQUEST_FORMATS,
    SENSITIVE_COLUMNS,
)


def normalize_columns(df: DataFrame, renames: Mapping[str, str] = RENAMES) -> DataFrame:
    """The map first; other names are stripped and get ``_`` for blanks and dots."""
    return df.toDF(*[renames.get(c, c.strip().replace(" ", "_").replace(".", "_")) for c in df.columns])


def assign_transaction_ids(df: DataFrame, order: Sequence[str], name: str = "TransactionID") -> DataFrame:
    """``TX_1 .. TX_n`` in the given total order, only where the column is missing; the id comes first."""
    if name in df.columns:
        return df.select(name, *[c for c in df.columns if c != name])
    numbered = global_index(df, order, "_row")
    return numbered.select(F.concat(F.lit("TX_"), F.col("_row").cast("string")).alias(name), *df.columns)


def assign_hash_ids(df: DataFrame, name: str = "TransactionID", columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free alternative: needs no sort and no shuffle."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]
    return df.select(F.concat(F.lit("TX_"), F.sha2(F.concat_ws("|", *parts), 256)).alias(name), *df.columns)


def trim_strings(df: DataFrame) -> DataFrame:
    """All white space, not only blanks, at both ends of every string column."""
    trimmed = {f.name: F.regexp_replace(F.col(f"`{f.name}`"), r"^\s+|\s+$", "")
               for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(trimmed) if trimmed else df


def parse_timestamp(df: DataFrame, column: str = "Timestamp", fmt: str = RAW_TIME_FORMAT) -> DataFrame:
    """Text to time; text that does not fit becomes NULL."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(fmt)).cast("timestamp_ntz"))


def drop_exact_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns) if columns else df.columns)


def duplicate_removal_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows before and after. Copies are combined on the map side, so a hot copy group shuffles one row per task."""
    groups = df.groupBy(*(columns or df.columns)).agg(count_rows().alias("copies"))
    return groups.agg(
        F.sum("copies").alias("initial_rows"), count_rows().alias("final_rows"),
        (F.sum("copies") - count_rows()).alias("removed_duplicates"))


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float) -> DataFrame:
    """(column_name, q1, q3, lower_bound, upper_bound), one row per column."""
    q = exact_quantiles(df, columns, [0.25, 0.75]).groupBy("column_name").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("quantile"))).alias("q3"))
    width = F.col("q3") - F.col("q1")
    return q.select("column_name", "q1", "q3", (F.col("q1") - factor * width).alias("lower_bound"),
                    (F.col("q3") + factor * width).alias("upper_bound"))


def flag_outliers_iqr(df: DataFrame, column: str = "amount_paid", factor: float = OUTLIER_IQR_FACTOR,
                      name: str = "is_amount_outlier") -> DataFrame:
    """1 above Q3 + factor * IQR; only the upper side counts."""
    bound = iqr_bounds(df, [column], factor).select("upper_bound")  # exactly one row
    flagged = df.crossJoin(F.broadcast(bound)).withColumn(name, (F.col(column) > F.col("upper_bound")).cast("int"))
    return flagged.drop("upper_bound")


def flag_outliers_fixed(df: DataFrame, column: str = "amount_paid", floor: float = HIGH_VALUE,
                        name: str = "is_amount_outlier") -> DataFrame:
    return df.withColumn(name, (F.col(column) > F.lit(floor)).cast("int"))


def downcast(df: DataFrame, plan: Mapping[str, str]) -> DataFrame:
    """Narrower integers. A value that does not fit becomes NULL and is counted by ``downcast_overflow``."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in plan.items()})


def downcast_overflow(df: DataFrame, plan: Mapping[str, str]) -> DataFrame:
    return df.agg(*[count_where(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in plan.items()])


def clean(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Normalise, trim, parse, drop duplicates on the business columns, number, flag outliers, narrow types."""
    out = parse_timestamp(trim_strings(normalize_columns(df)))
    business = [c for c in out.columns if c != "TransactionID"]
    return number_and_flag(drop_exact_duplicates(out, business), order)


def number_and_flag(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The steps of ``clean`` after the duplicates are gone. The numbered rows are written by the layout, and bounds and rows read that."""
    out = flag_outliers_iqr(assign_transaction_ids(df, order), "Amount_Paid", name="Is_Amount_Outlier_Flag")
    narrow = {f.name: ("tinyint" if f.name in ("Is_Laundering", "Is_Amount_Outlier_Flag") else "int")
              for f in out.schema.fields if isinstance(f.dataType, T.LongType)}
    return downcast(out, narrow)


def cleaning_log(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row per cleaning step with the rows or columns it touched."""
    strings = sum(isinstance(f.dataType, T.StringType) for f in raw.schema.fields)
    longs = sum(isinstance(f.dataType, T.LongType) for f in raw.schema.fields)
    flag = "Is_Amount_Outlier_Flag"
    counted = raw.agg(count_rows().alias("before")).crossJoin(
        cleaned.agg(count_rows().alias("after"), count_where(F.col(flag) == 1).alias("outliers")))
    steps = [
        ("1. Normalize Column Names", F.lit(len(raw.columns)), "Mapped headers to clean names", "One name per field in SQL and Python"),
        ("2. Assign TransactionID", F.col("after"), "Numbered rows without an id", "Unique primary key"),
        ("3. Trim Whitespace", F.lit(strings), "Stripped both ends of text columns", "Joins and groups see one spelling"),
        ("4. Cast Datetime", F.col("before"), "Parsed text timestamps", "Time windows need a time type"),
        ("5. Remove Duplicates", F.col("before") - F.col("after"), "Dropped identical rows", "No double counting"),
        ("6. Flag Amount Outliers", F.col("outliers"), "Flagged amounts beyond the bound", "Extreme amounts are a fraud signal"),
        ("7. Downcast Integers", F.lit(longs), "Narrowed 64-bit integers", "Type contract of the warehouse"),
    ]
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(step).alias("step"), rows.cast("long").alias("rows_affected"), F.lit(action).alias("action"),
                 F.lit(reason).alias("reason")) for step, rows, action, reason in steps])).alias("s")).select("s.*")


def clean_gate(df: DataFrame, expected_rows: int | Column, key: str = "transaction_id", ts: str = "ts",
               amount: str = "amount_paid") -> DataFrame:
    """Checks that must all hold before a cleaned table is used."""
    expected = F.lit(expected_rows) if isinstance(expected_rows, int) else expected_rows
    checks = df.agg(
        count_rows().alias("clean_rows"), F.count_distinct(key).alias("unique_tx_ids"),
        count_where(F.col(amount) < 0).alias("negative_amounts"), count_where(F.col(ts).isNull()).alias("null_timestamps"))
    return checks.withColumn(
        "passed", (F.col("clean_rows") == expected) & (F.col("unique_tx_ids") == F.col("clean_rows"))
        & (F.col("negative_amounts") == 0) & (F.col("null_timestamps") == 0))


def check_rows(df: DataFrame, currencies: Sequence[str] = REQUEST_CURRENCIES, formats: Sequence[str] = REQUEST_FORMATS,
               time_column: str = "ts", amounts_positive: bool = True) -> DataFrame:
    """Adds ``reasons``: an array that is empty for a row that keeps the contract."""
    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    rules = [(blank(c), f"{c} is empty") for c in ("transaction_id", "from_account", "to_account", "from_bank", "to_bank")]
    for c in ("amount_paid", "amount_received"):
        rules.append((F.col(c).isNull() | (F.col(c) <= 0 if amounts_positive else F.lit(False)), f"{c} is not positive"))
    rules.append((~F.coalesce(F.col("payment_format").isin(list(formats)), F.lit(False)), "payment_format is not allowed"))
    for c in ("payment_currency", "receiving_currency"):
        rules.append((~F.coalesce(F.col(c).isin(list(currencies)), F.lit(False)), f"{c} is not allowed"))
    when = F.col(time_column)
    if isinstance(df.schema[time_column].dataType, T.StringType):
        when = F.try_to_timestamp(when)
    rules.append((when.isNull(), f"{time_column} is not a timestamp"))
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules])))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] = RAW_DEFAULTS) -> DataFrame:
    """Missing columns and NULL fields get the raw defaults; the outlier flag follows from the amount."""
    out = df
    for name, value in defaults.items():
        present = next((c for c in out.columns if c.lower() == name.lower()), None)
        out = out.withColumn(present or name, F.coalesce(F.col(present), F.lit(value)) if present else F.lit(value))
    amount = next(c for c in out.columns if c.lower() == "amount_paid")
    derived = (F.col(amount) > HIGH_VALUE).cast("double")
    return out.withColumn("is_amount_outlier", F.coalesce(F.col("is_amount_outlier").cast("double"), derived)
                          if "is_amount_outlier" in df.columns else derived)


def fingerprint(*columns: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the joined values."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16)


def mask_columns(df: DataFrame, sensitive: Sequence[str] = SENSITIVE_COLUMNS) -> DataFrame:
    hidden = {s.lower() for s in sensitive}
    return df.select(*[F.lit("***MASKED***").alias(c) if c.lower() in hidden else F.col(c) for c in df.columns])


def feature_contract(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(column_name, status, null_count) for missing, unexpected and present columns."""
    present = [c for c in expected if c in df.columns]
    static = [(c, "missing") for c in expected if c not in df.columns] + [(c, "unexpected") for c in df.columns if c not in expected]
    counted = df.agg(*[count_where(F.col(c).isNull()).alias(c) for c in present]) if present else None
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit("present").alias("status"), F.col(c).alias("null_count")) for c in present]
    out = counted.select(F.explode(F.array(*rows)).alias("s")).select("s.*") if present else None
    if static:
        extra = df.sparkSession.createDataFrame(static, "column_name string, status string").withColumn(
            "null_count", F.lit(None).cast("long"))
        out = extra if out is None else out.unionByName(extra)
    return out
