"""The end-to-end quality pipeline: profile, validate, clean, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows
from riskflow.operators import cleaning as c
from riskflow.operators import quality as q
from riskflow.session import materialize


def canonical_names(df: DataFrame) -> DataFrame:
    """Clean names (``TransactionID``, ``Timestamp``, ``From_Bank`` ...) to the names the operators use."""
    special = {"TransactionID": "transaction_id", "Timestamp": "ts", "Is_Amount_Outlier_Flag": "is_amount_outlier"}
    return df.toDF(*[special.get(name, name.lower()) for name in df.columns])


def quality_pipeline(raw: DataFrame, order: Sequence[str], as_of: str, currencies: Sequence[str], formats: Sequence[str]) -> dict[str, DataFrame]:
    """Twelve named tables. The cleaned rows are written once and every later table reads that copy. Where the raw rows have no id, their
    distinct rows are written too, with their number of copies: cleaning goes on from them, and the comparison reads them."""
    parsed = c.parse_timestamp(c.trim_strings(c.normalize_columns(raw)))
    if "TransactionID" in parsed.columns:
        before, copies, cleaned = parsed, None, materialize(c.clean(raw, order))
    else:
        copies = "_copies"
        before = materialize(parsed.groupBy(*parsed.columns).agg(count_rows().alias(copies)), "zstd")
        cleaned = materialize(c.number_and_flag(before.drop(copies), order))
    named = canonical_names(cleaned)
    amounts = ["amount_paid", "amount_received"]
    return {
        "health_dashboard": q.health_dashboard(parsed),
        "missing_values": q.missing_values(parsed),
        "duplicates": q.duplicates(named),
        "domain_rules": q.domain_rules(named, as_of, currencies, formats),
        "numeric_profile": q.numeric_profile(named, amounts),
        "outliers": q.outlier_table(named, amounts),
        "cleaning_log": c.cleaning_log(raw, cleaned),
        "clean_summary": c.duplicate_removal_counts(parsed),
        "quality_dimensions": q.quality_dimensions(named, F.col("amount_paid") >= 0),
        "before_after": q.before_after(before, cleaned, copies=copies),
        "column_statistics": q.column_statistics(named, amounts),
        "fingerprint": q.dataset_fingerprint(named),
        "cleaned": cleaned,
    }
