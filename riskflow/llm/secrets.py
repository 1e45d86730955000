"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256). The ledger is a table of (blob, rules version, spans): a
scan takes only blobs that the ledger does not have under the current rules, each once however many paths hold it, and
joins the ledger's findings back to all paths. New rules get a new version, so every blob is scanned again under them.

Rules for odd input: a null text is the empty blob; a null id is a path like any other; repeated rows give repeated
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import slices
from riskflow.session import materialize

#: kind: pattern, group that is measured, least length. Longer runs are found by the same leftmost matches.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RULES_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
LEDGER = "blob string, rules_version string, spans array<struct<kind: string, start: int, stop: int>>"


def find_spans(text: str, compiled: list[tuple[str, re.Pattern, int, int]]) -> list[dict]:
    """Leftmost matches that do not overlap, per kind; matches that are too short are dropped. By start, then kind as listed."""
    found = [
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern, group, least) in enumerate(compiled)
        for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [{"kind": kind, "start": start, "stop": stop} for start, _, kind, stop in sorted(found)]


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """``blob, spans`` of a table (blob, text)."""
    rules = list(RULES.items())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(name, re.compile(pattern), group, least) for name, (pattern, group, least) in rules]
        for batch in batches:
            for part in slices(batch, 1):
                spans = [find_spans(text, compiled) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, "blob string, spans array<struct<kind: string, start: int, stop: int>>")


def read_ledger(spark, path: str) -> DataFrame:
    """An absent ledger is an empty one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def known_blobs(spark, path: str) -> DataFrame:
    """``blob, spans`` under the current rules; a blob that two writers have added at once stands once."""
    return read_ledger(spark, path).where(F.col("rules_version") == RULES_VERSION).groupBy("blob").agg(F.first("spans").alias("spans"))


def scan_versions(versions: DataFrame, ledger_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, blob, spans`` for every row; the ledger at ``ledger_path`` takes up what is scanned now."""
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    paths = materialize(versions.select(F.col(id_column).alias("id"), F.sha2(text, 256).alias("blob")))
    known = known_blobs(spark, ledger_path).select("blob")
    # one path of each unseen blob hands in the text. Few unseen ones are broadcast and no text moves; where they are many
    # (a first scan), the join moves the texts once
    chosen = paths.groupBy("blob").agg(F.min("id").alias("id")).join(known, "blob", "left_anti")
    chosen = materialize(chosen.select(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "blob"))
    texts = versions.select(F.col(id_column).isNull().alias("no_id"), F.coalesce(F.col(id_column), F.lit(0)).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    found = scan_blobs(texts.join(chosen, ["no_id", "id", "blob"], "left_semi"))
    # rows repeated with id and text hand in their blob together
    once = found.groupBy("blob").agg(F.first("spans").alias("spans"))
    once.select("blob", F.lit(RULES_VERSION).alias("rules_version"), "spans").write.mode("append").parquet(ledger_path)
    return paths.join(known_blobs(spark, ledger_path), "blob").select(F.col("id").alias(id_column), "blob", "spans")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def joined_spans(kinds: list[str] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    chosen = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
