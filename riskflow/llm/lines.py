"""Removal of repeated passages by content-defined line chunks.

Every line is hashed, and a rolling hash over two lines chooses borders (so they move with the lines, whatever is inserted
before). A chunk starts at every line and ends at the next border, after four lines at most; so the chunks overlap, have
two lines or more, and depend on their own lines alone. Chunks are grouped by a 128-bit hash over the whole table; of the
groups with more than one member the bytes are compared (their smallest and largest text are the same). Of a repeated
chunk the first one stays, by id and place in the text, and the lines of all others go. A line that goes always has an
equal one at an earlier place that stays.

Rules: a null text counts as empty and stays null; an empty text and a single line have no chunk of two lines; rows that
agree in id and text are one document and get the same result; null ids come last; no row is left out, a text may become
empty; other columns are kept as they are and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskflow.llm.tables import slices
from riskflow.session import materialize

#: Lines of the rolling window (and of a chunk at least), lines of a chunk at most, base and modulus of the polynomial; one
#: of so many windows is no border.
WINDOW, MOST_LINES, BASE, MODULUS, ONE_OF = 2, 4, 1_000_003, 4_294_967_291, 8
_FULL = (1 << 64) - 1
KEY = ["no_id", "id", "row_hash"]


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, lines) of the chunk that starts at each line but the last. A border comes after a line unless the
    rolling hash of the line and the one before is a multiple of ``ONE_OF``."""
    hashes = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) for line in lines]
    border = [(old * BASE + new) % MODULUS % ONE_OF != 0 for old, new in zip(hashes, hashes[1:])]  # after line i + 1
    out = []
    for start in range(len(lines) - 1):
        n = WINDOW
        while n < MOST_LINES and start + n < len(lines) and not border[start + n - 2]:
            n += 1
        out.append((start, n))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _identity(id_column: str, text_column: str) -> list[Column]:
    """Columns that tell documents apart and are never null."""
    return [F.col(id_column).isNull().alias("no_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("id"),
            F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("row_hash")]


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(*_identity(id_column, text_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def line_chunks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per chunk: key, first line, lines and hash (two numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                rows, first, count, high, low = [], [], [], [], []
                for row, text in enumerate(part.column(3).to_pylist()):
                    lines = text.split("\n")
                    for start, n in chunks(lines):
                        digest = xxhash.xxh3_128_intdigest("\n".join(lines[start : start + n]).encode())
                        rows.append(row)
                        first.append(start)
                        count.append(n)
                        high.append(_signed(digest >> 64))
                        low.append(_signed(digest & _FULL))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in range(3)), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                    names=[*KEY, "first_line", "n_lines", "high", "low"])

    return _documents(docs, id_column, text_column).mapInArrow(
        run, "no_id boolean, id long, row_hash long, first_line int, n_lines int, high long, low long")


def repeated_chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Chunks whose hash occurs more than once, each with its ``keeper``, the occurrence that stays. Hashes are counted
    before the shuffle, so a chunk that is everywhere costs one row per task."""
    found = line_chunks(docs, id_column, text_column)
    grouped = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "first_line")).alias("keeper"))
    return materialize(found.join(grouped.where("n > 1").drop("n"), ["high", "low"]))


def unequal_hashes(docs: DataFrame, repeated: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``high, low`` of repeated hashes whose chunks differ in their bytes. Only documents with such chunks are cut again."""
    spans = repeated.groupBy(*KEY).agg(F.collect_set(F.struct("first_line", "n_lines", "high", "low")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                high, low, texts = [], [], []
                for text, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lines = text.split("\n")
                    for c in found:
                        high.append(c["high"])
                        low.append(c["low"])
                        texts.append("\n".join(lines[c["first_line"] : c["first_line"] + c["n_lines"]]))
                yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(texts, pa.string())], names=["high", "low", "chunk"])

    held = _documents(docs, id_column, text_column).join(spans.hint("merge"), KEY).select("text", "spans")
    compared = held.mapInArrow(run, "high long, low long, chunk string").groupBy("high", "low").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    return materialize(compared.where(F.col("a") != F.col("b")).select("high", "low"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of a document become runs of lines."""
    for batch in batches:
        merged = []
        for spans in batch.column("cuts").to_pylist():
            runs = []
            for first, n in sorted((c["first_line"], c["n_lines"]) for c in spans):
                if runs and first <= runs[-1][0] + runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], first + n - runs[-1][0])
                else:
                    runs.append([first, n])
            merged.append([{"first_line": first, "n_lines": n} for first, n in runs])
        at = batch.schema.get_field_index("cuts")
        yield batch.set_column(at, batch.schema.field(at), pa.array(merged, batch.schema.field(at).type))


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document that loses lines: ``cuts`` (runs: first line, lines) and ``copied_from``, the ids that keep them."""
    repeated = repeated_chunks(docs, id_column, text_column)
    same = repeated.join(unequal_hashes(docs, repeated, id_column, text_column), ["high", "low"], "left_anti")
    lost = same.where(F.struct(*KEY, "first_line") != F.col("keeper"))
    per_document = lost.groupBy(*KEY).agg(
        F.collect_set(F.struct("first_line", "n_lines")).alias("cuts"),
        F.array_sort(F.collect_set(F.when(~F.col("keeper.no_id"), F.col("keeper.id")))).alias("copied_from"))
    return per_document.mapInArrow(_runs, per_document.schema)


@F.arrow_udf(StringType())
def _without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    """The lines outside the runs; null without a text."""
    out = []
    for one, runs in zip(text, cuts):
        if not one.is_valid:
            out.append(None)
            continue
        lines, kept, at = one.as_py().split("\n"), [], 0
        for run in runs.as_py():
            kept += lines[at : run["first_line"]]
            at = run["first_line"] + run["n_lines"]
        out.append("\n".join(kept + lines[at:]))
    return pa.array(out, pa.string())


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars", details: bool = False) -> DataFrame:
    """``docs`` without repeated chunks, ``length_column`` (if there is one) following the text. With ``details`` the columns
    ``cuts`` and ``copied_from`` come after them."""
    lost = materialize(removals(docs, id_column, text_column))
    packed = docs.select(F.struct("*").alias("_row"), *_identity(id_column, text_column))
    # one plan at every size: both sides are shuffled by key and merged, never broadcast when the list happens to be short
    joined = packed.join(lost.hint("merge"), KEY, "left")
    text = F.col("_row").getField(text_column)
    kept = _without(F.when(F.col("cuts").isNotNull(), text), "cuts")
    joined = joined.withColumn("_text", F.when(F.col("cuts").isNull(), text).otherwise(kept))
    changed = {text_column: F.col("_text")}
    if length_column in docs.columns:
        length = F.col("_row").getField(length_column)
        changed[length_column] = F.when(F.col("cuts").isNull(), length).otherwise(F.length("_text").cast(docs.schema[length_column].dataType))
    columns = [changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]
    if details:
        none = F.array().cast("array<struct<first_line:int,n_lines:int>>")
        columns += [F.coalesce("cuts", none).alias("cuts"), F.coalesce("copied_from", F.array().cast("array<bigint>")).alias("copied_from")]
    return joined.select(*columns)


#: The same in DuckDB's SQL; equal texts are compared as texts.
REMOVED_SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM split),
bordered AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * 1000003 + h) % 4294967291 % 8 <> 0 AS border, max(i) OVER (PARTITION BY doc_id) AS last_i
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (
  SELECT doc_id, i, line, least(CASE WHEN lead(border, 1) OVER w THEN 2 WHEN lead(border, 2) OVER w THEN 3 ELSE 4 END, last_i + 1 - i) AS n_lines,
         lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, lead(line, 3) OVER w AS d
  FROM bordered WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
chunks AS (
  SELECT doc_id, i AS first_line, n_lines,
         line || chr(10) || b || CASE WHEN n_lines > 2 THEN chr(10) || c ELSE '' END || CASE WHEN n_lines > 3 THEN chr(10) || d ELSE '' END AS body
  FROM spans WHERE n_lines > 1),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keeper
  FROM chunks WINDOW w AS (PARTITION BY body ORDER BY doc_id, first_line)),
lost AS (SELECT * FROM ranked WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first_line, first_line + n_lines)) AS i FROM lost),
runs AS (
  SELECT doc_id, min(i) AS first_line, count(*) AS n_lines
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone) GROUP BY doc_id, run),
keepers AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT keeper)), ',') AS copied_from FROM lost GROUP BY doc_id),
per_doc AS (
  SELECT doc_id, CAST(sum(n_lines) AS BIGINT) AS n_lines_removed, string_agg(first_line || ':' || n_lines, ',' ORDER BY first_line) AS cuts
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) AS text
  FROM split n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(p.n_lines_removed, 0) AS n_lines_removed, coalesce(p.cuts, '') AS cuts, coalesce(q.copied_from, '') AS copied_from
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN per_doc p USING (doc_id) LEFT JOIN keepers q USING (doc_id)
"""
