"""Mixing sources to target weights with exact budgets.

Every row gets a hash-random key. Within a source rows are range-sorted by key (in buckets, so that a hot source is spread
over many tasks), distributed prefix sums of the word counts give each row its place, and the source's budget cuts the
order: whole epochs first, then all rows before the cut, and of the row at the cut as many words as are left.

Rules: a null text has no words; a null source is a source of its own, last in the order; sources without words get and
give nothing; rows equal in id, source, size and text check sum are counted once and spread again, so repeated rows share a
place in the order; equal keys are ordered by id and check sum; an empty table gives no rows; columns other than id,
source and text are only carried by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm.tables import parallelism
from riskflow.operators.ordered import global_index
from riskflow.session import materialize

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Buckets for each task of a shuffle: enough to even out, few enough to keep their table small.
BUCKETS_PER_TASK = 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _identity(docs: DataFrame, id_column: str, source_column: str, text_column: str) -> list[Column]:
    text = F.col(text_column).cast("string")
    return [F.col(source_column).isNull().alias("no_source"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
            F.col(id_column).isNull().alias("no_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("id"),
            words(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc")]


IDENTITY = ["no_source", "source", "no_id", "id", "size", "crc"]


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (no_source, source, source_size). Sources in code point order, null last, take
    the weights in turn. A source stops at ``most`` times its size; the excess goes to the others by weight, until none is
    above: each pass is one aggregate over the sources, and a source that has stopped stays stopped."""
    ranked = materialize(
        global_index(totals, ["no_source", "source"], "rank", start=0)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    whole, level, stopped = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        full = most * F.col("source_size") < F.lit(level) * F.col("weight")
        n, full_size, open_weight = ranked.agg(
            F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (share * whole - most * (full_size or 0)) / open_weight
    full = most * F.col("source_size") < F.lit(level) * F.col("weight")
    return ranked.withColumn("target", F.when(full, most * F.col("source_size").cast("double")).otherwise(F.lit(level) * F.col("weight")))


def positions(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
              weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per distinct identity with the number of equal rows ``copies``, the words ``before`` it in its source's
    random order, and the source's ``source_size, target, epochs, rest`` (words of the last, partial epoch)."""
    sized = docs.select(*_identity(docs, id_column, source_column, text_column)).groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("copies"))
    key = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.when(~F.col("no_id"), F.col("id").cast("string")))), 1, 16)
    sized = materialize(sized.withColumn("key", key))
    weight = F.col("size") * F.col("copies")
    totals = sized.groupBy("no_source", "source").agg(F.sum(weight).alias("source_size"), F.sum("copies").alias("source_rows"))
    targets = source_targets(totals, weights, share, most)
    rows = targets.agg(F.sum("source_rows")).first()[0] or 0
    buckets = BUCKETS_PER_TASK * parallelism(docs.sparkSession)
    budget = F.floor("target").cast("long")
    plan = materialize(targets.select(
        "no_source", "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"), budget.alias("budget"),
        (F.floor(F.col("source_rows") * buckets / max(1, rows)) + 1).alias("buckets")))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    dealt = materialize(sized.join(plan.select("no_source", "source", "buckets"), ["no_source", "source"])
                        .withColumn("bucket", F.floor(place * F.col("buckets"))).drop("buckets"))
    sums = dealt.groupBy("no_source", "source", "bucket").agg(F.sum(weight).alias("sum"))
    earlier = W.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("no_source", "source", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = W.partitionBy("no_source", "source", "bucket").orderBy("key", "no_id", "id", "crc", "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.withColumn("in_bucket", F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .join(offsets, ["no_source", "source", "bucket"]).join(plan.drop("buckets"), ["no_source", "source"])
        .select(*IDENTITY, "copies", (F.col("offset") + F.col("in_bucket")).alias("before"), "source_size", "target", "epochs",
                (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest")))


def _part(copy: Column) -> Column:
    """Words of the last epoch that a row takes, for its copy of this number."""
    return F.least(F.greatest(F.col("rest") - F.col("before") - copy * F.col("size"), F.lit(0)), F.col("size"))


def taken_words(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """``id, size, source_size, target, taken`` for every row of ``docs``."""
    spread = positions(docs, id_column, source_column, text_column, **options).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return spread.select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_column), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + _part(F.col("copy"))).alias("taken"))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", length_column: str = "n_chars", **options) -> DataFrame:
    """The mixed rows: each as often as its source's epochs say; the row at a source's cut ends after the last word that
    the budget takes (its ``length_column`` follows). Rows that the budget does not reach are left out."""
    plan = positions(docs, id_column, source_column, text_column, **options)
    doses = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda c: F.concat(
            F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("epochs", F.lit(1))), lambda e: F.when(e <= F.col("epochs"), F.col("size")).otherwise(F.lit(0))),
            F.array(_part(c))))), lambda d: d > 0)
    packed = docs.select(F.struct("*").alias("_row"), *_identity(docs, id_column, source_column, text_column))
    rows = packed.join(plan.withColumn("doses", doses).where(F.size("doses") > 0).select(*IDENTITY, "doses"), IDENTITY)
    once = rows.groupBy(*IDENTITY).agg(F.first("_row").alias("_row"), F.first("doses").alias("doses"))
    given = once.select("_row", "size", F.explode("doses").alias("_dose"))
    text = F.col("_row").getField(text_column)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("_dose").cast("int")), "")
    changed = {text_column: F.when(F.col("_dose") < F.col("size"), cut).otherwise(text)}
    if length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        changed[length_column] = F.when(F.col("_dose") < F.col("size"), F.length(cut).cast(kind)).otherwise(F.col("_row").getField(length_column))
    return given.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


#: The same words taken, in DuckDB's SQL.
TAKEN_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix-1-' || doc_id), 1, 16) AS key
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, CAST(s AS DOUBLE) / w AS fill FROM ranked),
levels AS (
  SELECT s, w, fill,
         (1.5 * CAST(sum(s) OVER () AS DOUBLE) - 2 * CAST(coalesce(sum(s) OVER (ORDER BY fill, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY fill, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM filled),
chosen AS (SELECT min_by(level, fill) AS level FROM levels WHERE level * w <= 2 * s),
targets AS (
  SELECT source, s, CASE WHEN 2 * s < level * w THEN CAST(2 * s AS DOUBLE) ELSE level * w END AS target FROM ranked, chosen),
placed AS (
  SELECT doc_id, size, s, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
       CASE WHEN s = 0 THEN 0 ELSE (budget // s) * size + least(greatest(budget - (budget // s) * s - before, 0), size) END AS taken
FROM placed
"""
