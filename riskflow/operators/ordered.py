"""Ordered computations that never put an unbounded group into one task.

Spark's window operator sends a whole window partition to one task. That is fine for an account with a few
thousand rows and wrong for an account (or a bank, or the whole table) that holds a third of the data. The
functions here keep the plain window for ordinary keys and lay out oversized keys in *chunks*: rows are range
partitioned by (key, order), each task becomes one chunk, and what earlier chunks contribute is carried in as
an extra row per (key, chunk). The chunk layout is checkpointed, so chunk numbers stay the same when a lost
task is run again.

* ``locate_hot_keys``  all keys with more rows than a limit (measured, NULL included)
* ``over_history``     running aggregates and short look-back frames per key
* ``scan``             running aggregates for many keys at once over one time order (few, huge groups)
* ``chunk_by_day``     the days of a time as chunks for ``scan``: nothing is sorted or sent to write them
* ``before_by_day``    running aggregates over strictly earlier times, a hot key cut by day; nothing is written
* ``global_index``     position of every row in a total order
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.functions.numbers import micros
from riskflow.functions.rows import null_safe_join
from riskflow.session import materialize

HOT_KEY_ROWS = 2_000_000
#: Rows of a task that sorts a laid-out table again; more rows mean more tasks, not larger ones.
TASK_ROWS = 500_000

MERGE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}

Running = Mapping[str, tuple[str, Column]]
Frames = Mapping[str, Callable[[WindowSpec], Column]]


@dataclass(frozen=True)
class HotKeys:
    """Keys to be chunked, as a written table: Spark knows its size and picks the join. NULL is a key like any other."""

    columns: tuple[str, ...]
    keys: DataFrame

    def hot_part(self, df: DataFrame) -> DataFrame:
        return null_safe_join(df, self.keys, self.columns, "left_semi").select(*df.columns)

    def cold_part(self, df: DataFrame) -> DataFrame:
        return null_safe_join(df, self.keys, self.columns, "left_anti").select(*df.columns)


def locate_hot_keys(df: DataFrame, columns: str | Sequence[str], limit: int = HOT_KEY_ROWS) -> HotKeys | None:
    """One pre-aggregated count per key. Any key outside the result has at most ``limit`` rows."""
    columns = (columns,) if isinstance(columns, str) else tuple(columns)
    found = materialize(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*columns))
    return None if found.isEmpty() else HotKeys(columns, found)


def lay_out(df: DataFrame, order: Sequence[str | Column], chunks: int | None = None) -> DataFrame:
    """Range partition by ``order``; adds ``_chunk`` (increasing with the order) and ``_pos`` within it."""
    spread = df.repartitionByRange(chunks, *order) if chunks else df.repartitionByRange(*order)
    return materialize(
        spread.sortWithinPartitions(*order)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def _day(time: str) -> Column:
    return F.coalesce(F.unix_date(F.col(time).cast("date")), F.lit(-(1 << 31)))


def chunk_by_day(df: DataFrame, order: Sequence[str], chunks: int | None = None, limit: int = HOT_KEY_ROWS) -> DataFrame:
    """``df`` as a written table with ``_chunk``, the day of the first column of ``order`` (a time; NULL comes first).

    A day is known from the row alone, so the rows are written as they come. If a day holds more than ``limit`` rows, or a number
    of chunks is asked for, the table is laid out by range instead.
    """
    if chunks:
        return lay_out(df, order, chunks)
    written = materialize(df.withColumn("_chunk", _day(order[0])), "zstd")
    largest = written.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_n")).first()["_n"]
    return lay_out(written.drop("_chunk"), order) if (largest or 0) > limit else written


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_index", start: int = 1,
                 chunks: int | None = None) -> DataFrame:
    """Consecutive positions in a total order, without one task that sees every row."""
    laid = lay_out(df, order, chunks)
    return number_chunks(laid, name, start).drop("_chunk", "_pos")


def number_chunks(laid: DataFrame, name: str, start: int = 1) -> DataFrame:
    # one row per chunk: as many rows as shuffle partitions, so the window and the broadcast are bounded
    sizes = laid.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        laid.join(F.broadcast(offsets), "_chunk")
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start)).drop("_offset"))


def number_days(df: DataFrame, counted: DataFrame, order: Sequence[str], name: str, start: int = 1,
                brought: DataFrame | None = None) -> DataFrame:
    """Consecutive positions in a total order for rows of ``counted``, a table of ``chunk_by_day``, that were joined to more columns.
    One shuffle numbers them and leaves consecutive rows in each task; a table laid out by range keeps the positions it has.

    ``brought`` holds values that were looked up for single rows: (_chunk, _row, values). The same shuffle brings them to the row of
    that ``_row`` in ``df``, which then need not travel to the look-ups.
    """
    spread = df
    if brought is not None:
        values = [c for c in brought.columns if c not in ("_chunk", "_row")]
        spread = df.withColumn("_own", F.lit(True)).unionByName(brought, allowMissingColumns=True).repartitionByRange("_chunk")
        of_row = W.partitionBy("_chunk", "_row")
        spread = spread.withColumns({v: F.max(v).over(of_row) for v in values}).where(F.col("_own")).drop("_own", "_row")
    if "_pos" in df.columns:
        place = F.col("_pos")
    else:
        if brought is None:
            spread = df.withColumn("_chunk", _day(order[0])).repartitionByRange("_chunk")
        place = F.row_number().over(W.partitionBy("_chunk").orderBy(*order)).cast("long") - F.lit(1)
    # one row per day or chunk: the window and the broadcast are bounded
    sizes = counted.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        spread.withColumn("_place", place).join(F.broadcast(offsets), "_chunk")
        .withColumn(name, F.col("_offset") + F.col("_place") + F.lit(start)).drop("_chunk", "_pos", "_place", "_offset"))


def over_history(df: DataFrame, keys: str | Sequence[str], order: Sequence[str], running: Running | None = None,
                 frames: Frames | None = None, depth: int = 0, ahead: int = 0,
                 hot: HotKeys | None = None, chunks: int | None = None) -> DataFrame:
    """Per key and in a total order, add

    * ``running``: ``{name: ("sum" | "max" | "min", value)}`` over all strictly earlier rows (NULL if none);
    * ``frames``: ``{name: window -> column}`` for functions that look at most ``depth`` rows back or ``ahead``
      rows forward, for example ``lambda w: F.lag("x", 2).over(w)``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    running, frames = dict(running or {}), dict(frames or {})
    ordinary = df if hot is None else hot.cold_part(df)
    w = W.partitionBy(*keys).orderBy(*order)
    prior = w.rowsBetween(W.unboundedPreceding, -1)
    result = ordinary.select(
        *df.columns,
        *[MERGE[how](value).over(prior).alias(name) for name, (how, value) in running.items()],
        *[build(w).alias(name) for name, build in frames.items()])
    if hot is None:
        return result
    return result.unionByName(over_chunks(hot.hot_part(df), keys, order, running, frames, depth, ahead, chunks))


def over_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], running: Running, frames: Frames | None = None,
                depth: int = 0, ahead: int = 0, chunks: int | None = None) -> DataFrame:
    """``over_history`` for a table whose keys are all oversized: every key is laid out in chunks."""
    keys, columns, frames = list(keys), df.columns, dict(frames or {})
    laid = lay_out(df, [*keys, *order], chunks)
    rows = laid.select(*columns, "_chunk", F.lit(1).alias("_kind"))
    spans = _spanning_parts(laid, keys)
    parts = [rows]
    if running:
        valued = laid.withColumns({f"_in_{n}": value for n, (_, value) in running.items()})
        parts.append(_carry_rows(null_safe_join(valued, F.broadcast(spans), [*keys, "_chunk"], "left_semi"), keys, running))
    for count, forward in ((depth, False), (ahead, True)):
        if count:
            parts.append(_edge_rows(laid, spans, columns, keys, order, count, forward).withColumn("_kind", F.lit(2)))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    union = union.repartition(*keys, "_chunk")
    # only carry rows bring values along; those of the rows are repeated from their columns after the shuffle
    for n, (_, value) in running.items():
        union = union.withColumn(f"_in_{n}", F.when(F.col("_kind") == 1, value).otherwise(F.col(f"_in_{n}")))
    # the carry row (kind 0) comes first; its row columns are NULL, so look-back frames skip it
    union = union.withColumn("_first", F.when(F.col("_kind") == 0, 0).otherwise(1))
    w = W.partitionBy(*keys, "_chunk").orderBy("_first", *order)
    prior = w.rowsBetween(W.unboundedPreceding, -1)
    return union.select(
        *columns, "_kind",
        *[MERGE[how](F.col(f"_in_{n}")).over(prior).alias(n) for n, (how, _) in running.items()],
        *[build(w).alias(n) for n, build in frames.items()]).where(F.col("_kind") == 1).drop("_kind")


def _spanning_parts(laid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, first and last position) of the keys that reach over several chunks, written: a border between two chunks
    cuts one key at most, so there are at most twice as many rows as chunks, whatever the number of keys."""
    ends = laid.groupBy(*keys, "_chunk").agg(F.min("_pos").alias("_from"), F.max("_pos").alias("_to"))
    # a part that neither begins nor ends its chunk is a whole key; the rest may be
    sizes = laid.groupBy("_chunk").agg(F.max("_pos").alias("_end"))
    at_border = ends.join(F.broadcast(sizes), "_chunk").where((F.col("_from") == 0) | (F.col("_to") == F.col("_end"))).drop("_end")
    parts = materialize(at_border)
    several = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n") if keys else parts
    return null_safe_join(parts, several, keys, "left_semi") if keys else parts


def _carry_rows(rows: DataFrame, keys: list[str], running: dict) -> DataFrame:
    """What all earlier chunks of the same key add up to: one row per (key, chunk)."""
    per_chunk = rows.groupBy(*keys, "_chunk").agg(
        *[MERGE[how](F.col(f"_in_{n}")).alias(f"_in_{n}") for n, (how, _) in running.items()])
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("_chunk").rowsBetween(
        W.unboundedPreceding, -1)
    types = {n: rows.schema[f"_in_{n}"].dataType for n in running}
    return per_chunk.select(
        *keys, "_chunk", F.lit(0).alias("_kind"),
        *[MERGE[how](F.col(f"_in_{n}")).over(earlier).alias(f"_in_{n}")
          if types[n].typeName() == "decimal" else
          MERGE[how](F.col(f"_in_{n}")).over(earlier).cast(types[n]).alias(f"_in_{n}")
          for n, (how, _) in running.items()])


def _edge_rows(laid: DataFrame, spans: DataFrame, columns: Sequence[str], keys: list[str], order: Sequence[str], count: int,
               forward: bool) -> DataFrame:
    """The nearest ``count`` rows outside each chunk, copied into it; positions tell them, so no row is sorted for it. Every group
    collected here is bounded: at most ``count`` rows per chunk, and at most ``count`` neighbouring chunks (each has at least one row)."""
    inside = F.col("_pos") < F.col("_from") + count if forward else F.col("_pos") > F.col("_to") - count
    nearest = null_safe_join(laid, F.broadcast(spans), [*keys, "_chunk"]).where(inside)
    edge = nearest.groupBy(*keys, "_chunk").agg(
        F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("_row")))).alias("_edge"))
    span = W.partitionBy(*keys).orderBy("_chunk")
    span = span.rowsBetween(1, count) if forward else span.rowsBetween(-count, -1)
    around = edge.select("_chunk", F.flatten(F.collect_list("_edge").over(span)).alias("_near"))
    size = F.size("_near")
    start = F.lit(1) if forward else F.greatest(size - F.lit(count) + 1, F.lit(1))
    return (
        around.select("_chunk", F.explode(F.slice("_near", start, F.lit(count))).alias("_g"))
        .select(*[F.col("_g._row")[c].alias(c) for c in columns], "_chunk"))


def largest_day(df: DataFrame, key: str, time: str) -> int:
    """The most rows that one key has in one day."""
    return df.groupBy(key, _day(time)).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def before_by_day(df: DataFrame, key: str, time: str, running: Running, hot: HotKeys | None = None) -> DataFrame:
    """``running`` over the rows of the same key whose ``time`` is strictly earlier (NULL if none; a NULL time comes first). A hot key
    is cut into days, and what its earlier days add up to is one more row of each; nothing is written, so Spark leaves out what
    the caller does not read."""
    first = -(1 << 61)
    at = F.coalesce(micros(time), F.lit(first))

    def add(rows: DataFrame, keys: list[str], inputs: Mapping[str, Column]) -> DataFrame:
        earlier = W.partitionBy(*keys).orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
        return rows.withColumns({n: MERGE[how](inputs[n]).over(earlier) for n, (how, _) in running.items()})
    ordinary = (df if hot is None else hot.cold_part(df)).withColumn("_at", at)
    result = add(ordinary, [key], {n: value for n, (_, value) in running.items()}).drop("_at")
    if hot is None:
        return result
    rows = hot.hot_part(df).withColumns({"_chunk": _day(time), "_kind": F.lit(1)})
    carried = _carry_rows(rows.withColumns({f"_in_{n}": value for n, (_, value) in running.items()}), [key], dict(running))
    # the carry row (kind 0) is earlier than any row of its day
    both = rows.unionByName(carried, allowMissingColumns=True).withColumn("_at", F.when(F.col("_kind") == 0, F.lit(first - 1)).otherwise(at))
    values = {n: F.when(F.col("_kind") == 1, value).otherwise(F.col(f"_in_{n}")) for n, (_, value) in running.items()}
    return result.unionByName(add(both, [key, "_chunk"], values).where(F.col("_kind") == 1).select(*result.columns))


def scan(laid: DataFrame, order: Sequence[str], groups: Sequence[tuple[Sequence[str], Running]]) -> DataFrame:
    """Running aggregates over one laid-out order for several groupings at once, for example the whole table,
    per bank and per currency. Groups may be of any size: a window never spans more than one chunk."""
    columns = [c for c in laid.columns if c not in ("_chunk", "_pos")]
    inputs = {f"_in_{n}": value for _, running in groups for n, (_, value) in running.items()}
    rows = laid.select(*columns, "_chunk", F.lit(1).alias("_kind"))
    union = rows
    for keys, running in groups:
        valued = rows.withColumns({f"_in_{n}": value for n, (_, value) in running.items()})
        union = union.unionByName(_carry_rows(valued, list(keys), dict(running)), allowMissingColumns=True)
    tasks = -(-laid.count() // TASK_ROWS)
    many = tasks > int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    union = union.repartition(tasks, "_chunk") if many else union.repartition("_chunk")
    # only carry rows bring values along; those of the rows are repeated from their columns after the shuffle
    union = union.withColumns({n: F.when(F.col("_kind") == 1, value).otherwise(F.col(n)) for n, value in inputs.items()})
    added = []
    for keys, running in groups:
        prior = W.partitionBy("_chunk", *keys).orderBy("_kind", *order).rowsBetween(W.unboundedPreceding, -1)
        # carry rows of the other groupings must not count here, so only carry rows with these inputs survive
        added += [MERGE[how](F.col(f"_in_{n}")).over(prior).alias(n) for n, (how, _) in running.items()]
    return union.select(*columns, "_kind", *added).where(F.col("_kind") == 1).drop("_kind")


def running_with_peers(df: DataFrame, key: str, order: str, running: Running, hot: HotKeys | None = None,
                       chunks: int | None = None) -> DataFrame:
    """Running aggregates up to and including all rows with the same order value (the default RANGE frame)."""
    frame = W.partitionBy(key).orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    ordinary = df if hot is None else hot.cold_part(df)
    result = ordinary.select(
        *df.columns, *[MERGE[how](value).over(frame).alias(n) for n, (how, value) in running.items()])
    if hot is None:
        return result
    rows = hot.hot_part(df)
    peers = rows.groupBy(key, order).agg(*[MERGE[how](v).alias(f"_own_{n}") for n, (how, v) in running.items()])
    carried = over_history(peers, key, [order], hot=hot, chunks=chunks,
                           running={f"_old_{n}": (how, F.col(f"_own_{n}")) for n, (how, _) in running.items()})
    merged = carried.select(key, order, *[_merge(how, F.col(f"_old_{n}"), F.col(f"_own_{n}")).alias(n)
                                          for n, (how, _) in running.items()])
    return result.unionByName(null_safe_join(rows, merged, [key, order]).select(*result.columns))


def _merge(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.coalesce(left + right, left, right)
    return F.greatest(left, right) if how == "max" else F.least(left, right)


def ranks_within(df: DataFrame, key: str, value: str, tie: str, hot: HotKeys | None = None,
                 chunks: int | None = None) -> DataFrame:
    """row_num, rank_num and dense_rank_num of ``value`` descending within ``key``."""
    ordinary = df if hot is None else hot.cold_part(df)
    by_value = W.partitionBy(key).orderBy(F.desc(value))
    result = ordinary.select(
        *df.columns,
        F.row_number().over(W.partitionBy(key).orderBy(F.desc(value), tie)).cast("long").alias("row_num"),
        F.rank().over(by_value).cast("long").alias("rank_num"),
        F.dense_rank().over(by_value).cast("long").alias("dense_rank_num"))
    if hot is None:
        return result
    rows = hot.hot_part(df).withColumn("_down", -F.col(value))
    numbered = over_history(rows, key, ["_down", tie], running={"_before": ("sum", F.lit(1))}, hot=hot, chunks=chunks)
    values = rows.groupBy(key, "_down").agg(F.count(F.lit(1)).alias("_n"))
    levels = over_history(values, key, ["_down"], hot=hot, chunks=chunks,
                          running={"_above": ("sum", F.col("_n")), "_levels": ("sum", F.lit(1))})
    one = F.lit(1)
    ranked = null_safe_join(numbered, levels, [key, "_down"]).select(
        *df.columns,
        (F.coalesce("_before", F.lit(0)) + one).cast("long").alias("row_num"),
        (F.coalesce("_above", F.lit(0)) + one).cast("long").alias("rank_num"),
        (F.coalesce("_levels", F.lit(0)) + one).cast("long").alias("dense_rank_num"))
    return result.unionByName(ranked)


def first_of_pair(df: DataFrame, key: str, other: str, order: Sequence[str], row_id: str, name: str,
                  hot: HotKeys | None = None) -> DataFrame:
    """1 on the first row of every (key, other) pair, else 0.

    Ordinary rows are partitioned by ``key`` alone, which serves this window and the per-key windows that follow.
    """
    w = W.partitionBy(key, other).orderBy(*order)
    ordinary = (df if hot is None else hot.cold_part(df)).repartition(key)
    result = ordinary.withColumn(name, F.when(F.row_number().over(w) == 1, 1).otherwise(0))
    if hot is None:
        return result
    rows = hot.hot_part(df)
    # min() is combined before the shuffle, so a hot pair costs one row per map task
    first = rows.groupBy(key, other).agg(
        F.min(F.struct(*order, F.col(row_id).alias("_id"))).alias("_m")).select(
        F.col("_m._id").alias(row_id), F.lit(1).alias(name))
    flagged = rows.join(first, row_id, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return result.unionByName(flagged.select(*result.columns))


def value_positions(df: DataFrame, value: str, chunks: int | None = None) -> DataFrame:
    """For each distinct value: rows below it (``below``), rows up to it (``upto``) and all rows (``rows``)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    laid = lay_out(counts, [value], chunks)
    placed = scan(laid, [value], [([], {"below": ("sum", F.col("_n"))})])
    everything = laid.agg(F.sum("_n").alias("rows"))
    return placed.crossJoin(F.broadcast(everything)).select(
        value, F.coalesce("below", F.lit(0)).alias("below"),
        (F.coalesce("below", F.lit(0)) + F.col("_n")).alias("upto"), "rows")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    chunks: int | None = None) -> DataFrame:
    """(column_name, p, quantile): linear interpolation between the two nearest values, NULLs left out.

    All columns go through one shuffle as (column, value, count) after a map-side count, and positions come from
    a chunked running sum, so no task ever holds all values of a column.
    """
    counts = (
        df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns
        ])).alias("_v")).select("_v.*").where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n")))
    laid = lay_out(counts, ["column_name", "value"], chunks)
    placed = scan(laid, ["value"], [(["column_name"], {"below": ("sum", F.col("_n"))})])
    sizes = laid.groupBy("column_name").agg(F.sum("_n").alias("_rows"))  # one row per column
    targets = sizes.select("column_name", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"),
                           ((F.col("_rows") - 1).cast("double") * F.col("p")).alias("_at"))
    lo, hi = F.floor("_at"), F.ceil("_at")
    below = F.coalesce("below", F.lit(0))
    upto = below + F.col("_n")
    covers = ((lo >= below) & (lo < upto)) | ((hi >= below) & (hi < upto))
    near = placed.join(F.broadcast(targets), "column_name").where(covers)
    part = F.col("_at") - lo
    return near.groupBy("column_name", "p").agg(
        (F.min("value") * (F.lit(1.0) - F.first(part)) + F.max("value") * F.first(part)).alias("quantile"))
