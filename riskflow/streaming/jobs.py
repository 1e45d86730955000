"""Structured Streaming jobs: account states, sliding velocity, activity windows, bursts and scoring.

Which keys have come before is kept in Spark's keyed state store, so a batch asks for its own keys only and its cost does
not grow with what is stored. There is no watermark and no event is too late: results that a late event changes are computed again and
written as a new version of the same row, sums and intervals are parts that add up, and readers take the newest version
or the sum. A repeated key is ignored for all time; of unequal rows with one key in one batch any one counts.
Every job takes its checkpoint from the caller and can be stopped and started again; several checkpoints may feed one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows
from riskflow.functions.rows import null_safe_join
from riskflow.operators.online import STATE_SUMS, account_sums, point_in_time_features, point_in_time_within  # noqa: F401
from riskflow.operators.ordered import over_chunks
from riskflow.operators.velocity import velocity_windows, with_previous_time
from riskflow.session import materialize
from riskflow.streaming.sources import BatchTable, FoldedTable, newest, run_available


def first_seen(stream: DataFrame, key: str, keys: BatchTable) -> DataFrame:
    """Rows whose key no earlier batch has brought. The keys of this checkpoint are state; those of others, if there are
    any, are read."""
    others = keys.of_others()
    fresh = stream if others is None else stream.join(others.select(key).distinct(), key, "left_anti")
    return fresh.dropDuplicates([key])


# ---- account states -------------------------------------------------------------------------------------------

def _add_states(parts: DataFrame) -> DataFrame:
    return parts.groupBy("account_id").agg(
        F.sum("transaction_count").alias("transaction_count"), *[F.sum(c).alias(c) for c in STATE_SUMS],
        F.max("last_transaction_timestamp").alias("last_transaction_timestamp"))


def account_states_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "transaction_id", every: int = 16) -> list[dict]:
    """Every batch adds one row per account it touched, with exact sums, and the keys it brought (for other checkpoints)."""
    spark = stream.sparkSession
    states, keys = FoldedTable(spark, f"{path}/states", _add_states, checkpoint, every), BatchTable(spark, f"{path}/keys", checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # two tables come from one evaluation, so the state store is asked once
        batch.persist()
        states.add(account_sums(batch), batch_id)
        keys.write(batch.select(key), batch_id)
        batch.unpersist()

    return run_available(first_seen(stream, key, keys), sink, checkpoint)


def current_states(spark: SparkSession, path: str) -> DataFrame:
    return FoldedTable(spark, f"{path}/states", _add_states).read().withColumns({c: F.col(c).cast("double") for c in STATE_SUMS})


def _mark_later(stored: DataFrame, fresh: DataFrame, keys: list[str], seconds: int | None) -> DataFrame:
    """``_owed`` is true for stored rows that a fresh one precedes on one of the ``keys``, by ``seconds`` at most. Fresh rows are
    one row per key in the join, so no stored row is multiplied."""
    touched: Column = F.lit(False)
    rows = stored
    for key in keys:
        spans = fresh.groupBy(key).agg(F.min("ts").alias(f"_low_{key}"), F.max("ts").alias(f"_high_{key}"))
        rows = null_safe_join(rows, spans, [key], "left")
        after = F.col("ts") > F.col(f"_low_{key}")
        if seconds is not None:
            after &= F.col("ts") <= F.col(f"_high_{key}") + F.make_dt_interval(secs=F.lit(seconds))
        touched |= F.coalesce(after, F.lit(False))
    return rows.select(*stored.columns, touched.alias("_owed"))


# ---- sliding velocity -----------------------------------------------------------------------------------------

def velocity_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", account: str = "user_id", other: str = "event_type",
                    amount: str = "value", hot_limit: int | None = None) -> list[dict]:
    """Counts, volumes, extremes, average and distinct counterparties of the sending side, in-degree and time since the
    last event of the receiving side, for every new event and again for every stored one that a late event precedes
    by a day at most. A batch meets the stored events of the days around its own (the store is cut by day, older
    days are never read); busy accounts take the linear route of ``velocity_windows``, so no task holds an account's day."""
    spark = stream.sparkSession
    events, results = BatchTable(spark, f"{path}/events", checkpoint), BatchTable(spark, f"{path}/velocity", checkpoint)
    limit = {} if hot_limit is None else {"hot_limit": hot_limit}

    def sink(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        events.write(batch.withColumn("day", F.col("ts").cast("date")), batch_id, ("day",))
        fresh = spark.read.schema(batch.schema).parquet(f"{events.path}/run={events.run}/batch_id={batch_id}")
        days = fresh.agg(F.min("ts").cast("date").alias("low"), F.max("ts").cast("date").alias("high")).first()
        if days["low"] is None:
            return
        stored = events.before(batch_id)
        marked = fresh.select(*columns, F.lit(True).alias("_owed"))
        if stored is not None:
            near = stored.where((F.col("day") >= F.date_sub(F.lit(days["low"]), 1)) & (F.col("day") <= F.date_add(F.lit(days["high"]), 1))).select(*columns)
            again = _mark_later(near, fresh, [account, other], 86_400).where("_owed").select(key)
            marked = marked.unionByName(null_safe_join(near, again.withColumn("_owed", F.lit(True)), [key], "left").withColumn("_owed", F.coalesce("_owed", F.lit(False))))
        sent = velocity_windows(marked, account, "ts", amount, other, **limit).withColumn(
            "avg_24h", F.when(F.col("count_24h") > 0, F.col("volume_24h") / F.col("count_24h")))
        got = velocity_windows(sent.withColumnRenamed("distinct_24h", "_sent"), other, "ts", amount, account, counts={}, volumes={}, extremes={}, **limit)
        got = with_previous_time(got.withColumnsRenamed({"distinct_24h": "receiver_in_degree_24h", "_sent": "distinct_24h"}),
                                 other, "receiver_seconds_since_last", 86_400.0, 86_400)
        results.write_version(got.where("_owed").drop("_owed", *[c for c in columns if c != key]), batch_id)

    return run_available(first_seen(stream, key, events), sink, checkpoint)


def stored_velocity(spark: SparkSession, path: str, key: str = "event_id") -> DataFrame:
    return newest(spark, f"{path}/velocity", key)


# ---- activity windows and bursts ------------------------------------------------------------------------------

def windowed_activity(df: DataFrame, account: str, length: str, slide: str | None = None) -> DataFrame:
    """Counts and exact volume per account and tumbling or sliding window."""
    return df.groupBy(account, F.window(F.col("ts").cast("timestamp"), length, slide or length).alias("w")).agg(
        count_rows().alias("event_count"), F.sum("amount").alias("volume")).select(
        account, F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "event_count", "volume")


def _add_windows(account: str) -> Callable[[DataFrame], DataFrame]:
    return lambda parts: parts.groupBy(account, "window_start", "window_end").agg(F.sum("event_count").alias("event_count"), F.sum("volume").alias("volume"))


def activity_stream(stream: DataFrame, path: str, checkpoint: str, account: str, length: str, slide: str | None = None, key: str | None = None, every: int = 16) -> list[dict]:
    """Each batch writes what it adds to its windows, however old they are. With a ``key`` a repeated event counts once."""
    parts = FoldedTable(stream.sparkSession, path, _add_windows(account), checkpoint, every)
    once = stream if key is None else stream.dropDuplicates([key])
    return run_available(once, lambda batch, batch_id: parts.add(windowed_activity(batch, account, length, slide), batch_id), checkpoint)


def current_windows(spark: SparkSession, path: str, account: str) -> DataFrame:
    return FoldedTable(spark, path, _add_windows(account)).read().withColumn("volume", F.col("volume").cast("double"))


def merge_intervals(parts: DataFrame, account: str, chunks: int | None = None) -> DataFrame:
    """Bursts from intervals (session_start, session_end, event_count, volume): those of an account that overlap become one. An account of any
    size is laid out in chunks, and what earlier chunks reach is carried into the next."""
    starts = parts.groupBy(account, "session_start").agg(F.max("session_end").alias("session_end"), F.sum("event_count").alias("event_count"), F.sum("volume").alias("volume"))
    reached = over_chunks(starts, [account], ["session_start"], {"_reach": ("max", F.col("session_end"))}, chunks=chunks)
    opens = (F.col("_reach").isNull() | (F.col("session_start") >= F.col("_reach"))).cast("long")
    numbered = over_chunks(reached.withColumn("_opens", opens).drop("_reach"), [account], ["session_start"], {"_before": ("sum", F.col("_opens"))}, chunks=chunks)
    return numbered.groupBy(account, (F.coalesce("_before", F.lit(0)) + F.col("_opens")).alias("_burst")).agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("event_count").alias("event_count"),
        F.sum("volume").alias("volume")).drop("_burst")


def event_intervals(df: DataFrame, account: str, seconds: int) -> DataFrame:
    """Each event as the interval in which a further one joins its burst."""
    return df.where(F.col("ts").isNotNull()).select(
        account, F.col("ts").alias("session_start"), (F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("session_end"),
        F.lit(1).cast("long").alias("event_count"), F.col("amount").alias("volume"))


def session_bursts(df: DataFrame, account: str, seconds: int = 300, chunks: int | None = None) -> DataFrame:
    """Bursts of an account: events with less than ``seconds`` between neighbours."""
    return merge_intervals(event_intervals(df, account, seconds), account, chunks).withColumn("volume", F.col("volume").cast("double"))


def session_stream(stream: DataFrame, path: str, checkpoint: str, account: str, seconds: int = 300, key: str | None = None, every: int = 16) -> list[dict]:
    """Each batch writes the bursts of its own events; bursts are intervals that coalesce, so a late event joins two stored
    ones when parts are folded or read, and events themselves are not kept. With a ``key`` a repeated event counts once."""
    parts = FoldedTable(stream.sparkSession, path, lambda rows: merge_intervals(rows, account), checkpoint, every)
    once = stream if key is None else stream.dropDuplicates([key])
    return run_available(once, lambda batch, batch_id: parts.add(merge_intervals(event_intervals(batch, account, seconds), account), batch_id), checkpoint)


def current_sessions(spark: SparkSession, path: str, account: str) -> DataFrame:
    """All bursts so far, those that are still open too."""
    return FoldedTable(spark, path, lambda rows: merge_intervals(rows, account)).read().withColumn("volume", F.col("volume").cast("double"))


# ---- scoring --------------------------------------------------------------------------------------------------

def scoring_stream(stream: DataFrame, history_path: str, scores_path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
                   key: str = "transaction_id") -> list[dict]:
    """Per batch: features from every stored or just arrived event that is strictly earlier in time, then scores, then
    the batch becomes history. A row never sees itself. Stored rows of a late event's sender or receiver that come
    after it are scored again, and no others, so the newest scores are those of the whole history in whatever order
    and batches it came."""
    spark = stream.sparkSession
    history, scores = BatchTable(spark, history_path, checkpoint), BatchTable(spark, scores_path, checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        history.write(batch, batch_id)
        fresh = spark.read.schema(batch.schema).parquet(f"{history_path}/run={history.run}/batch_id={batch_id}")
        stored = history.before(batch_id)
        if fresh.isEmpty():  # only keys that came before: no score changes
            return
        marked = fresh.withColumn("_owed", F.lit(True))
        if stored is not None:
            # written, because every step below reads it
            marked = materialize(marked.unionByName(_mark_later(stored.select(*batch.columns), fresh, ["from_account", "to_account"], None)))
        scores.write_version(score(point_in_time_within(marked)), batch_id)

    return run_available(first_seen(stream, key, history), sink, checkpoint)


def stored_scores(spark: SparkSession, path: str, key: str = "transaction_id") -> DataFrame:
    return newest(spark, path, key)
