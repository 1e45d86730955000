"""Streams over the events table: each job runs over all events and its result is compared with plain SQL."""

from pyspark.sql import functions as F

from riskflow.catalog.online_entries import T1, events
from riskflow.catalog.registry import big, register, total
from riskflow.session import staging_path
from riskflow.sources.star_tables import table
from riskflow.streaming import jobs
from riskflow.streaming.sources import stream_files

CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def as_transfers(events):
    """An event seen as a transfer from its user to its event type."""
    amount = F.col("value").cast("decimal(18,2)")
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"), "ts", F.concat(F.lit("U"), F.col("user_id")).alias("from_account"),
        F.col("event_type").alias("to_account"), amount.alias("amount_paid"), amount.alias("amount_received"),
        (F.col("user_id") % 7).cast("int").alias("from_bank"), F.lit(0).alias("to_bank"), F.lit("USD").alias("payment_currency"),
        F.lit("USD").alias("receiving_currency"), F.col("event_type").alias("payment_format"))


def feed(spark, df, job, order=(0, 1, 2), repeat=()):
    """The table arrives in parts by time, in the given order, some parts again at the end. After each arrival the job is
    started anew with the same checkpoint, as after a stop."""
    path, checkpoint = staging_path(spark, "arriving"), staging_path(spark, "checkpoint")
    edges = [None, *CUTS, None]
    for k in (*order, *repeat):
        part = df
        if edges[k]:
            part = part.where(F.col("ts") >= F.lit(edges[k]).cast("timestamp_ntz"))
        if edges[k + 1]:
            part = part.where(F.col("ts") < F.lit(edges[k + 1]).cast("timestamp_ntz"))
        part.write.mode("append").parquet(path)
        job(stream_files(spark, path, df.schema), checkpoint)


def t12(spark, sf):
    """The middle part comes ten days late."""
    path = staging_path(spark, "states")
    feed(spark, as_transfers(table(spark, sf, "events")), lambda stream, at: jobs.account_states_stream(stream, path, at), (0, 2, 1))
    return jobs.current_states(spark, path)


register("t12_account_states_stream", t12, f"""
    WITH e AS (SELECT *, CAST(value AS DECIMAL(18,2)) AS amount FROM events)
    SELECT account_id, {big("SUM(sent)")} AS transaction_count, {total("paid")} AS total_amount_paid, {total("received")} AS total_amount_received,
      {total("paid * paid")} AS amount_sum_sq, MAX(sent_at) AS last_transaction_timestamp FROM (
      SELECT 'U' || user_id AS account_id, 1 AS sent, amount AS paid, CAST(0 AS DECIMAL(18,2)) AS received, ts AS sent_at FROM e
      UNION ALL SELECT event_type, 0, CAST(0 AS DECIMAL(18,2)), amount, NULL FROM e) GROUP BY 1""")


def t13_stream(spark, sf):
    """Every event arrives twice in its batch, and the first part once more three batches later; the states count it once."""
    path = staging_path(spark, "states")
    transfers = as_transfers(table(spark, sf, "events"))
    feed(spark, transfers.unionByName(transfers), lambda stream, at: jobs.account_states_stream(stream, path, at), repeat=(0,))
    return jobs.current_states(spark, path).select("account_id", "transaction_count", "total_amount_paid")


register("t13_idempotent_stream", t13_stream, f"""
    SELECT 'U' || user_id AS account_id, {big("COUNT(*)")} AS transaction_count, {total("CAST(value AS DECIMAL(18,2))")} AS total_amount_paid
    FROM events GROUP BY 1 UNION ALL SELECT DISTINCT event_type, 0, 0.0 FROM events""")


def t14(order):
    def run(spark, sf):
        path = staging_path(spark, "velocity")
        feed(spark, events(spark, sf), lambda stream, at: jobs.velocity_stream(stream, path, at), order, repeat=(1,))
        return jobs.stored_velocity(spark, path)
    return run


VELOCITY = T1.replace(" FROM e WINDOW ", """, COUNT(DISTINCT user_id) OVER r24h AS receiver_in_degree_24h,
    COALESCE(CAST(epoch_us(ts) - epoch_us(MAX(ts) OVER r24h) AS DOUBLE) / 1000000.0, 86400.0) AS receiver_seconds_since_last
    FROM e WINDOW r24h AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), """)
register("t14_velocity_stream", t14((0, 2, 1)), VELOCITY)
register("t14_velocity_stream_backwards", t14((2, 1, 0)), VELOCITY)


def measured(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("value").cast("decimal(18,2)").alias("amount"))


def t16(slide):
    def run(spark, sf):
        path = staging_path(spark, "windows")
        feed(spark, measured(spark, sf), lambda stream, at: jobs.activity_stream(stream, path, at, "user_id", "1 day", slide, "event_id"), (2, 0, 1), repeat=(0,))
        return jobs.current_windows(spark, path, "user_id")
    return run


AMOUNT = "CAST(value AS DECIMAL(18,2))"
register("t16_tumbling_stream", t16(None), f"""SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
    COUNT(*) AS event_count, {total(AMOUNT)} AS volume FROM events GROUP BY 1, 2, 3""")
register("t16_sliding_stream", t16("6 hours"), f"""SELECT user_id, s AS window_start, s + INTERVAL 1 DAY AS window_end, COUNT(*) AS event_count,
    {total(AMOUNT)} AS volume FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 6 HOUR AS s
    FROM events, range(4) r(k)) GROUP BY 1, 2""")

SESSIONS = f"""WITH g AS (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 300 SECOND THEN 0 ELSE 1 END AS opens FROM events),
    n AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
    s AS (SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 300 SECOND AS session_end, COUNT(*) AS event_count, {total(AMOUNT)} AS volume
          FROM n GROUP BY user_id, k)"""
register("t16_session_bursts", lambda spark, sf: jobs.session_bursts(measured(spark, sf), "user_id"), SESSIONS + " SELECT * FROM s")


def t16_sessions(spark, sf):
    path = staging_path(spark, "sessions")
    feed(spark, measured(spark, sf), lambda stream, at: jobs.session_stream(stream, path, at, "user_id", key="event_id", every=2), (1, 0, 2), repeat=(1,))
    return jobs.current_sessions(spark, path, "user_id")


register("t16_session_stream", t16_sessions, SESSIONS + " SELECT * FROM s")


def stream_score(df):
    """A fixed linear score, so that the stream can be checked row by row."""
    points = F.least(F.col("account_transaction_count"), F.lit(100.0)) + F.when(F.col("amount_paid") > 100, 50.0).otherwise(0.0)
    return df.select("transaction_id", "account_transaction_count", "account_total_paid", points.alias("score"))


def t17(order):
    def run(spark, sf):
        history, scores = staging_path(spark, "history"), staging_path(spark, "scores")
        feed(spark, as_transfers(table(spark, sf, "events")), lambda stream, at: jobs.scoring_stream(stream, history, scores, at, stream_score), order, repeat=(0,))
        return jobs.stored_scores(spark, scores)
    return run


SCORED = f"""
    WITH e AS (SELECT event_id, {AMOUNT} AS amount, COUNT(*) OVER w AS n, SUM({AMOUNT}) OVER w AS paid FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
    SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(n AS DOUBLE) AS account_transaction_count, CAST(COALESCE(paid, 0) AS DOUBLE) AS account_total_paid,
      least(CAST(n AS DOUBLE), 100.0) + CASE WHEN amount > 100 THEN 50.0 ELSE 0.0 END AS score FROM e"""
register("t17_scoring_stream", t17((0, 2, 1)), SCORED)
register("t17_scoring_stream_backwards", t17((2, 1, 0)), SCORED)
