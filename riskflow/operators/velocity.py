"""Time-window velocity per account: counts, volumes, extremes and distinct counterparties of earlier rows.

A row at time t sees rows with t - H <= time < t. Ordinary accounts use RANGE windows. For oversized accounts a
sliding window would keep hours of rows in one task and re-aggregate them for every row, so they take another
exact route whose work is linear:

* counts and volumes: every row adds its value at ``time`` and takes it back at ``time + H``; after summing per
  (account, time) the answer is a running sum, which ``over_chunks`` spreads over many tasks;
* distinct counterparties: the same, with the overlapping stays of one counterparty merged first;
* extremes: time is cut into blocks of length H, and a window is the tail of one block plus the head of the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.functions.numbers import micros
from riskflow.functions.rows import null_safe_join
from riskflow.operators.ordered import HotKeys, locate_hot_keys, over_chunks

SECOND = 1_000_000
HOT_VELOCITY_ROWS = 100_000
HORIZONS = {"10s": 10, "1m": 60, "1h": 3600, "24h": 86_400}


def velocity_windows(df: DataFrame, key: str, ts: str, amount: str, counterparty: str, counts: Mapping[str, int] = HORIZONS,
                     volumes: Mapping[str, int] | None = None, extremes: Mapping[str, int] | None = None,
                     distincts: Mapping[str, int] | None = None, hot_limit: int = HOT_VELOCITY_ROWS,
                     chunks: int | None = None) -> DataFrame:
    """Adds count_<h>, volume_<h>, max_<h>, min_<h> and distinct_<h> for the horizons given in seconds."""
    volumes = {"1h": 3600, "24h": 86_400} if volumes is None else volumes
    extremes = {"24h": 86_400} if extremes is None else extremes
    distincts = {"24h": 86_400} if distincts is None else distincts
    hot = locate_hot_keys(df.select(key), key, hot_limit)
    timed = df.withColumn("_at", micros(ts))
    ordinary = timed if hot is None else hot.cold_part(timed)
    w = W.partitionBy(key).orderBy("_at")
    def frame(seconds: int):
        return w.rangeBetween(-seconds * SECOND, -1)
    out = ordinary.select(
        *df.columns,
        *[F.count(F.lit(1)).over(frame(s)).alias(f"count_{h}") for h, s in counts.items()],
        *[F.coalesce(F.sum(amount).over(frame(s)).cast("double"), F.lit(0.0)).alias(f"volume_{h}") for h, s in volumes.items()],
        *[f(amount).over(frame(s)).cast("double").alias(f"{n}_{h}") for h, s in extremes.items() for n, f in (("max", F.max), ("min", F.min))],
        *[F.size(F.collect_set(counterparty).over(frame(s))).cast("long").alias(f"distinct_{h}") for h, s in distincts.items()])
    if hot is None:
        return out
    return out.unionByName(_hot_velocity(hot.hot_part(timed), df.columns, key, amount, counterparty, counts, volumes, extremes, distincts, chunks))


def _hot_velocity(rows: DataFrame, columns: Sequence[str], key: str, amount: str, counterparty: str, counts, volumes, extremes,
                  distincts, chunks) -> DataFrame:
    deltas = {f"count_{h}": (s, F.lit(1).cast("long")) for h, s in counts.items()}
    deltas |= {f"volume_{h}": (s, F.col(amount)) for h, s in volumes.items()}
    points = []
    for start in (True, False):
        for seconds in ({0} if start else {s for s, _ in deltas.values()}):
            shift = F.lit(seconds * SECOND)
            points.append(F.struct((F.col("_at") + shift).alias("at"), *[
                (value if start else -value if s == seconds else F.lit(None).cast("double")).alias(n) for n, (s, value) in deltas.items()]))
    types = {n: rows.select(v.alias(n)).schema[n].dataType for n, (_, v) in deltas.items()}
    points = [F.struct(p["at"].alias("at"), *[p[n].cast("decimal(38,6)" if types[n].typeName() in ("decimal", "double") else "long").alias(n)
                                              for n in deltas]) for p in points]
    events = rows.select(key, F.explode(F.array(*points)).alias("_p")).select(key, "_p.*")
    stays = _merged_stays(rows, key, counterparty, distincts, chunks)
    if stays is not None:
        events = events.unionByName(stays, allowMissingColumns=True)
    names = [*deltas, *[f"distinct_{h}" for h in distincts]]
    # one row per (account, instant): copies of an instant, however many, are combined before the shuffle
    instants = events.groupBy(key, "at").agg(*[F.sum(n).alias(n) for n in names])
    running = over_chunks(instants, [key], ["at"], {f"_{n}": ("sum", F.col(n)) for n in names}, chunks=chunks)
    result = null_safe_join(rows, running.select(key, F.col("at").alias("_at"), *[f"_{n}" for n in names]), [key, "_at"])
    for h, seconds in extremes.items():
        result = _hot_extremes(result, key, amount, h, seconds, chunks)
    return result.select(
        *columns,
        *[F.coalesce(F.col(f"_count_{h}"), F.lit(0)).cast("long").alias(f"count_{h}") for h in counts],
        *[F.coalesce(F.col(f"_volume_{h}"), F.lit(0)).cast("double").alias(f"volume_{h}") for h in volumes],
        *[F.col(f"_{n}_{h}").cast("double").alias(f"{n}_{h}") for h in extremes for n in ("max", "min")],
        *[F.coalesce(F.col(f"_distinct_{h}"), F.lit(0)).cast("long").alias(f"distinct_{h}") for h in distincts])


def _merged_stays(rows: DataFrame, key: str, counterparty: str, distincts: Mapping[str, int], chunks) -> DataFrame | None:
    """+1 where a counterparty becomes visible and -1 where it leaves, overlapping stays merged."""
    if not distincts:
        return None
    seen = rows.where(F.col(counterparty).isNotNull()).groupBy(key, counterparty, "_at").agg(F.lit(1).alias("_x"))
    near = over_chunks(seen, [key, counterparty], ["_at"], {}, depth=1, ahead=1, chunks=chunks, frames={
        "_before": lambda w: F.lag("_at", 1).over(w), "_after": lambda w: F.lead("_at", 1).over(w)})
    out = None
    for h, seconds in distincts.items():
        span = F.lit(seconds * SECOND)
        at = F.col("_at")
        opens, closes = F.col("_before").isNull() | (at > F.col("_before") + span), F.col("_after").isNull() | (F.col("_after") > at + span)
        part = near.select(key, F.explode(F.array_compact(F.array(
            F.when(opens, F.struct(at.alias("at"), F.lit(1).cast("long").alias(f"distinct_{h}"))),
            F.when(closes, F.struct((at + span).alias("at"), F.lit(-1).cast("long").alias(f"distinct_{h}")))))).alias("_p")).select(key, "_p.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _hot_extremes(rows: DataFrame, key: str, amount: str, name: str, seconds: int, chunks) -> DataFrame:
    span = F.lit(seconds * SECOND)
    values = rows.groupBy(key, "_at").agg(F.max(amount).alias("_hi"), F.min(amount).alias("_lo"))
    placed = values.withColumn("_block", F.floor(F.col("_at") / span))
    head = over_chunks(placed, [key, "_block"], ["_at"], {"_head_hi": ("max", F.col("_hi")), "_head_lo": ("min", F.col("_lo"))}, chunks=chunks)
    # the probe t - H lies in the block before the row's own block
    probes = values.select(key, (F.col("_at") - span).alias("_at"), F.lit(None).cast(values.schema["_hi"].dataType).alias("_hi"),
                           F.lit(None).cast(values.schema["_lo"].dataType).alias("_lo"))
    merged = values.unionByName(probes).groupBy(key, "_at").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    backwards = merged.withColumns({"_block": F.floor(F.col("_at") / span), "_back": -F.col("_at")})
    tail = over_chunks(backwards, [key, "_block"], ["_back"], {"_later_hi": ("max", F.col("_hi")), "_later_lo": ("min", F.col("_lo"))}, chunks=chunks)
    tail = tail.select(key, (F.col("_at") + span).alias("_at"), F.greatest("_hi", "_later_hi").alias("_tail_hi"),
                       F.least("_lo", "_later_lo").alias("_tail_lo"))
    both = null_safe_join(head, tail, [key, "_at"]).select(
        key, "_at", F.greatest("_head_hi", "_tail_hi").alias(f"_max_{name}"), F.least("_head_lo", "_tail_lo").alias(f"_min_{name}"))
    return null_safe_join(rows, both, [key, "_at"])


def receiver_velocity(df: DataFrame, hot_limit: int = HOT_VELOCITY_ROWS, chunks: int | None = None) -> DataFrame:
    """Distinct senders of the last 24 hours and seconds since the receiver was last paid (cold start 86400)."""
    seen = velocity_windows(df, "to_account", "ts", "amount_received", "from_account", counts={}, volumes={}, extremes={},
                            distincts={"24h": 86_400}, hot_limit=hot_limit, chunks=chunks)
    hot = locate_hot_keys(df.select("to_account"), "to_account", hot_limit)
    return with_previous_time(seen, "to_account", "receiver_seconds_since_last_tx", 86_400.0, 86_400, hot, chunks).withColumnRenamed(
        "distinct_24h", "receiver_in_degree_24h")


def with_previous_time(df: DataFrame, key: str, name: str, cold: float, horizon: int | None = None,
                       hot: HotKeys | None = None, chunks: int | None = None) -> DataFrame:
    """Seconds to the latest strictly earlier time of the key. Equal times are one group, so ties do not see each other."""
    previous = F.max("_at").over(W.partitionBy(key).orderBy("_at").rangeBetween(W.unboundedPreceding, -1))
    timed = df.withColumn("_at", micros("ts"))
    if hot is None:
        found = timed.withColumn("_prev", previous)
    else:
        cold_rows = hot.cold_part(timed).withColumn("_prev", previous)
        rows = hot.hot_part(timed)
        instants = rows.groupBy(key, "_at").agg(F.lit(1).alias("_x"))
        earlier = over_chunks(instants, [key], ["_at"], {"_prev": ("max", F.col("_at"))}, chunks=chunks).select(key, "_at", "_prev")
        found = cold_rows.unionByName(null_safe_join(rows, earlier, [key, "_at"]).select(*cold_rows.columns))
    gap = (F.col("_at") - F.col("_prev")) / F.lit(float(SECOND))
    if horizon is not None:
        gap = F.when(gap <= horizon, gap)
    return found.withColumn(name, F.coalesce(gap, F.lit(cold))).drop("_at", "_prev")


def documented_velocity(df: DataFrame, hot_limit: int = HOT_VELOCITY_ROWS, chunks: int | None = None) -> DataFrame:
    """1 h / 24 h / 7 d counts of both sides, 24 h sums, and mean and spread of the sender's last 24 hours."""
    spans = {"1h": 3600, "24h": 86_400, "7d": 604_800}
    day = {"24h": 86_400}
    squared = df.withColumn("_sq", (F.col("amount_paid") * F.col("amount_paid")).cast("decimal(30,4)"))
    sent = velocity_windows(squared, "from_account", "ts", "amount_paid", "to_account", spans, day, {}, {}, hot_limit, chunks)
    sent = sent.withColumnsRenamed({**{f"count_{h}": f"sender_tx_count_{h}" for h in spans}, "volume_24h": "sender_amount_sum_24h"})
    squares = velocity_windows(sent, "from_account", "ts", "_sq", "to_account", {}, day, {}, {}, hot_limit, chunks)
    got = velocity_windows(squares.withColumnRenamed("volume_24h", "_squares"), "to_account", "ts", "amount_received", "from_account",
                           spans, day, {}, {}, hot_limit, chunks)
    n, total = F.col("sender_tx_count_24h"), F.col("sender_amount_sum_24h")
    gap = n * F.col("_squares") - total * total
    return got.withColumnsRenamed({**{f"count_{h}": f"receiver_tx_count_{h}" for h in spans}, "volume_24h": "receiver_amount_sum_24h"}).withColumns({
        "sender_amount_mean_24h": F.when(n > 0, total / n).otherwise(0.0),
        "sender_amount_std_24h": F.when(n > 1, F.sqrt(F.greatest(gap, F.lit(0.0)) / (n * (n - 1)))).otherwise(0.0)}).drop("_sq", "_squares")
