"""Streams across restarts, repeats and late events, against plain batch results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskflow.operators.online import account_states
from riskflow.streaming import jobs
from riskflow.streaming.sources import FoldedTable, stream_files

START = datetime(2026, 1, 1)


@pytest.fixture
def feed(tmp_path):
    """Writes rows as newly arrived files and starts the job anew with its checkpoint."""
    def run(rows, job):
        path = str(tmp_path / "arriving")
        rows.write.mode("append").parquet(path)
        job(stream_files(rows.sparkSession, path, rows.schema), str(tmp_path / "checkpoint"))
    return run


def tx(make_tx, numbers, shift=0):
    return make_tx([(f"T{i}", str(START + timedelta(minutes=i + shift)), f"S{i % 3}", f"R{i % 2}", i + 1, 0) for i in numbers])


def test_states_survive_restarts_repeats_and_late_rows(spark, make_tx, feed, tmp_path):
    path = str(tmp_path / "states")
    job = lambda stream, at: jobs.account_states_stream(stream, path, at)
    for part in (range(50, 100), range(0, 20), range(60, 80), range(20, 50), range(0, 5)):  # late by far, and repeated batches later
        feed(tx(make_tx, part), job)
    want = account_states(tx(make_tx, range(100)))
    got = jobs.current_states(spark, path).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_two_checkpoints_do_not_overwrite_each_other(spark, make_tx, tmp_path):
    path = str(tmp_path / "states")
    for k, part in enumerate((range(30), range(20, 60))):
        source = str(tmp_path / f"in{k}")
        rows = tx(make_tx, part)
        rows.write.parquet(source)
        jobs.account_states_stream(stream_files(spark, source, rows.schema), path, str(tmp_path / f"at{k}"))
    assert jobs.current_states(spark, path).agg(F.sum("transaction_count")).first()[0] == 60


def test_a_late_event_sees_its_whole_day(spark, feed, tmp_path):
    rows = lambda *times: spark.createDataFrame([(i, t, 1, "a", 1.0) for i, t in times], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("value", F.col("value").cast("decimal(18,2)"))
    path = str(tmp_path / "v")
    job = lambda stream, at: jobs.velocity_stream(stream, path, at)
    feed(rows((1, datetime(2026, 1, 1, 0, 10)), (2, datetime(2026, 1, 2, 0, 30))), job)
    feed(rows((3, datetime(2026, 1, 1, 23, 50))), job)
    got = {r["event_id"]: r["count_24h"] for r in jobs.stored_velocity(spark, path).collect()}
    assert got == {1: 0, 2: 1, 3: 1}  # the second event was there before the third, which precedes it by 40 minutes


@pytest.mark.parametrize("parts", [1, 4])
def test_scores_do_not_depend_on_batches(spark, make_tx, feed, tmp_path, parts):
    history, scores = str(tmp_path / "h"), str(tmp_path / "s")
    score = lambda df: df.select("transaction_id", "account_transaction_count", "account_total_paid")
    for k in range(parts):
        feed(tx(make_tx, range(k * 40 // parts, (k + 1) * 40 // parts)), lambda stream, at: jobs.scoring_stream(stream, history, scores, at, score))
    got = {r[0]: (r[1], r[2]) for r in jobs.stored_scores(spark, scores).select("transaction_id", "account_transaction_count", "account_total_paid").collect()}
    assert got == {f"T{i}": (i // 3, sum(j + 1 for j in range(i % 3, i, 3))) for i in range(40)}


def test_cost_of_a_batch_does_not_grow(spark, make_tx, feed, tmp_path):
    """Keys are asked of the state store: each batch updates as many entries as it has rows, and reads no stored key;
    parts are folded, so a reader meets a bounded number of them."""
    path, progress = str(tmp_path / "states"), []
    job = lambda stream, at: progress.extend(jobs.account_states_stream(stream, path, at, every=3))
    for k in range(7):
        feed(tx(make_tx, range(k * 10 - (5 if k else 0), k * 10 + 10)), job)  # every part repeats five rows
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    assert updated == [10] * 7 and [p["numInputRows"] for p in progress if p["numInputRows"]] == [10] + [15] * 6
    states = FoldedTable(spark, f"{path}/states", lambda rows: rows)
    assert len(states.read().inputFiles()) <= 4 * 4 * 3
    want = account_states(tx(make_tx, range(70)))
    got = jobs.current_states(spark, path).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


ORDERS = [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)]


@pytest.mark.parametrize("order", ORDERS)
def test_scores_do_not_depend_on_the_order_of_arrival(spark, make_tx, feed, tmp_path, order):
    history, scores = str(tmp_path / "h"), str(tmp_path / "s")
    names = ["transaction_id", "account_transaction_count", "account_total_paid", "account_total_received", "rolling_mean_5", "seconds_since_last_tx", "unique_counterparties"]
    score = lambda df: df.select(*[c for c in names if c in df.columns])
    for k in order:
        feed(tx(make_tx, range(k * 12, k * 12 + 12)), lambda stream, at: jobs.scoring_stream(stream, history, scores, at, score))
    rows = tx(make_tx, range(48))
    want = score(jobs.point_in_time_features(rows, rows))
    got = jobs.stored_scores(spark, scores).select(*want.columns)
    assert got.count() == 48 and got.exceptAll(want).count() == 0


def test_only_later_rows_of_touched_accounts_are_scored_again(spark, make_tx, feed, tmp_path):
    history, scores = str(tmp_path / "h"), str(tmp_path / "s")
    score = lambda df: df.select("transaction_id", "account_transaction_count")
    rows = lambda *r: make_tx([(i, str(START + timedelta(minutes=m)), a, b, 1, 0) for i, m, a, b in r])
    job = lambda stream, at: jobs.scoring_stream(stream, history, scores, at, score)
    feed(rows(("1", 0, "A", "B"), ("2", 10, "A", "C"), ("3", 10, "D", "B"), ("4", 20, "E", "F")), job)
    feed(rows(("5", 5, "A", "B")), job)
    written = spark.read.parquet(scores).groupBy("transaction_id").count().collect()
    assert {r[0]: r[1] for r in written} == {"1": 1, "2": 2, "3": 2, "4": 1, "5": 1}


def odd_rows(spark):
    """Equal times, busy receivers, and rows without a sender, a receiver or an amount."""
    from decimal import Decimal
    from random import Random

    rng = Random(7)
    rows = [(f"T{i}", START + timedelta(hours=rng.randrange(90)), rng.choice(("A", "B", "C", None)), rng.choice(("x", "x", "x", "y", None)),
             rng.choice((Decimal(i), Decimal(i), None)), Decimal(i)) for i in range(160)]
    return spark.createDataFrame(rows, "transaction_id string, ts timestamp_ntz, from_account string, to_account string, amount_paid decimal(18,2), amount_received decimal(18,2)").withColumns(
        {"from_bank": F.lit(1), "to_bank": F.lit(2), "payment_currency": F.lit("USD"), "receiving_currency": F.lit("USD"), "payment_format": F.lit("ACH")})


@pytest.mark.parametrize("limit", [None, 60, 20])
def test_features_within_a_table_are_those_against_it_as_history(spark, limit):
    """No hot account, a receiver cut by day, and one with too many rows in a day."""
    from riskflow.operators import online
    from riskflow.operators.features import FeatureConfig

    rows = odd_rows(spark)
    owed = F.col("ts") >= F.lit(str(START + timedelta(hours=30))).cast("timestamp_ntz")
    want = online.point_in_time_features(rows.where(owed), rows)
    got = online.point_in_time_within(rows.withColumn("_owed", owed), cfg=FeatureConfig(hot_limit=limit, chunks=5)).select(*want.columns)
    assert got.count() == rows.where(owed).count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plain = {r["transaction_id"]: r for r in rows.collect()}
    for r in got.collect():
        before = [x for x in plain.values() if x["from_account"] == r["from_account"] and x["ts"] < r["ts"]]
        assert r["account_transaction_count"] == len(before) and r["account_total_paid"] == float(sum(x["amount_paid"] or 0 for x in before))
        assert r["account_total_received"] == float(sum(x["amount_received"] for x in plain.values() if x["to_account"] == r["to_account"] and x["ts"] < r["ts"]))


def test_a_busy_receiver_costs_nothing_if_no_score_reads_it(spark, make_tx, feed, tmp_path, monkeypatch):
    """Its history is not laid out; and a batch that only repeats stored rows writes no scores."""
    from riskflow.operators import ordered

    history, scores, laid = str(tmp_path / "h"), str(tmp_path / "s"), []
    monkeypatch.setattr(ordered.locate_hot_keys, "__defaults__", (15,))
    monkeypatch.setattr(ordered, "lay_out", lambda df, *rest, f=ordered.lay_out: laid.append(df.columns) or f(df, *rest))
    score = lambda df: df.select("transaction_id", "account_transaction_count", "account_total_paid")
    for part in (range(20, 40), range(20), range(20, 30)):
        feed(tx(make_tx, part), lambda stream, at: jobs.scoring_stream(stream, history, scores, at, score))
    got = {r[0]: (r[1], r[2]) for r in jobs.stored_scores(spark, scores).select("transaction_id", "account_transaction_count", "account_total_paid").collect()}
    assert got == {f"T{i}": (i // 3, sum(j + 1 for j in range(i % 3, i, 3))) for i in range(40)}
    assert not laid
    assert spark.read.parquet(scores).select("run", "batch_id").distinct().count() == 2
    assert len(list((tmp_path / "s").glob("run=*/batch_id=*"))) == 2


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("hot_limit", [None, 3])
def test_velocity_does_not_depend_on_the_order_of_arrival(spark, feed, tmp_path, order, hot_limit):
    from random import Random

    rng = Random(1)
    all_rows = [(i, START + timedelta(minutes=rng.randrange(6000)), rng.randrange(3), rng.choice("ab"), 1.0 + i) for i in range(60)]
    table = lambda rows: spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("value", F.col("value").cast("decimal(18,2)"))
    parts, results = sorted(all_rows, key=lambda r: r[1]), {}
    for name, cut in (("cut", [parts[k * 15 : k * 15 + 15] for k in order]), ("whole", [all_rows])):
        path, source, at = (str(tmp_path / f"{name}-{x}") for x in ("v", "in", "at"))
        for part in cut:
            rows = table(part)
            rows.write.mode("append").parquet(source)
            jobs.velocity_stream(stream_files(spark, source, rows.schema), path, at, hot_limit=hot_limit)
        results[name] = jobs.stored_velocity(spark, path)
    assert results["cut"].count() == 60 and results["cut"].exceptAll(results["whole"].select(*results["cut"].columns)).count() == 0


def test_late_events_join_bursts(spark, feed, tmp_path):
    """Intervals coalesce over batches and folds; equal to cutting all events at once, for one hot account in many chunks too."""
    from random import Random

    rng = Random(4)
    rows = [(i, START + timedelta(seconds=rng.randrange(40_000)), rng.choice((1, 1, 1, 2, None)), 1.0) for i in range(300)]
    table = lambda part: spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    path = str(tmp_path / "s")
    for k in (2, 0, 4, 1, 3, 0):
        feed(table(rows[k * 60 : k * 60 + 60]), lambda stream, at: jobs.session_stream(stream, path, at, "user_id", key="event_id", every=2))
    got = {tuple(r) for r in jobs.current_sessions(spark, path, "user_id").collect()}
    want = set()
    for user in (1, 2, None):
        burst = None
        for t in sorted(t for _, t, u, _ in rows if u == user):
            if burst is None or t >= burst[2]:
                if burst:
                    want.add(tuple(burst))
                burst = [user, t, t, 0, 0.0]
            burst[2], burst[3], burst[4] = t + timedelta(seconds=300), burst[3] + 1, burst[4] + 1
        want.add(tuple(burst))
    assert got == want
    assert {tuple(r) for r in jobs.session_bursts(table(rows), "user_id", chunks=5).collect()} == want
