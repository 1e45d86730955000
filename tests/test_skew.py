"""One key holds most rows: the chunked route must give what plain windows and brute force give."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.operators import features, online, ordered, velocity, warehouse


@pytest.fixture(scope="module")
def skewed(make_tx):
    rng = random.Random(5)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(900):
        sender = "HOT" if i % 2 else f"S{rng.randrange(30)}"
        # few distinct times, so that ties are common
        at = start + timedelta(minutes=rng.randrange(0, 4000, 7))
        rows.append((f"T{i:04d}", at.isoformat(sep=" "), sender, rng.choice(["HOT", "R1", "R2", "R3"]), rng.randrange(1, 40), int(rng.random() < 0.1)))
    return make_tx(rows).repartition(3).cache()


def same(left, right):
    right = right.select(*left.columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


SPLIT = features.FeatureConfig(hot_limit=100, chunks=7)


def test_hot_key_is_found(skewed):
    hot = ordered.locate_hot_keys(skewed, "from_account", 100)
    assert [r[0] for r in hot.keys.collect()] == ["HOT"]
    assert ordered.locate_hot_keys(skewed, "from_account", 10_000) is None


def test_feature_store_is_the_same_with_chunks(skewed):
    same(features.build_feature_store(skewed), features.build_feature_store(skewed, SPLIT))


def test_online_features_are_the_same_with_chunks(skewed):
    same(online.online_features(skewed), online.online_features(skewed, SPLIT))


def test_point_in_time_is_the_same_with_chunks(skewed):
    batch, history = skewed.where("is_laundering = 1"), skewed.where("is_laundering = 0")
    same(online.point_in_time_features(batch, history), online.point_in_time_features(batch, history, SPLIT))


def test_velocity_against_brute_force(skewed):
    horizons = {"10m": 600, "4h": 14_400}
    rows = [(r["transaction_id"], r["ts"], r["from_account"], r["to_account"], float(r["amount_paid"])) for r in skewed.collect()]
    want = {}
    for i, t, s, _, _ in rows:
        line = []
        for span in horizons.values():
            seen = [x for x in rows if x[2] == s and timedelta(0) < t - x[1] <= timedelta(seconds=span)]
            amounts = [x[4] for x in seen]
            line += [len(seen), sum(amounts), max(amounts, default=None), min(amounts, default=None), len({x[3] for x in seen})]
        want[i] = tuple(line)
    columns = [f"{n}_{h}" for h in horizons for n in ("count", "volume", "max", "min", "distinct")]
    for limit in (100_000, 100, 0):
        out = velocity.velocity_windows(skewed, "from_account", "ts", "amount_paid", "to_account", horizons, horizons, horizons, horizons, hot_limit=limit, chunks=5)
        assert {r["transaction_id"]: tuple(r[c] for c in columns) for r in out.collect()} == want


def test_ranks_and_running_sums(skewed):
    hot = ordered.locate_hot_keys(skewed, "from_account", 100)
    same(ordered.ranks_within(skewed, "from_account", "amount_paid", "transaction_id"),
         ordered.ranks_within(skewed, "from_account", "amount_paid", "transaction_id", hot, 6))
    running = {"s": ("sum", F.col("amount_paid")), "m": ("max", F.col("amount_paid"))}
    same(ordered.running_with_peers(skewed, "from_account", "ts", running), ordered.running_with_peers(skewed, "from_account", "ts", running, hot, 6))


@pytest.mark.parametrize("chunks", [1, 5, 40])
def test_scan_equals_plain_windows(skewed, chunks):
    order = ["ts", "transaction_id"]
    groups = [([], {"n": ("sum", F.lit(1))}), (["from_account"], {"paid": ("sum", F.col("amount_paid"))}), (["to_account"], {"top": ("max", F.col("amount_paid"))})]
    got = ordered.scan(ordered.lay_out(skewed, order, chunks), order, groups)
    def prior(*keys):
        return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    want = skewed.select("*", F.sum(F.lit(1)).over(prior()).alias("n"), F.sum("amount_paid").over(prior("from_account")).alias("paid"),
                         F.max("amount_paid").over(prior("to_account")).alias("top"))
    same(got, want)


def test_global_index_with_one_value_in_most_rows(skewed):
    rows = skewed.withColumn("v", F.when(F.col("from_account") == "HOT", F.lit(1)).otherwise(F.col("amount_paid").cast("int")))
    got = ordered.global_index(rows, ["v", "transaction_id"], "i", chunks=9)
    want = rows.withColumn("i", F.row_number().over(W.orderBy("v", "transaction_id")).cast("long"))
    same(got.select("transaction_id", F.col("i").cast("long").alias("i")), want.select("transaction_id", "i"))


def test_exact_quantiles(spark):
    df = spark.range(0, 997).select(((F.col("id") * 7919) % 1013).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id")).alias("b"))
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column_name"], r["p"]): r["quantile"] for r in ordered.exact_quantiles(df, ["a", "b"], points, chunks=6).collect()}
    for c in ("a", "b"):
        want = df.agg(F.percentile(c, F.array(*[F.lit(p) for p in points])).alias("q")).first()["q"]
        assert [got[(c, p)] for p in points] == pytest.approx(want)


def test_later_rows_never_change_earlier_features(skewed):
    cut = datetime(2026, 1, 2)
    early = skewed.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    columns = ["transaction_id", "account_total_paid", "unique_counterparties", "rolling_std_5", "amount_zscore", "bank_fraud_rate", "receiver_in_degree"]
    whole = features.build_feature_store(skewed).where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")).select(*columns)
    same(features.build_feature_store(early).select(*columns), whole)


def test_null_key_is_split_like_any_other(spark):
    rows = spark.createDataFrame([(None if i % 2 else f"k{i % 5}", i, float(i % 7)) for i in range(300)], "k string, t int, x double")
    hot = ordered.locate_hot_keys(rows, "k", 50)
    assert [r[0] for r in hot.keys.collect()] == [None]
    running = {"s": ("sum", F.col("x"))}
    same(ordered.over_history(rows, "k", ["t"], running), ordered.over_history(rows, "k", ["t"], running, hot=hot, chunks=6))
    same(ordered.ranks_within(rows, "k", "x", "t"), ordered.ranks_within(rows, "k", "x", "t", hot, 6))
    same(ordered.running_with_peers(rows, "k", "x", running), ordered.running_with_peers(rows, "k", "x", running, hot, 6))


def test_any_number_of_hot_keys(spark):
    rows = spark.range(3 * 1500).select((F.col("id") % 1500).alias("k"), F.col("id").alias("t"))
    hot = ordered.locate_hot_keys(rows, "k", 2)
    assert hot.keys.count() == 1500 and hot.cold_part(rows).count() == 0 and hot.hot_part(rows).count() == 4500
    assert ordered.locate_hot_keys(rows, "k", 3) is None


def test_velocity_is_the_same_on_both_sides_of_the_limit(skewed):
    args = (skewed, "from_account", "ts", "amount_paid", "to_account")
    same(velocity.velocity_windows(*args, hot_limit=10_000), velocity.velocity_windows(*args, hot_limit=5, chunks=5))


def test_days_as_chunks_give_the_same(skewed):
    order = ["ts", "transaction_id"]
    odd = skewed.withColumn("ts", F.when(F.col("transaction_id") < "T0020", None).otherwise(F.col("ts")))
    groups = [([], {"n": ("sum", F.lit(1))}), (["from_account"], {"paid": ("sum", F.col("amount_paid")), "top": ("max", F.col("amount_paid"))})]
    days = ordered.chunk_by_day(odd, order)
    assert "_pos" not in days.columns and days.select("_chunk").distinct().count() > 2
    by_day = ordered.scan(days, order, groups)
    same(by_day, ordered.scan(ordered.lay_out(odd, order, 7), order, groups))
    # a day above the limit is cut by range
    large = ordered.chunk_by_day(odd, order, limit=10)
    assert "_pos" in large.columns
    same(by_day, ordered.scan(large, order, groups))


def test_more_rows_are_scanned_in_more_tasks(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 30)
    order = ["ts", "transaction_id"]
    found = ordered.scan(ordered.chunk_by_day(skewed, order), order, [([], {"n": ("sum", F.lit(1))})])
    text = found._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(_chunk#\d+, 30\), REPARTITION_BY_NUM", text)
    assert found.where(F.col("n").isNull()).count() == 1


@pytest.mark.parametrize("limit", [10, ordered.HOT_KEY_ROWS])
def test_days_are_numbered_like_the_whole_table(skewed, monkeypatch, limit):
    order = ["ts", "transaction_id"]
    odd = skewed.withColumn("ts", F.when(F.col("transaction_id") < "T0020", None).otherwise(F.col("ts")))
    written = ordered.chunk_by_day(odd, order, limit=limit)
    found = ordered.number_days(written, written, order, "row_index")
    same(found, ordered.global_index(odd, order))


def test_facts_in_order_are_not_shuffled_again(skewed):
    built = warehouse.build_warehouse(skewed)
    assert built.in_order
    text = built.fact._jdf.queryExecution().toString()
    assert len(re.findall(r"Exchange rangepartitioning", text.split("== Physical Plan ==")[1])) == 1
    numbered = ordered.global_index(skewed, ["ts", "transaction_id"], "transaction_key").select("transaction_key", "transaction_id")
    same(built.fact.select("transaction_key", "transaction_id"), numbered)


def test_only_keys_over_several_chunks_are_carried(skewed):
    laid = ordered.lay_out(skewed, ["from_account", "ts", "transaction_id"], 7)
    parts = ordered._spanning_parts(laid, ["from_account"])
    whole = laid.groupBy("from_account").agg(F.count_distinct("_chunk").alias("n")).where("n > 1").join(laid, "from_account")
    same(parts.select("from_account", "_chunk"), whole.select("from_account", "_chunk").distinct())
    assert parts.count() <= 14 < laid.select("from_account", "_chunk").distinct().count()


def test_missing_amounts_are_not_looked_up(skewed):
    from riskflow.plans import analytics

    built = warehouse.build_warehouse(skewed)
    fact = built.fact.withColumn("amount_paid", F.when(F.col("transaction_key") % 2 == 0, F.col("amount_paid")))
    ranked = analytics.q41_percent_rank(warehouse.Warehouse(built.time, built.bank, built.account, built.currency, built.payment_format, fact))
    assert "isnotnull(amount_paid" in ranked._jdf.queryExecution().toString() and "isnull(amount_paid" in ranked._jdf.queryExecution().toString()
    missing = ranked.where("amount_paid IS NULL").agg(F.count("*"), F.min("pct_rank"), F.max("pct_rank"), F.min("cume_dist_val")).first()
    assert tuple(missing) == (450, 450 / 899, 450 / 899, 1.0)


def test_rows_do_not_travel_to_the_account_look_up(skewed):
    skewed.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = warehouse.build_warehouse(skewed)
        jvm = skewed.sparkSession._jvm
        text = built.fact._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\(account_number", text)
        assert sent and not any("transaction_id" in columns for columns in sent)
    finally:
        skewed.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [10, ordered.HOT_KEY_ROWS])
def test_accounts_without_a_row_keep_their_facts(skewed, monkeypatch, limit):
    monkeypatch.setattr(ordered.chunk_by_day, "__defaults__", (None, limit))
    odd = skewed.withColumn("to_account", F.when(F.col("transaction_id") >= "T0020", F.col("to_account")))
    tx = warehouse.written_rows(odd)
    assert ("_pos" in tx.columns) == (limit == 10)
    bank, account = warehouse.build_dim_bank(tx), warehouse.build_dim_account(tx)
    known = account.where("account_key > 1")
    fact = warehouse.load_fact(tx, bank, known, warehouse.build_dim_currency(tx), warehouse.build_dim_payment_format(tx))
    wanted = odd.select("transaction_id", "from_account", "to_account")
    for side in ("from", "to"):
        keys = known.select(F.col("account_number").alias(f"{side}_account"), F.col("account_key").alias(f"{side}_account_key"))
        wanted = wanted.join(keys, f"{side}_account", "left").fillna(-1, [f"{side}_account_key"])
    columns = ["transaction_id", "from_account_key", "to_account_key"]
    same(fact.select(columns), wanted.select(columns))
    assert fact.where("to_account_key = -1").count() >= 20
