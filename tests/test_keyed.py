"""Look-ups in tables laid out by key."""

import pytest
from pyspark.sql import functions as F

from riskflow.operators.online import account_states
from riskflow.session import staging_path
from riskflow.sources import keyed
from riskflow.sources.star_tables import transactions


def files_read(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numFiles").get().value()


@pytest.fixture(scope="module")
def history(spark):
    """A third of the rows belong to one account; some have none."""
    number = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 != 1, F.col("id") % 499)
    return spark.range(20_000).select(F.concat(F.lit("A"), number.cast("string")).alias("account_id"), F.col("id").alias("at"))


def test_rows_are_those_of_a_filter(spark, history):
    path = staging_path(spark, "keyed")
    assert keyed.write_keyed(history, path, "account_id", ["at"], 500) == 40
    wanted = ["A0", "A7", "A42", "A42", "missing"]
    want = sorted(history.where(F.col("account_id").isin(wanted)).collect())
    assert sorted(keyed.rows_of_keys(spark, path, "account_id", wanted).collect()) == want
    assert keyed.rows_of_keys(spark, path, "account_id", []).count() == 0
    accounts = spark.createDataFrame([(w,) for w in [*wanted, None]], "account string")
    assert sorted(keyed.rows_of_table(spark, path, "account_id", accounts).collect()) == want
    assert spark.read.parquet(path).count() == history.count()


def test_files_read_do_not_grow(spark, history):
    """Four times the rows, the same files for three accounts."""
    read = []
    for copies in (1, 4):
        path = staging_path(spark, "keyed")
        keyed.write_keyed(history.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(copies)))), path, "account_id", folder_rows=500)
        found = keyed.rows_of_keys(spark, path, "account_id", ["A7", "A42", "A98"])
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        read.append(files_read(found))
    assert read[1] <= read[0] <= 3


def test_a_short_list_picks_folders_at_run_time(spark, history):
    path = staging_path(spark, "keyed")
    keyed.write_keyed(history, path, "account_id", folder_rows=500)
    found = keyed.rows_of_table(spark, path, "account_id", spark.createDataFrame([("A7",)], "account string"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_states_are_looked_up(spark, sf):
    states = account_states(transactions(spark, sf))
    path = staging_path(spark, "states")
    keyed.write_keyed(states, path, "account_id", folder_rows=10)
    some = [r[0] for r in states.select("account_id").orderBy("account_id").limit(3).collect()]
    assert sorted(keyed.rows_of_keys(spark, path, "account_id", some).collect()) == sorted(states.where(F.col("account_id").isin(some)).collect())


def test_an_empty_table_and_a_plain_folder(spark, history):
    path = staging_path(spark, "keyed")
    history.write.parquet(path)
    with pytest.raises(ValueError):
        keyed.rows_of_keys(spark, path, "account_id", ["A7"])
    with pytest.raises(ValueError):
        keyed.write_keyed(history.where("false"), staging_path(spark, "keyed"), "account_id")
