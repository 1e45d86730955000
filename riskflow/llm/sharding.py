"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into even virtual partitions. How many rows each partition sends to each shard is drawn exactly: a row of
the matrix is a multivariate hypergeometric draw from what the shards still have room for, so rows and columns add up to
partition and shard sizes and every assignment is equally likely. Each partition permutes its rows and cuts them by its
matrix row, shards exchange, and every shard permutes again. Only DataFrame functions are used; draws are inversions of
the distribution function, written with array functions.

The draws go through groups of partitions first, then through the partitions of each group at the same time, so no task
draws for more than the square root of the matrix.

Rules: a null text has no bytes and the check sum of an empty text; null ids, repeated ids and repeated rows are rows like
any other (a row is known by its place in the input, which a written table fixes for good); an empty table gives no rows;
other columns are not read. Shard sizes differ by one at most, slots are gapless from 0 in each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.session import materialize

SEED = 20_240
#: Virtual partitions: this many groups of this many. Their number bounds the matrix, which is broadcast.
GROUPS, PER_GROUP = 32, 32


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def uniform(*values: Column) -> Column:
    """A number from 0 to below 1 that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(drawn: Column, marked: Column, total: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked``: the inverse of the distribution function at
    ``u``. The sum goes over 12 standard deviations on both sides; what lies beyond is below double precision."""
    n, k, t = (x.cast("double") for x in (drawn, marked, total))
    mean = n * k / F.greatest(t, F.lit(1.0))
    spread = F.sqrt(F.greatest(mean * (t - k) / F.greatest(t, F.lit(1.0)) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0))) * 12 + 3
    low = F.greatest(F.lit(0.0), n + k - t, F.floor(mean - spread)).cast("long")
    high = F.least(n, k, F.ceil(mean + spread)).cast("long")

    def ratio(x: Column) -> Column:  # of the weight of x + 1 to that of x
        return (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))

    def found(bounds: Column) -> Column:
        steps = F.sequence(bounds["low"], bounds["high"])
        whole = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
        return F.aggregate(
            steps, F.struct(F.lit(1.0).alias("w"), (u * whole).alias("left"), bounds["low"].alias("at")),
            lambda s, x: F.struct(
                (s["w"] * ratio(x)).alias("w"), (s["left"] - s["w"]).alias("left"),
                F.when(s["left"] > s["w"], F.least(x + 1, bounds["high"])).otherwise(s["at"]).alias("at")),
            lambda s: s["at"])

    return _let(F.struct(low.alias("low"), high.alias("high")), found)


def _row(drawn: Column, room: Column, key: Column, shards: int) -> Column:
    """One matrix row: ``drawn`` rows over shards with ``room`` (array), one hypergeometric draw after the other."""
    pool = F.aggregate(room, F.lit(0).cast("long"), lambda s, x: s + x)
    start = F.struct(pool.alias("pool"), drawn.cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, shard: Column) -> Column:
        here = F.get(room, shard)
        draw = F.when(shard == shards - 1, s["left"]).otherwise(
            hypergeometric(s["left"], here, s["pool"], uniform(F.lit(SEED), key, shard)))
        return _let(draw, lambda d: F.struct(
            (s["pool"] - here).alias("pool"), (s["left"] - d).alias("left"), F.concat(s["out"], F.array(d)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step, lambda s: s["out"])


def matrix(sizes: Column, room: Column, level: int, shards: int) -> Column:
    """Rows of the matrix for ``sizes`` (array of key, n), whose n add up to the ``room`` of the shards."""
    start = F.struct(room.alias("room"), F.array().cast("array<array<bigint>>").alias("out"))

    def step(s: Column, part: Column) -> Column:
        return _let(_row(part["n"], s["room"], F.xxhash64(F.lit(level), part["key"]), shards), lambda row: F.struct(
            F.zip_with(s["room"], row, lambda a, b: a - b).alias("room"), F.concat(s["out"], F.array(row)).alias("out")))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def communication_matrix(sizes: DataFrame, shards: int, per_group: int = PER_GROUP) -> DataFrame:
    """``part, upto`` from ``part, n``: running sums of how many rows a partition sends to each shard."""
    grouped = sizes.groupBy(F.floor(F.col("part") / per_group).alias("grp")).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("part").alias("key"), "n"))).alias("parts"))
    # one row per group: GROUPS of them, each with PER_GROUP numbers
    whole = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col("grp").alias("key"), "n"))).alias("groups"), F.sum("n").alias("n"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"n div {shards}") + F.when(s < F.col("n") % shards, 1).otherwise(0))
    dealt = whole.where(F.col("n") > 0).select(F.explode(F.arrays_zip(
        F.col("groups").alias("g"), matrix(F.col("groups"), room, 0, shards).alias("row"))).alias("x")).select(F.col("x.g.key").alias("grp"), F.col("x.row").alias("room"))
    rows = grouped.join(F.broadcast(dealt), "grp").select(F.explode(F.arrays_zip(
        F.col("parts").alias("p"), matrix(F.col("parts"), F.col("room"), 1, shards).alias("row"))).alias("x"))
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(
        F.filter(F.col("row"), lambda _, at: at < i), F.lit(0).cast("long"), lambda s, v: s + v))
    return rows.select(F.col("x.p.key").alias("part"), F.col("x.row").alias("row")).select("part", upto.alias("upto"))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text",
                        groups: int = GROUPS, per_group: int = PER_GROUP) -> DataFrame:
    """``id, size, text_crc32, shard, slot``. Size is the number of bytes of the text plus 1."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    parts = groups * per_group
    placed = materialize(docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"),
        F.monotonically_increasing_id().alias("place")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "place"), F.lit(parts)).cast("int"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    cuts = materialize(communication_matrix(sizes, shards, per_group))
    # permute locally and cut by the matrix row
    local = W.partitionBy("part").orderBy(F.xxhash64(F.lit(SEED + 1), "place"), "place")
    sent = placed.withColumn("pos", F.row_number().over(local) - 1).join(F.broadcast(cuts), "part")
    again = F.xxhash64(F.lit(SEED + 2), "place")
    runs = max(1, parts // shards)  # each shard is permuted in runs of its random order
    sent = materialize(sent.select(
        "id", "size", "crc", "place", F.size(F.filter("upto", lambda c: c <= F.col("pos"))).alias("shard"),
        F.floor(uniform(F.lit(SEED + 3), F.col("place")) * runs).cast("int").alias("run"), again.alias("key")))
    counts = sent.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "run").orderBy("key", "place")
    slots = sent.withColumn("pos", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "run"])
    return slots.select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("pos")).cast("long").alias("slot"))
