"""Document fingerprints by winnowing, with DataFrame functions only.

A text's words are hashed, every run of K words gets a rolling (cyclic polynomial) hash, and of each window of WINDOW such
hashes the smallest is kept, the rightmost one if several are smallest, with its position. Two texts that share a run of
K + WINDOW - 1 words therefore share a fingerprint. The smallest of all windows comes from doubling: minima of 2, 4, 8
and 16 neighbours, each from the one before.

Rules: a null text counts as empty; a text without words has no fingerprint, one with fewer words than K has one hash of
all of them; two empty fingerprints are alike to degree 1; repeated rows are neighbours of each other; null ids come first
in the order and equal ids are ordered by text hash; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm.tables import parallelism

K = 5
DOUBLINGS = 4
WINDOW = 1 << DOUBLINGS
#: Bits of a packed (hash, position) that hold the position; later positions only repeat in the order of ties.
POSITION_BITS = 25
#: Chunks of the id order for each task of a shuffle.
CHUNKS_PER_TASK = 4


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _rolled(state: Column, new: Column) -> Column:
    return F.shiftleft(state, 1).bitwiseOR(F.shiftrightunsigned(state, 63)).bitwiseXOR(new)


def _runs(words: Column) -> Column:
    """Hash of each run of K words; of all words if there are fewer."""
    def run(h: Column) -> Column:
        rolled = h
        for step in range(1, K):
            rolled = F.zip_with(rolled, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), _rolled)
        short = F.filter(F.array(F.aggregate(h, F.lit(0).cast("long"), _rolled)), lambda _: F.size(h) > 0)
        return F.when(F.size(h) >= K, F.slice(rolled, 1, F.greatest(F.size(h) - (K - 1), F.lit(1)))).otherwise(short)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), run)


def _with_later(minima: Column, step: int) -> Column:
    """Each value or the one ``step`` places on, whichever is smaller."""
    return _let(minima, lambda m: F.zip_with(m, F.slice(m, step + 1, F.greatest(F.size(m), F.lit(1))), lambda a, b: F.least(a, b)))


def _winnowed(hashes: Column) -> Column:
    mask = (1 << POSITION_BITS) - 1

    def pick(keys: Column) -> Column:
        least = keys
        for doubling in range(DOUBLINGS):  # the tail is null where a window would go over the end; least() skips nulls
            least = _with_later(least, 1 << doubling)
        windows = F.slice(least, 1, F.greatest(F.size(keys) - (WINDOW - 1), F.lit(1)))
        return _let(windows, lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1))))

    def kept(h: Column) -> Column:
        # later positions have smaller low bits, so the rightmost of equal hashes is the smallest
        keys = F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(
            F.lit(mask).cast("long") - i.cast("long").bitwiseAND(F.lit(mask).cast("long"))))
        at = lambda x: (F.lit(mask).cast("long") - x.bitwiseAND(F.lit(mask).cast("long"))).cast("int")
        return F.transform(_let(keys, pick), lambda x: F.struct(F.get(h, at(x)).alias("hash"), at(x).alias("pos")))

    return _let(hashes, kept)


def fingerprint(text: Column) -> Column:
    """array of (hash, pos): pos is the number of the run's first word, from 0."""
    return _winnowed(_runs(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))


def printed(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda p: F.concat_ws(":", F.lower(F.hex(p["hash"])), p["pos"].cast("string"))), " ")


def hashes_of(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of hashes."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        _let(shared.cast("double"), lambda s: s / F.greatest(F.size(a) + F.size(b) - s, F.lit(1.0))))


def with_next_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, text, next_text, _chunk, _key, _ghost``: every text with that of the next id, the last with the first. The
    order is cut into chunks of even size by exact bounds; each chunk gets the first row of the next one as a ghost row,
    so one shuffle of the texts is enough and no task sees the whole order. Ghosts are still in the result."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    number = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # noqa: E731  sorts as the number does
    identity = F.col(id_column).cast("long")
    key = F.concat(F.coalesce(number(identity), F.lit("")), F.lit("-"), number(F.xxhash64(text)))
    rows = docs.select(identity.alias("id"), text.alias("text"), key.alias("_key"))
    chunks = CHUNKS_PER_TASK * parallelism(docs.sparkSession)
    # as many bounds as chunks, which the settings fix
    found = rows.select("_key").repartitionByRange(chunks, "_key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("_key").alias("first")).collect()
    bounds = sorted(r["first"] for r in found) or [""]
    known = F.split(F.lit(",".join(bounds)), ",")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(F.get(known, middle) <= F.col("_key"), F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    search = F.aggregate(F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1)) + 1)),
                         F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda s: s["low"])
    rows = rows.withColumn("_chunk", search).withColumn("_ghost", F.lit(False))
    ghosts = (
        rows.where(F.get(known, F.col("_chunk")) == F.col("_key")).groupBy("_chunk").agg(F.first("text").alias("text"))
        .select(F.lit(None).cast("long").alias("id"), "text", F.lit("~").alias("_key"),
                F.pmod(F.col("_chunk") - 1, F.lit(len(bounds))).alias("_chunk"), F.lit(True).alias("_ghost")))
    order = W.partitionBy("_chunk").orderBy("_key")
    return rows.unionByName(ghosts).withColumn("next_text", F.lead("text").over(order))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def compare_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_chars, edited_text, prints, edited_prints, near_edited, near_next``."""
    rows = with_next_text(docs, id_column, text_column)
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    # ghosts need the fingerprint of their text only
    rows = rows.select(
        "id", F.length("text").cast("long").alias("n_chars"), "_chunk", "_key", "_ghost", "edited_text",
        fingerprint(F.col("text")).alias("prints"), fingerprint(F.when(~F.col("_ghost"), F.col("edited_text")).otherwise("")).alias("edited_prints"))
    rows = rows.withColumn("own", hashes_of(F.col("prints")))
    rows = rows.withColumn("next", F.lead("own").over(W.partitionBy("_chunk").orderBy("_key"))).where(~F.col("_ghost"))
    return rows.select(
        F.col("id").alias(id_column), "n_chars", "edited_text", "prints", "edited_prints",
        likeness(F.col("own"), hashes_of(F.col("edited_prints"))).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
