"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of their upper or of their lower half.
Each half is covered by anchors: the words of the perfect Hamming code of 31 bits, with the last bit of the half free.
The covering radius is 1 (every 31-bit word is within one bit of exactly one code word) and the threshold of a half is 1,
so a fingerprint is copied to every anchor within distance 2 of its half: about 17. Two fingerprints that are close in a
half always meet at the anchor of either of them, and are compared there over all 64 bits.

Copies are no problem: only distinct fingerprints take part. An anchor with many distinct fingerprints is cut into blocks
which are compared two by two, each pair of blocks in its own task; a task passes on a spanning forest of what it found
(not all pairs), which keeps every connection.

Rules: a null text counts as empty; a text without words has fingerprint zero, which links like any other; a null id is
an id of its own kind that never becomes the smallest unless all ids of its component are null; repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.components import smallest_reachable
from riskflow.llm.tables import slices
from riskflow.session import materialize

SEED = 42
MOST_BITS = 3
#: Distinct fingerprints of one anchor that one task compares with each other.
BLOCK = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if it is 1 in over half of the hashes of all shingles, repeats included. bytes.split() takes exactly
    the white space x09-x0D and x20."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1)[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` (a signed 64-bit integer with the fingerprint's bits) and the whole text's hash, ``text_hash``."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    source = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = np.array([simhash(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), part.column(2)], names=["id", "fp", "text_hash"])

    return source.mapInArrow(run, "id long, fp long, text_hash long")


def _syndromes() -> np.ndarray:
    """For 16-bit parts of a 31-bit word: the exclusive or of the positions (1 to 31) of its set bits."""
    values = np.arange(1 << 16, dtype=np.uint32)
    low, high = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
    for bit in range(16):
        on = (values >> np.uint32(bit)) & np.uint32(1)
        low ^= on * np.uint32(bit + 1)
        high ^= on * np.uint32(bit + 17)
    return np.stack([low, high])


def anchors(half: np.ndarray, syndromes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and anchors (32-bit words) within covering radius 1 plus threshold 1 of each 32-bit half."""
    word, free = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    s = syndromes[0][word & np.uint32(0xFFFF)] ^ syndromes[1][word >> np.uint32(16)]
    row = np.arange(len(half))
    flip = lambda position: np.where(position > 0, np.uint32(1) << (position - np.uint32(1)).clip(0, 31), np.uint32(0)).astype(np.uint32)
    home = word ^ flip(s)
    rows, found = [row, row], [home | free, home | (free ^ np.uint32(0x80000000))]  # the second is one step off in the free bit
    for position in range(1, 32):  # code words of all words that are one step off
        p = np.uint32(position)
        other = word ^ flip(np.full_like(s, p)) ^ flip(s ^ p)
        fresh = (other != home) & (p < (s ^ p))  # flips p and s^p lead to the same code word
        rows.append(row[fresh])
        found.append((other | free)[fresh])
    return np.concatenate(rows), np.concatenate(found)


def close_pairs(distinct: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the links between distinct fingerprints (column fp)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        syndromes = _syndromes()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for side, shift in ((0, 32), (1, 0)):
                half = ((whole >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows, at = anchors(half, syndromes)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) * 2 + side), pa.array(whole[rows].view(np.int64))], names=["anchor", "fp"])

    copies = materialize(distinct.mapInArrow(spread, "anchor long, fp long"))
    sizes = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    blocks = F.floor((F.col("n") + F.lit(BLOCK - 1)) / F.lit(BLOCK)).cast("int")
    # a fingerprint of block i goes to the tasks (i, j) and (j, i) of all blocks j
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = (
        copies.join(sizes.select("anchor", blocks.alias("blocks")), "anchor").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    together = placed.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return together.mapInArrow(_compare_runs, "a long, b long").distinct()


def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, i, j); each run of equal keys is compared. A run that goes over the end of a batch waits."""
    waiting: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        rows = np.concatenate([*waiting, rows])
        last = int(np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(1))[0])
        yield from _forest(rows[:last])
        waiting = [rows[last:]]
    if waiting:
        yield from _forest(waiting[0])


def _forest(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(rows) < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1))))
    stops = np.append(starts[1:], len(rows))
    fp, left, right = rows[:, 3].view(np.uint64), [], []
    two = starts[stops - starts == 2]  # most runs: compared all at once
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= MOST_BITS
    left.append(fp[two][near])
    right.append(fp[two + 1][near])
    for start, stop in zip(starts, stops):
        if stop - start > 2:
            a, b = _spanning(np.unique(fp[start:stop]))
            left.append(a)
            right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _spanning(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with the root of its component in this run; every one is compared with all not yet reached."""
    member, root = [], []
    rest = fp
    while len(rest):
        start, rest, frontier = rest[0], rest[1:], [rest[0]]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= MOST_BITS
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                frontier.extend(reached)
                member.append(reached)
                root.append(np.full(len(reached), start))
    empty = np.array([], np.uint64)
    return np.concatenate([empty, *root]).astype(np.uint64), np.concatenate([empty, *member]).astype(np.uint64)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp, component_id``: the smallest id that can be reached over links of at most three differing bits."""
    classed = _classed(docs, id_column, text_column, shingle)
    return classed.select(F.col("id").alias(id_column), "fp", "component_id")


def _classed(docs: DataFrame, id_column: str, text_column: str, shingle: int = 3) -> DataFrame:
    found = materialize(fingerprints(docs, id_column, text_column, shingle))
    distinct = found.groupBy("fp").agg(F.min("id").alias("least"))
    roots = smallest_reachable(close_pairs(distinct.select("fp")))
    classes = materialize(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialize(classes.join(names, "root").select("fp", "root", "component_id"))
    return found.join(by_print, "fp")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id, of several with this id that with the smallest text hash
    (an id may be null; null comes last). All columns of ``docs`` are kept."""
    identity = [F.col(id_column).isNull().alias("_no_id"), F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("_id"),
                F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("_hash")]
    first = _classed(docs, id_column, text_column).groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("_no_id"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))).alias("k"))
    packed = docs.select(F.struct("*").alias("_row"), *identity)
    kept = packed.join(first.select("k.*"), ["_no_id", "_id", "_hash"], "left_semi")
    # repeated rows agree in id and text
    return kept.groupBy("_no_id", "_id", "_hash").agg(F.first("_row").alias("_row")).select("_row.*")
