"""Compression of vectors into codes of eight parts.

Components become integers, each vector is cut into ``PARTS`` equal parts, and each part is coded by its nearest entry in a codebook of
``ENTRIES`` entries, found in ``ROUNDS`` rounds of assignment and update, all in exact integers.

Norm-of-sum bounds save most distance computations. For each part of each vector the table keeps its entry, a lower
bound on the distance to every other entry, and the round at which the bound was computed. All codebooks since the start are kept, so
the bound is lowered by the true net displacement of the entries between its round and now (the largest over the other entries), not by the sum
of the steps, which is longer. While the exact distance to the own entry stays below it, the entry is still the
nearest and nothing else is computed; otherwise all entries are scanned again and the bound gets the new round's stamp.

A round is one pass: assignments and bounds are written (PARTS times six bytes a vector), sums and counts per entry are
added up by Spark. The codebooks (PARTS x ENTRIES x components) are all that the driver sees.

Rules for odd input: vectors that are null, empty or hold null or non-finite components are dropped; the first kept vector by
id fixes the number of components and vectors of another length are dropped (there is no common codebook for them); a length that is no
multiple of PARTS is filled up with zeros; ids may repeat or be null (null ids last, ties by the components); with fewer
than ENTRIES vectors the codebooks have as many entries; other columns are not read. Components beyond 64-bit arithmetic
are computed with Python's integers, those of 2^100 and more drop their vector; an error that does not fit a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import slices
from riskflow.session import materialize, sized

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
_MARGIN, _HUGE, _LONG = 1e-9, 2.0**100, 2**63 - 1


def usable(vectors: DataFrame, vector_column: str) -> DataFrame:
    """Rows whose vector is there and finite throughout."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _HUGE / SCALE)
    return vectors.where(F.col(vector_column).isNotNull() & (F.size(vector_column) > 0) & F.forall(vector_column, good))


def _integers(flat: np.ndarray, n: int, width: int) -> np.ndarray:
    """(vectors, PARTS, components of a part). 64-bit integers where every squared distance fits, Python's otherwise."""
    scaled = np.floor(flat.astype(np.float64) * SCALE).reshape(n, width)
    parts = -(-width // PARTS)
    if parts * PARTS != width:
        scaled = np.concatenate([scaled, np.zeros((n, parts * PARTS - width))], 1)
    small = n == 0 or np.abs(scaled).max() < 2.0**30 / math.sqrt(parts)
    whole = scaled.astype(np.int64) if small else np.array([int(x) for x in scaled.ravel()], object)
    return whole.reshape(n, PARTS, parts)


def first_codebooks(rows: DataFrame, width: int) -> np.ndarray:
    """(PARTS, entries, components): the parts of the vectors with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").collect()
    whole = _integers(np.array([x for (v,) in first for x in v]), len(first), width)
    return np.ascontiguousarray(whole.transpose(1, 0, 2))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared, of (n, components) to (entries, components)."""
    return ((x[:, None, :] - book[None]) ** 2).sum(2)


def net_displacements(history: list[np.ndarray]) -> np.ndarray:
    """(rounds so far, PARTS, entries): for each stamp and own entry the largest net displacement of the other entries up to now."""
    out = np.zeros((len(history), *history[-1].shape[:2]))
    for stamp, old in enumerate(history):
        moved = np.sqrt(((history[-1] - old) ** 2).sum(2).astype(np.float64))
        for entry in range(moved.shape[1]):
            others = np.delete(moved, entry, 1)
            out[stamp, :, entry] = others.max(1) if others.shape[1] else 0
    return out


def assign(x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, history: list[np.ndarray], net: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, int]:
    """Nearest entries of (n, PARTS, components) under the last codebook. ``state``: entries, bounds and stamps of the round
    before. Returns the new state, the squared distances and how many parts were scanned in full."""
    n, book, now = len(x), history[-1], len(history) - 1
    codes = np.zeros((n, PARTS), np.uint8) if state is None else state[0].copy()
    bounds = np.zeros((n, PARTS), np.float32) if state is None else state[1].copy()
    stamps = np.zeros((n, PARTS), np.uint8) if state is None else state[2].copy()
    squared = np.zeros((n, PARTS), x.dtype if n else np.int64)
    scanned = 0
    for p in range(PARTS):
        again = np.ones(n, bool)
        if state is not None:
            own = codes[:, p].astype(int)
            squared[:, p] = ((x[:, p] - book[p][own]) ** 2).sum(1)
            bound = bounds[:, p].astype(np.float64) - net[stamps[:, p].astype(int), p, own]
            again = ~(np.sqrt(squared[:, p].astype(np.float64)) * (1 + _MARGIN) + _MARGIN < bound)
        todo = np.flatnonzero(again)
        scanned += len(todo)
        for start in range(0, len(todo), 2_000):
            rows = todo[start : start + 2_000]
            every = distances(x[rows, p], book[p])
            # the first of equal ones: the lower index
            best = every.argmin(1) if every.dtype != object else np.array([row.tolist().index(min(row)) for row in every], int)
            squared[rows, p] = every[np.arange(len(rows)), best]
            rest = every.astype(np.float64)
            rest[np.arange(len(rows)), best] = np.inf
            codes[rows, p], stamps[rows, p] = best, now
            # rounded towards zero, so that single precision never raises a bound
            bounds[rows, p] = np.nextafter(np.minimum(np.sqrt(rest.min(1)) * (1 - _MARGIN), 3e38).astype(np.float32), np.float32(0))
    return (codes, bounds, stamps), squared, scanned


STATE = "row long, codes binary, bounds binary, stamps binary"


def _states(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    return tuple(np.frombuffer(b"".join(batch.column(at + k).to_pylist()), kind).reshape(n, PARTS) for k, kind in enumerate((np.uint8, np.float32, np.uint8)))


def _assigned(rows: DataFrame, width: int, history: list[np.ndarray], first: bool) -> DataFrame:
    """``rows`` with their new state and the error of each vector."""
    net = net_displacements(history)
    shared = rows.sparkSession.sparkContext.broadcast((history, net))
    names = ["id", "v", "label", "codes", "bounds", "stamps", "error", "scanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, net = shared.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n = batch.num_rows
            x = _integers(batch.column(1).flatten().to_numpy(zero_copy_only=False), n, width)
            (codes, bounds, stamps), squared, scanned = assign(x, None if first else _states(batch, 3), history, net)
            error = [e if e <= _LONG else None for e in (int(s) for s in (squared.sum(1) if n else []))]
            out = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes, bounds, stamps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *out, pa.array(error, pa.int64()), pa.array(np.full(n, scanned / max(n, 1)))], names=names)

    given = rows.select("id", "v", "label", *([] if first else ["codes", "bounds", "stamps"]))
    kind = rows.schema["v"].dataType.simpleString()
    label = rows.schema["label"].dataType.simpleString()
    return given.mapInArrow(run, f"id long, v {kind}, label {label}, codes binary, bounds binary, stamps binary, error long, scanned double")


def entry_sums(assigned: DataFrame, width: int) -> DataFrame:
    """``at, n, total``: sums of the integer components per place in the codebooks, added up in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, np.zeros((PARTS, ENTRIES), np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            n = batch.num_rows
            x = _integers(batch.column(0).flatten().to_numpy(zero_copy_only=False), n, width)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, PARTS)
            if sums is None:
                sums = np.zeros((PARTS, ENTRIES, x.shape[2]), object)
            for p in range(PARTS):
                part = np.zeros((ENTRIES, x.shape[2]), x.dtype)
                np.add.at(part, codes[:, p].astype(int), x[:, p])
                sums[p] += part.astype(object)
                counts[p] += np.bincount(codes[:, p], minlength=ENTRIES)
        if sums is not None:
            n = np.repeat(counts.ravel(), sums.shape[2])
            used = np.flatnonzero(n)
            values = pa.array([str(int(s)) for s in sums.ravel()[used]])
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), values], names=["at", "n", "total"])

    partial = assigned.select("v", "codes").mapInArrow(run, "at long, n long, total string")
    return partial.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def update(book: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries become the floors of their means; unused ones stay."""
    new = np.array(book, dtype=object, order="C")
    flat = new.reshape(PARTS, -1)
    width = book.shape[2]
    for at, n, total in sums.collect():  # one row per component of a codebook
        part, rest = divmod(at, ENTRIES * width)
        flat[part, rest] = int(total) // n
    fits = all(abs(int(v)) < 2**30 / math.sqrt(width) for v in flat.ravel())
    return new.astype(np.int64) if fits else new


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``id, label, codes, error`` of every usable vector and the codebooks of all rounds."""
    kept = usable(vectors, vector_column).select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"), F.col(label_column).alias("label"))
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(1).select(F.size("v")).first()
    width = first[0] if first else 0
    rows = kept.where(F.size("v") == width)
    if not width:
        return rows.select("id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(0).cast("long").alias("error")), [np.zeros((PARTS, 0, 0), np.int64)]
    history = [first_codebooks(rows, width)]
    state = rows
    for turn in range(rounds + 1):
        state = materialize(_assigned(state, width, history, turn == 0))
        if turn < rounds:
            history.append(update(history[-1], entry_sums(state, width)))
    return state.select("id", "label", "codes", "error", "scanned"), history


def books_text(book: np.ndarray) -> str:
    return ",".join(str(int(v)) for v in book.ravel())


def codes_with_errors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256``; errors are also added up over equal labels, nulls together."""
    coded, history = compress(vectors, id_column, vector_column, label_column)
    digest = hashlib.sha256(books_text(history[-1]).encode()).hexdigest()
    keyed = coded.select("id", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), "codes", "error")
    # labels may be as many as rows: a written table, which Spark broadcasts only if it is small; a hot label stands once in it
    totals = sized(keyed.groupBy("no_label", "label").agg(
        F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")))
    code = F.lower(F.hex("codes"))
    fits = F.when(F.col("label_error") <= F.lit(_LONG), F.col("label_error")).cast("long")
    return keyed.join(totals, ["no_label", "label"]).select(
        F.col("id").alias(id_column), code.alias("code"), "error", fits.alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The same rounds as plain SQL over (vector, part): lists of integers, every distance anew."""
    def nearest(turn: int) -> str:
        return f"""a{turn} AS (
    SELECT r, p, x, e, d FROM (
        SELECT r, parts.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
               row_number() OVER (PARTITION BY r, parts.p ORDER BY d, e) AS k
        FROM parts JOIN b{turn} ON parts.p = b{turn}.p) WHERE k = 1)"""

    def means(turn: int) -> str:
        return f"""s{turn} AS (
    SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{turn}) GROUP BY p, e, i),
m{turn} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{turn} GROUP BY p, e),
b{turn + 1} AS (SELECT b{turn}.p, b{turn}.e, coalesce(m{turn}.c, b{turn}.c) AS c FROM b{turn} LEFT JOIN m{turn} ON b{turn}.p = m{turn}.p AND b{turn}.e = m{turn}.e)"""

    steps = [step for turn in range(ROUNDS) for step in (nearest(turn), means(turn))] + [nearest(ROUNDS)]
    return f"""WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS t(p)),
b0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
{", ".join(steps)},
coded AS (
    SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), digest"""


CODES_SQL = _codes_sql()
