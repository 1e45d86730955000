"""Measures of many numeric columns from one Arrow pass each.

A Spark aggregate over sixty columns with several measures each is evaluated expression by expression and row by row; here a
task turns its rows into matrices. What leaves a task does not grow with its rows (moments, counts of bins) or is a set of
values without repeats (distinct counts, values of chosen bins).

* ``moment_state``      count, mean, spread, skew and range of each column, products of all pairs, correlation with a label
* ``distinct_counts``   exact number of distinct values per column
* ``many_quantiles``    exact quantiles: bins are counted first, and only values of the bins that hold a quantile are sent
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.operators.ordered import lay_out, scan
from riskflow.session import materialize

STATE = "state array<double>"
#: Rows that a task holds before it sends their distinct values.
HELD_ROWS = 1 << 17
#: Leading bits of a value in its sortable form: sign, exponent and six bits of the fraction.
BIN_BITS = 18
BITS = np.uint64(64 - BIN_BITS)
TOP = np.uint64(1 << 63)


def _doubles(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate((*columns, *more))])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(columns x rows) values, 0 for NULL, and which of them are known."""
    known = np.stack([np.ones(len(c), bool) if not c.null_count else c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
    values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
    return values, known


# ---- moments --------------------------------------------------------------------------------------------------

def _centred(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, mean and the distances from it (0 where unknown). Values are taken from the column's least first, so a constant has none."""
    n = known.sum(1).astype(float)
    low = np.fmin.reduce(np.where(known, x, np.inf), axis=1, initial=np.inf)
    start = np.where(np.isfinite(low), low, 0.0)[:, None]
    away = np.where(known, x - start, 0.0)
    mean = np.divide(away.sum(1), n, out=np.zeros(len(n)), where=n > 0)[:, None]
    return n, (start + mean)[:, 0], np.where(known, away - mean, 0.0), low


def _sides(k: int) -> list[int]:
    """Sizes of the parts of a state of k columns: eight per column, then the products, then six per column beside the label, then the rows."""
    return [k] * 8 + [1, k, k * k] + [k] * 6 + [1]


def _empty(k: int) -> list[np.ndarray]:
    state = [np.zeros(s) for s in _sides(k)]
    state[4], state[5] = np.full(k, np.inf), np.full(k, -np.inf)
    return state


def _of_batch(x: np.ndarray, known: np.ndarray, labelled: bool, products: bool) -> list[np.ndarray]:
    y, y_known = (x[-1], known[-1]) if labelled else (None, None)
    if labelled:
        x, known = x[:-1], known[:-1]
    k = len(x)
    n, mean, d, low = _centred(x, known)
    squares = d * d
    high = np.maximum.reduce(np.where(known, x, -np.inf), axis=1, initial=-np.inf)
    binary = (known & (x == 0.0)).sum(1).astype(float), (known & (x == 1.0)).sum(1).astype(float)
    rows = np.array([float(x.shape[1])])
    state = [n, mean, squares.sum(1), (squares * d).sum(1), low, high, *binary]
    if products:
        # a row with a value that is no number takes no part in any pair
        whole = ~np.isnan(x).any(0)
        full = x[:, whole]
        pair_n, pair_mean, pair_d, _ = _centred(full, np.ones(full.shape, bool))
        state += [pair_n[:1], pair_mean, (pair_d @ pair_d.T).ravel()]
    else:
        state += [rows, np.zeros(k), np.zeros(k * k)]
    if labelled:
        both = known & y_known
        b_n, b_mean, b_d, _ = _centred(x, both)
        _, y_mean, y_d, _ = _centred(np.broadcast_to(y, x.shape), both)
        state += [b_n, b_mean, y_mean, (b_d * b_d).sum(1), (y_d * y_d).sum(1), (b_d * y_d).sum(1)]
    else:
        state += [np.zeros(k)] * 6
    return [*state, rows]


def _merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The moments of two sets of rows from those of each (pairwise update)."""
    def joined(n_a, mean_a, n_b, mean_b):
        n = n_a + n_b
        whole = np.where(n > 0, n, 1.0)
        gap = mean_b - mean_a
        return n, mean_a + gap * n_b / whole, gap, n_a * n_b / whole, whole
    n, mean, gap, weight, whole = joined(a[0], a[1], b[0], b[1])
    m2 = a[2] + b[2] + gap * gap * weight
    m3 = a[3] + b[3] + gap ** 3 * weight * (a[0] - b[0]) / whole + 3.0 * gap * (a[0] * b[2] - b[0] * a[2]) / whole
    rows, pair_mean, pair_gap, pair_weight, _ = joined(a[8], a[9], b[8], b[9])
    both, x_mean, x_gap, both_weight, _ = joined(a[11], a[12], b[11], b[12])
    _, y_mean, y_gap, _, _ = joined(a[11], a[13], b[11], b[13])
    return [n, mean, m2, m3, np.fmin(a[4], b[4]), np.maximum(a[5], b[5]), a[6] + b[6], a[7] + b[7],
            rows, pair_mean, a[10] + b[10] + np.outer(pair_gap, pair_gap).ravel() * pair_weight,
            both, x_mean, y_mean, a[14] + b[14] + x_gap ** 2 * both_weight, a[15] + b[15] + y_gap ** 2 * both_weight, a[16] + b[16] + x_gap * y_gap * both_weight,
            a[17] + b[17]]


def _parts(flat: np.ndarray, k: int) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(_sides(k))[:-1])


def moment_state(df: DataFrame, columns: Sequence[str], target: str | None = None, products: bool = False) -> DataFrame:
    """One row that holds the moments of ``columns``; ``moments_of``, ``pairs_of`` and ``target_of`` read it. One pass over ``df``;
    each task sends one row whose size depends on the number of columns only."""
    k, labelled = len(columns), target is not None

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = _empty(k)
        for batch in batches:
            if batch.num_rows:
                with np.errstate(all="ignore"):
                    state = _merge(state, _of_batch(*_matrix(batch), labelled, products))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(state)], pa.list_(pa.float64()))], names=["task", "state"])

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = (_parts(row, k) for batch in batches for row in batch.column(1).to_numpy(zero_copy_only=False))
        with np.errstate(all="ignore"):
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(reduce(_merge, states, _empty(k)))], pa.list_(pa.float64()))], names=["state"])

    wide = _doubles(df, columns, *([target] if labelled else []))
    # one row per task: a single task adds them, in the order of the tasks
    return wide.mapInArrow(of_task, f"task int, {STATE}").repartition(1).sortWithinPartitions("task").mapInArrow(of_all, STATE)


def _expand(state: DataFrame, columns: Sequence[str], schema: str, rows) -> DataFrame:
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat in batch.column(0).to_numpy(zero_copy_only=False):
                with np.errstate(all="ignore"):
                    yield pa.RecordBatch.from_pylist(rows(_parts(flat, k)), schema=arrow)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return state.mapInArrow(run, schema)


def moments_of(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, known values, mean, variance, population and sample deviation, skewness, least, largest, zeros and ones. Undefined is NULL."""
    names = list(columns)

    def table(s: list[np.ndarray]) -> list[dict]:
        out = []
        for i, name in enumerate(names):
            n, m2 = float(s[0][i]), float(s[2][i])
            known = n > 0
            out.append({
                "feature_name": name, "rows": int(s[17][0]), "known": int(n), "mean": float(s[1][i]) if known else None, "variance": m2 / (n - 1) if n > 1 else None,
                "std": (m2 / (n - 1)) ** 0.5 if n > 1 else None, "std_population": (m2 / n) ** 0.5 if known else None,
                "skewness": float(n ** 0.5 * s[3][i] / m2 ** 1.5) if known and m2 != 0 else None,
                "min": float(s[4][i]) if known else None, "max": float(s[5][i]) if known else None, "zeros": int(s[6][i]), "ones": int(s[7][i])})
        return out
    return _expand(state, columns, "feature_name string, rows long, known long, mean double, variance double, std double, std_population double, skewness double, "
                   "min double, max double, zeros long, ones long", table)


def pairs_of(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs of columns that are not constant; NULL counts as 0."""
    names = list(columns)

    def table(s: list[np.ndarray]) -> list[dict]:
        cov = s[10].reshape(len(names), len(names))
        size = np.sqrt(np.diag(cov))
        return [{"feature_a": names[i], "feature_b": names[j], "correlation": float(cov[i, j] / (size[i] * size[j]))}
                for i in range(len(names)) for j in range(i + 1, len(names)) if size[i] > 0 and size[j] > 0]
    return _expand(state, columns, "feature_a string, feature_b string, correlation double", table).where(~F.isnan("correlation"))


def target_of(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute correlation of each column with the label over the rows that hold both; NULL if either is constant there."""
    names = list(columns)

    def table(s: list[np.ndarray]) -> list[dict]:
        spread = np.sqrt(s[14]) * np.sqrt(s[15])
        return [{"feature_name": n, "correlation_with_target": abs(float(s[16][i] / spread[i])) if spread[i] != 0 else None} for i, n in enumerate(names)]
    return _expand(state, columns, "feature_name string, correlation_with_target double", table)


# ---- distinct values and quantiles ----------------------------------------------------------------------------

def _keys(column: pa.Array) -> np.ndarray:
    """Known values as unsigned numbers in the order of the values; NaN is the largest and 0 has no sign."""
    values = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
    values = np.where(np.isnan(values), np.nan, values)
    bits = values.view(np.uint64)
    return np.where(bits >= TOP, ~bits, bits | TOP)


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= TOP, keys & ~TOP, ~keys).view(np.float64)


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task, several at a time."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, i: int) -> pa.Array:
    chunks = table.column(i).combine_chunks()
    return chunks if isinstance(chunks, pa.Array) else pa.concat_arrays(chunks.chunks)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_name, cardinality): exact, NULL left out. Tasks send their distinct values as sorted blocks, dealt by a hash of the value,
    so each value is counted in one place and no place has more than its share."""
    names = list(columns)
    parts = 1 << max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, HELD_ROWS):
            for i in range(len(names)):
                found = np.unique(_keys(_column(table, i)))
                part = ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                at, starts = np.unique(part[order], return_index=True)
                cut = np.split(found[order], starts[1:])
                packed = [pa.compress(np.diff(c, prepend=np.uint64(0)).tobytes(), "zstd", asbytes=True) for c in cut] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()),
                                                  pa.array([len(c) for c in cut[:len(at)]], pa.int32()), pa.array(packed, pa.binary())], names=["i", "part", "n", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(names), np.int64)
        run, held = None, []
        for batch in batches:
            for i, part, n, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (i, part) != run:
                    if held:
                        found[run[0]] += len(np.unique(np.concatenate(held)))
                    run, held = (i, part), []
                held.append(np.cumsum(np.frombuffer(pa.decompress(block, n * 8, "zstd"), np.uint64), dtype=np.uint64))
        if held:
            found[run[0]] += len(np.unique(np.concatenate(held)))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int64())], names=["feature_name", "n"])

    dealt = _doubles(df, names).mapInArrow(blocks, "i int, part int, n int, block binary").repartition("i", "part").sortWithinPartitions("i", "part")
    return dealt.mapInArrow(count, "feature_name string, n long").groupBy("feature_name").agg(F.sum("n").alias("cardinality"))


def _counted(df: DataFrame, columns: Sequence[str], chosen: dict[int, np.ndarray] | None) -> DataFrame:
    """(i, key, n): rows per bin of column ``i``, or rows per value of the ``chosen`` bins."""
    count = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, HELD_ROWS):
            for i in range(count):
                keys = _keys(_column(table, i))
                if chosen is None:
                    keys = keys >> BITS
                else:
                    keys = keys[np.isin(keys >> BITS, chosen[i])] if i in chosen else keys[:0]
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i), pa.int32()), pa.array((found ^ TOP).view(np.int64) if chosen is not None else found.view(np.int64)),
                                                  pa.array(_values(found) if chosen is not None else np.zeros(len(found))), pa.array(n, pa.int64())], names=["i", "key", "value", "n"])

    sent = _doubles(df, columns).mapInArrow(run, "i int, key long, value double, n long")
    return sent.groupBy("i", "key", "value").agg(F.sum("n").alias("_n"))


def many_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], chunks: int | None = None) -> DataFrame:
    """(column_name, p, quantile) as ``ordered.exact_quantiles``, for many columns. ``df`` is read twice, and neither pass shuffles all of
    its values: the first counts bins, at most 2^BIN_BITS a column, the second sends values of the few bins that hold a quantile."""
    bins = materialize(_counted(df, columns, None))
    before = W.partitionBy("i").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    placed = bins.select("i", "key", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    sizes = bins.groupBy("i").agg(F.sum("_n").alias("_rows"))
    targets = sizes.select("i", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"), ((F.col("_rows") - 1).cast("double") * F.col("p")).alias("_at"))
    targets = materialize(targets.select("*", F.floor("_at").alias("_lo"), F.ceil("_at").alias("_hi")))
    upto = F.col("_below") + F.col("_n")
    covers = ((F.col("_lo") >= F.col("_below")) & (F.col("_lo") < upto)) | ((F.col("_hi") >= F.col("_below")) & (F.col("_hi") < upto))
    # at most two bins per column and probability
    held = placed.join(F.broadcast(targets), "i").where(covers).select("i", "key", "_n", "_below").distinct().orderBy("i", "key").collect()
    chosen, left_out, kept = {}, [], {}
    for row in held:
        chosen.setdefault(row["i"], []).append(row["key"])
        # rows of the column below this bin that the second pass does not send
        left_out.append((row["i"], row["key"], row["_below"] - kept.get(row["i"], 0)))
        kept[row["i"]] = kept.get(row["i"], 0) + row["_n"]
    schema = "i int, bin long, _skipped long"
    skipped = df.sparkSession.createDataFrame(left_out, schema)
    counts = _counted(df, columns, {i: np.array(keys, np.uint64) for i, keys in chosen.items()})
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column_name string")
    laid = lay_out(counts, ["i", "key"], chunks)
    found = scan(laid, ["key"], [(["i"], {"_sent": ("sum", F.col("_n"))})])
    # the key of a value was made signed: its first bits, unsigned, are the bin
    of_bin = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - BIN_BITS)
    below = F.coalesce("_sent", F.lit(0)) + F.col("_skipped")
    exact = found.withColumn("bin", of_bin).join(F.broadcast(skipped), ["i", "bin"]).select("i", "value", below.alias("below"), (below + F.col("_n")).alias("upto"))
    reached = ((F.col("_lo") >= F.col("below")) & (F.col("_lo") < F.col("upto"))) | ((F.col("_hi") >= F.col("below")) & (F.col("_hi") < F.col("upto")))
    part = F.col("_at") - F.col("_lo")
    near = exact.join(F.broadcast(targets), "i").where(reached).groupBy("i", "p").agg(
        (F.min("value") * (F.lit(1.0) - F.first(part)) + F.max("value") * F.first(part)).alias("quantile"))
    return near.join(F.broadcast(names), "i").select("column_name", "p", "quantile")
