import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskflow.llm import vector_codes as m
from riskflow.llm.entries import QUERIES


def plain(rows):
    """[(id, code, error, label_error, digest)] in Python integers, every distance in every round. ``rows``: (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [(i, v + [0] * (-width % 8), y) for i, v, y in kept if len(v) == width]
    step = len(kept[0][1]) // 8
    parts = [[v[p * step : (p + 1) * step] for p in range(8)] for _, v, _ in kept]
    books = [[row[p] for row in parts[:16]] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(book))

    for _ in range(6):
        for p in range(8):
            of = [nearest(row[p], books[p])[1] for row in parts]
            for e in range(len(books[p])):
                mine = [row[p] for row, at in zip(parts, of) if at == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out = []
    for (i, _, y), row in zip(kept, parts):
        best = [nearest(x, book) for x, book in zip(row, books)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), y))
    totals = Counter()
    for _, _, error, y in out:
        totals[y] += error
    return [(i, code, error, totals[y], digest) for i, code, error, y in out]


def key(row):
    return tuple((v is not None, v or 0) for v in row)


def check(spark, rows, kind="float"):
    table = spark.createDataFrame([(i, v, y, "x", "x", "x", "x") for i, v, y in rows], f"vec_id long, embedding array<{kind}>, label int, id string, v string, codes string, error string")
    got = [tuple(r) for r in m.codes_with_errors(table).collect()]
    top = 2**63 - 1
    want = [(i, c, e if e <= top else None, t if t <= top else None, d) for i, c, e, t, d in plain(rows)]
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_given(spark, sf):
    rows = duckdb.connect().execute(f"select vec_id, embedding, label from '{sf}/embeddings.parquet'").fetchall()
    assert sorted(tuple(r) for r in QUERIES["op13_vector_codes"](spark, sf).collect()) == sorted(plain(rows))


def test_bounds_save_scans_and_change_nothing(spark, sf):
    coded, history = m.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert coded.agg({"scanned": "avg"}).first()[0] < 0.7 * m.PARTS
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(0, 3_000, (400, 8, 4)) + 9_000 * rng.integers(0, 5, (400, 8, 1))).astype(np.int64)
    history, state = [np.ascontiguousarray(x[:16].transpose(1, 0, 2))], None
    for turn in range(7):
        state, squared, scanned = m.assign(x, state, history, m.net_displacements(history))
        every = np.stack([m.distances(x[:, p], history[-1][p]) for p in range(8)], 1)
        assert (state[0] == every.argmin(2)).all() and (squared == every.min(2)).all()
        # a bound less the net displacement is below the true distance to every other entry
        rest = every.astype(float)
        np.put_along_axis(rest, state[0][:, :, None].astype(int), np.inf, 2)
        net = m.net_displacements(history)
        lowered = state[1] - net[state[2].astype(int), np.arange(8)[None], state[0].astype(int)]
        assert (lowered <= np.sqrt(rest.min(2)) + 1e-6).all() and (turn == 0 or scanned < x.shape[0] * 8)
        means = [[x[state[0][:, p] == e, p].sum(0) // max(1, (state[0][:, p] == e).sum()) if (state[0][:, p] == e).any() else history[-1][p, e] for e in range(16)] for p in range(8)]
        history.append(np.array(means))


def test_net_displacement_is_tighter(spark):
    """Entries that come back leave nothing to add, where summed steps would."""
    a = np.zeros((8, 2, 1), np.int64)
    b = a + 100
    assert (m.net_displacements([a, b, a])[0] == 0).all() and (m.net_displacements([a, b])[0] == 100).all()


@pytest.mark.parametrize("length", [8, 11, 3])
def test_odd_rows(spark, length):
    """Nulls, other lengths, repeated and tied vectors, repeated and missing ids, hot labels, lengths that do not divide."""
    rng = np.random.default_rng(length)
    rows = [(int(i // 2), [float(np.float32(x)) for x in rng.normal(0, 1, length)], int(i % 3) if i % 4 else None) for i in range(60)]
    rows += [(5, [0.5] * length, 1)] * 30 + [(None, [0.25] * length, None), (None, [-0.75] * length, 2), (70, None, 1), (71, [None] * length, 1), (72, [], 1),
             (73, [float("nan")] * length, 1), (74, [float("inf")] + [0.0] * (length - 1), 1), (75, [1.0] * (length + 1), 1), (-9, [-0.0001] * length, 1)]
    check(spark, rows)


def test_few_and_none(spark):
    check(spark, [(3, [0.1 * i for i in range(8)], 1), (1, [0.2] * 8, 1)])
    assert check(spark, []) == []
    assert check(spark, [(1, None, 1), (2, [], 2)]) == []


def test_large_components(spark):
    rng = np.random.default_rng(2)
    big = [(i, [float(x) for x in rng.normal(0, 10.0 ** (4 + i % 3 * 5), 16)], i % 2) for i in range(40)]
    got = check(spark, big, "double")
    assert any(r[2] is None for r in got)
