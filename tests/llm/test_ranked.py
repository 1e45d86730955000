import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskflow.llm import ranked
from riskflow.llm.entries import QUERIES


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, queries, k=10):
    """[(item, rank, doc, score)] with every document scored for every query."""
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    found = [f for f in found if f[2]]
    n_docs, n_terms = len(found), sum(f[2] for f in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in found:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return out


def key(row):
    return tuple((v is not None, v or 0) for v in row)


def test_given(spark, sf, given):
    queries = duckdb.connect().execute(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    got = [tuple(r) for r in QUERIES["op12_ranked_search"](spark, sf).collect()]
    assert sorted(got) == sorted(plain([(i, t) for i, t, _ in given], queries))


@pytest.mark.parametrize("most_terms", [1, 40, 8_192])
def test_odd_rows(spark, docs, odd_rows, most_terms):
    """Ties, repeats, nulls, very long texts; queries in one and in many blocks; columns named like the operator's own."""
    queries = [(1, "Same WORDS here, same"), (1, "Same WORDS here, same"), (2, None), (3, ""), (4, "nowhere"), (None, "one id and α ω"), (5, "alpha1 beta4 x" + "x" * 49_999)]
    asked = spark.createDataFrame([(i, t, "z", "z") for i, t in queries], "item_id long, text string, number string, query string")
    got = [tuple(r) for r in ranked.search(docs(odd_rows, extra=("id", "tie", "n", "terms", "counts", "score", "rank")), asked, most_terms=most_terms).collect()]
    assert sorted(got, key=key) == sorted(plain(odd_rows, queries), key=key)


def test_empty(spark, docs):
    asked = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert ranked.search(docs([]), asked).collect() == []
    assert ranked.search(docs([(1, "words")]), asked.limit(0)).collect() == []


def test_small_segments(spark, sf, given, monkeypatch):
    """Thresholds carried from segment to segment lose nothing."""
    monkeypatch.setattr(ranked, "MOST_CELLS", 1)
    queries = duckdb.connect().execute(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    vocabulary = [(n, i, sorted({t.encode() for t in terms(text)})) for n, (i, text) in enumerate(queries)]
    found = ranked.search_block(docs, vocabulary, 10, "doc_id", "text", most_cells=1).collect()
    best = {}
    for r in found:
        best.setdefault(vocabulary[r["number"]][1], []).append((-r["score"], r["id"]))
    got = [(item, rank, i, -s) for item, rows in best.items() for rank, (s, i) in enumerate(sorted(rows)[:10], 1)]
    assert sorted(got) == sorted(plain([(i, t) for i, t, _ in given], queries))


def test_blocks_are_skipped_by_exact_bounds():
    """Documents of two topics: blocks of the other topic are never read, and the best ten are the same as by scoring all."""
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 2, 1_500)
    impacts = np.zeros((1_500, 60), np.int32)
    impacts[:, 0] = rng.integers(1, 900_000, 1_500)  # in every document
    for d, t in enumerate(topic):
        impacts[d, 1 + 30 * t + rng.permutation(29)[:12]] = rng.integers(1, 900_000, 12)
    weights = np.full(60, 2_000, np.int64)
    weights[0] = 3_000
    segment, seen = ranked.Segment(impacts, weights), [0, 0]
    asked = np.array([0, 1, 2, 3, 4, 5, 6])
    rows, scores = segment.search(asked, weights, 10, 1, seen)
    every = impacts[:, asked].astype(np.int64) @ weights[asked]
    want = np.sort(every)[::-1][:10]
    assert sorted(scores, reverse=True)[:10] == want.tolist() and (every[rows] == scores).all()
    assert seen[0] < 0.6 * seen[1]
    for term in asked:  # summaries hold exactly the largest impacts of their blocks, and blocks the whole list
        blocks, summaries = segment.list_of(int(term))
        assert sorted(np.concatenate(blocks)) == np.flatnonzero(impacts[:, term]).tolist()
        assert all((impacts[b].max(0) == s).all() for b, s in zip(blocks, summaries))
