import re

import numpy as np
import xxhash

from riskflow.llm import simhash
from riskflow.llm.components import smallest_reachable
from riskflow.llm.entries import QUERIES


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k : k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (id, fingerprint). Smallest id over links of three bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    fp = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(prints):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [(name, least.get(find(i))) for i, (name, _) in enumerate(prints)]


def test_query_on_the_given_table(spark, sf, given):
    rows = QUERIES["op10_simhash_near_dedup"](spark, sf).collect()
    prints = [(i, plain_print(t)) for i, t, _ in given]
    assert {(r["doc_id"], r["fingerprint"]) for r in rows} == {(i, f"{p:016x}") for i, p in prints}
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == sorted(plain_components(prints))


def test_all_close_pairs_meet(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    rows = [base]
    for flips in (1, 2, 3, 4):
        other = base.copy()
        for _ in range(flips):
            other ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        rows.append(other)
    prints = np.unique(np.concatenate(rows))
    table = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long")
    found = {(r["node"], r["root"]) for r in smallest_reachable(simhash.close_pairs(table)).collect()}
    groups = {}
    for node, root in found:
        groups.setdefault(root, set()).add(node)
    want = {}
    for i, c in plain_components([(int(a), int(b)) for a, b in zip(prints.view(np.int64), prints)]):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_hot_anchor_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    prints = [(i << 3) | j for i in range(64) for j in (0, 1)]  # one dense cluster
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    pairs = simhash.close_pairs(table)
    assert len({r["root"] for r in smallest_reachable(pairs).collect()}) == 1


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = dict(map(tuple, smallest_reachable(edges).collect()))
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_odd_rows(docs, odd_rows):
    found = simhash.near_duplicates(docs(odd_rows)).collect()
    prints = [(i, plain_print(t)) for i, t in odd_rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or 0)
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=key) == sorted(plain_components(prints), key=key)
    table = docs(odd_rows)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i)) == sorted({c for _, c in plain_components(prints)}, key=lambda i: (i is None, i))
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_one(docs([])).count() == 0
