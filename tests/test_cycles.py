"""Cycles over all transfers, up to five accounts, against a plain search."""

from riskflow.catalog.entries import QUERIES
from riskflow.operators import graph


def plain_cycles(edges, most=5):
    """Simple directed cycles of 2 to ``most`` nodes from their smallest node."""
    ahead, found = {}, []
    for a, b in edges:
        if a != b:
            ahead.setdefault(a, set()).add(b)

    def walk(path):
        for node in ahead.get(path[-1], ()):
            if node == path[0] and len(path) > 1:
                found.append(">".join(path))
            elif node > path[0] and node not in path and len(path) < most:
                walk([*path, node])

    for start in ahead:
        walk([start])
    return sorted(found)


def test_given_cycles(spark, sf):
    """Every listed cycle of the smallest tables, and the members found without listing."""
    from riskflow.catalog.model_entries import all_edges

    pairs = {(r["src"], r["dst"]) for r in graph.distinct_edges(all_edges(spark, sf)).collect()}
    want = plain_cycles(pairs)
    assert sorted(r["cycle_path"] for r in QUERIES["g2_cycles"](spark, sf).collect()) == want
    sets = {}
    for path in want:
        names = sorted(path.split(">"))
        sets[",".join(names), len(names)] = sets.get((",".join(names), len(names)), 0) + 1
    assert {(r["node_set"], r["length"]): r["directed_cycles"] for r in QUERIES["g2_node_set_cycles"](spark, sf).collect()} == sets
    members = [r["id"] for r in graph.cycle_members(all_edges(spark, sf)).collect()]
    assert sorted(members) == sorted({name for path in want for name in path.split(">")})


def test_members_are_those_of_listed_cycles(spark):
    """Random sparse graphs, where many accounts are on no cycle or on a long one only."""
    from random import Random

    for seed in range(3):
        rng = Random(seed)
        pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(80)} | {(f"r{k}", f"r{(k + 1) % (4 + seed)}") for k in range(4 + seed)}
        edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, amount double")
        for most in (2, 5):
            want = {name for path in plain_cycles(pairs, most) for name in path.split(">")}
            assert sorted(r["id"] for r in graph.cycle_members(edges, most).collect()) == sorted(want)


def ring(n):
    names = [f"N{k}" for k in range(n)]
    return [(f"r{k}", "2024-01-01 00:00:00", names[k], names[(k + 1) % n], 10, 0) for k in range(n)]


def test_find_cycles(make_tx):
    pairs = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "A"), ("C", "A"), ("E", "B"), ("B", "A"), ("D", "F"), ("F", "G"), ("G", "A"), ("A", "A")]
    tx = make_tx([(f"t{k}", "2024-01-01 00:00:00", a, b, 10, 0) for k, (a, b) in enumerate(pairs)])
    found = graph.find_cycles(graph.build_edges(tx)).collect()
    assert sorted(r["cycle_path"] for r in found) == plain_cycles(pairs)


def test_queries_list_five_accounts(spark, make_tx, monkeypatch):
    import riskflow.catalog.model_entries as entries

    rows = ring(5) + [("o1", "2024-01-01 00:00:00", "X", "Y", 20000, 0)]
    monkeypatch.setattr(entries, "transactions", lambda spark, sf, columns=None: make_tx(rows))
    pairs = [(r[2], r[3]) for r in rows]
    assert [r["cycle_path"] for r in QUERIES["g2_cycles"](spark, "").collect()] == plain_cycles(pairs) == ["N0>N1>N2>N3>N4"]
    assert [tuple(r) for r in QUERIES["g2_node_set_cycles"](spark, "").collect()] == [("N0,N1,N2,N3,N4", 5, 1)]
    levels = {r["transaction_id"]: r["cluster_risk_level"] for r in QUERIES["g4_ring_risk"](spark, "").collect()}
    assert levels == {**{f"r{k}": "CRITICAL" for k in range(5)}, "o1": "HIGH"}


def test_membership_groups_the_transfers_once(make_tx, monkeypatch):
    tx = make_tx([("T1", "2024-01-01 10:00:00", "A1", "A2", 1, 0), ("T2", "2024-01-01 10:00:00", "A2", "A1", 1, 0),
                  ("T3", "2024-01-01 10:00:00", "A2", "A3", 1, 0)])
    written = []
    plain = graph.materialize
    for name in ("materialize", "sized"):
        monkeypatch.setattr(graph, name, lambda df: written.append(df._jdf.queryExecution().toString()) or plain(df))
    found = graph.cycle_members(graph.build_edges(tx))
    assert sorted(r["id"] for r in found.collect()) == ["A1", "A2"]
    assert sum("ExistingRDD" in text or "LogicalRDD" in text for text in written) == 1


def test_the_longest_halves_are_not_written(make_tx, monkeypatch):
    """Half-walks of three steps are used once; no written or sent half holds an array of names."""
    tx = make_tx(ring(5))
    written, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(df) or plain(df))
    found = graph.find_cycles(graph.build_edges(tx))
    assert [r["cycle_path"] for r in found.collect()] == ["N0>N1>N2>N3>N4"]
    assert not any("p2" in df.columns for df in written)
    assert not any(kind.startswith("array") for df in written for _, kind in df.dtypes)


def test_longer_cycles_too(spark):
    pairs = [(f"n{i}", f"n{(i + k) % 9}") for i in range(9) for k in (1, 4)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, amount double")
    for most in (2, 3, 6, 7):
        assert sorted(r["cycle_path"] for r in graph.find_cycles(edges, most).collect()) == plain_cycles(pairs, most)
