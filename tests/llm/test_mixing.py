import re
from collections import Counter, defaultdict

import pytest
from check_oracle import compare, database

from riskflow.llm import mixing
from riskflow.llm.entries import ORACLES, QUERIES


def plain_targets(sizes):
    """Sources stop at twice their size; the excess goes round by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, stopped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        share = {s: (left - sum(2 * sizes[x] for x in stopped)) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            target.update(share, **{})
            target.update({s: 2 * sizes[s] for s in stopped})
            return target
        stopped |= above


def test_query_matches_sql(spark, sf):
    assert compare(QUERIES["op3_mix_sources"](spark, sf), database(sf), ORACLES["op3_mix_sources"]).startswith("ok")


@pytest.fixture
def rows():
    texts = {None: ["w " * n for n in (3, 0, 40)], "a": ["w " * n for n in range(1, 30)], "b": ["x y"] * 6, "é": ["q\x0bq\x1cq z"] * 3, "z": [None, ""], "B": ["v " * 500]}
    return [(i, t, s) for i, (t, s) in enumerate((t, s) for s, ts in texts.items() for t in ts)]


def test_targets_and_sums(docs, rows):
    found = mixing.taken_words(docs(rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = plain_targets(sizes), defaultdict(int)
    assert {(r["doc_id"], r["size"]) for r in found} == {(i, size(t)) for i, t, _ in rows}
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-9
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)


def test_reruns_and_layouts_agree(docs, rows):
    first = sorted(map(tuple, mixing.taken_words(docs(rows)).collect()))
    assert first == sorted(map(tuple, mixing.taken_words(docs(rows[::-1]).repartition(7)).collect()))


def test_mix_gives_the_taken_words(docs, rows):
    table = docs(rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(table).collect()}
    given = defaultdict(int)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    for r in mixed.collect():
        given[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        whole = next(t for i, t, _ in rows if i == r["doc_id"])
        assert whole.startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert dict(given) == {i: n for i, n in taken.items() if n}


def test_odd_rows(docs, odd_rows):
    found = mixing.taken_words(docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    assert mixing.mix(docs(odd_rows)).where("doc_id = 5").count() >= 2  # both of the repeated rows have their turn
    assert mixing.taken_words(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    assert mixing.taken_words(docs([(1, None), (2, "")])).select("taken").distinct().collect()[0][0] == 0
