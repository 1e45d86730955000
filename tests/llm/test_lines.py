import random
from collections import Counter

import pytest
from check_oracle import compare, database
from pyspark.sql import functions as F

from riskflow.llm import lines
from riskflow.llm.entries import ORACLES, QUERIES


def plain(rows):
    """(id, text) in order of ids: what is left of each text."""
    count, first = Counter(), {}
    for i, text in rows:
        split = (text or "").split("\n")
        for start, n in lines.chunks(split):
            if n >= 2:
                chunk = "\n".join(split[start : start + n])
                count[chunk] += 1
                first.setdefault(chunk, (i, start))
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        gone = {line for start, n in lines.chunks(split) if n >= 2 and count[c := "\n".join(split[start : start + n])] > 1 and first[c] != (i, start) for line in range(start, start + n)}
        out.append((i, "\n".join(line for k, line in enumerate(split) if k not in gone), len(gone)))
    return out


def test_query_matches_sql(spark, sf):
    assert compare(QUERIES["op6_line_dedup"](spark, sf), database(sf), ORACLES["op6_line_dedup"]).startswith("ok")


def test_query_on_the_given_table(spark, sf, given):
    rows = QUERIES["op6_line_dedup"](spark, sf).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines_removed"]) for r in rows) == plain([(i, t) for i, t, _ in given])
    assert all(r["copied_from"] for r in rows if r["n_lines_removed"])


def test_chunks_depend_on_their_own_lines():
    text = [f"line {i * i % 97} of text {i}" for i in range(200)]
    found = lines.chunks(text)
    assert [start for start, _ in found] == list(range(199)) and {n for _, n in found} == {2, 3, 4}
    assert lines.chunks(["new first line", *text])[1:] == [(start + 1, n) for start, n in found]
    assert lines.chunks(["a"]) == lines.chunks([]) == [] and lines.chunks(["a", "b"]) == [(0, 2)]


@pytest.mark.parametrize("length, least", [(2, 0.85), (3, 0.92), (5, 0.95), (20, 0.98)])
def test_shared_lines_go_from_later_documents(length, least):
    draw = random.Random(length)
    line = lambda: " ".join(draw.choices("abcdefghij", k=8)) + str(draw.random())
    removed = 0
    for pair in range(300):
        passage = [line() for _ in range(length)]
        rows = [(i, "\n".join([line() for _ in range(draw.randrange(4))] + passage + [line() for _ in range(draw.randrange(4))])) for i in range(2)]
        first, second = plain(rows)
        assert first[1] == rows[0][1] and set(rows[1][1].split("\n")) - set(second[1].split("\n")) <= set(passage)
        removed += second[2]
    assert removed >= least * 300 * length


def test_runs_of_a_long_text(docs):
    """A copy of many lines loses them in one run; a line that goes stays at an earlier place."""
    body = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, body), (2, "start\n" + body + "\nend"), (3, "x\nx\nx\nx\ny")]
    got = {r["doc_id"]: r for r in lines.remove_repeated(docs(rows, extra=("bucket",)), details=True).collect()}
    assert got[1]["text"] == body
    assert got[2]["text"].startswith("start\n") and got[2]["text"].endswith("end") and got[2]["text"].count("\n") <= 4
    assert got[3]["text"].split("\n")[0] == "x" and got[3]["text"].endswith("y")


def test_shared_passage_is_cut_from_all_but_the_first(docs):
    passage = "\n".join(f"shared sentence number {i} with many words in it" for i in range(30))
    rows = [(i, f"own start {i}\nown second {i * 7}\n{passage}\nown end {i}\nlast {i}") for i in range(5)]
    left = {r["doc_id"]: r["text"] for r in lines.remove_repeated(docs(rows)).collect()}
    assert left[0] == rows[0][1]
    for i in range(1, 5):
        assert f"own start {i}" in left[i] and f"last {i}" in left[i]
        assert left[i].count("shared sentence") <= 2
    assert {r["doc_id"]: r["n_chars"] for r in lines.remove_repeated(docs(rows)).collect()} == {i: len(t) for i, t in left.items()}


def test_equal_hashes_with_different_bytes_stay(spark, docs, monkeypatch):
    rows = [(1, "a b\nc d"), (2, "a b\nc d"), (3, "e f\ng h")]
    real = lines.line_chunks
    monkeypatch.setattr(lines, "line_chunks", lambda *a: real(*a).withColumn("high", F.lit(1).cast("long")).withColumn("low", F.lit(1).cast("long")))
    assert sorted(r["text"] for r in lines.remove_repeated(docs(rows)).collect()) == sorted(t for _, t in rows)


def test_odd_rows(docs, odd_rows):
    table = docs(odd_rows)
    found = lines.remove_repeated(table)
    assert found.columns == table.columns
    rows = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert len(rows) == len(odd_rows)
    texts = sorted(((i is None, i or 0, t is None, t or "") for i, t in rows))
    # rows equal in id and text are one document: both keep the passage, the later id loses it or keeps its last line
    want = dict((i, t) for i, t, _ in plain([(5, odd_rows[4][1]), (6, odd_rows[6][1])]))
    assert texts == sorted((i is None, i or 0, t is None, want.get(i, t) or "") if i != 6 else (False, 6, False, want[6]) for i, t in odd_rows)
    assert lines.remove_repeated(docs([])).count() == 0
