import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from riskflow.llm import winnowing
from riskflow.llm.entries import QUERIES

FULL = (1 << 64) - 1


def plain(text):
    """[(hash, position)] with a loop over all windows."""
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    k, w = winnowing.K, winnowing.WINDOW

    def rolled(part):
        state = 0
        for h in part:
            state = ((state << 1 | state >> 63) & FULL) ^ h
        return state

    runs = [rolled(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [rolled(words)] if words else []
    out = []
    for start in range(max(1, len(runs) - w + 1) if runs else 0):
        best = min(range(start, min(len(runs), start + w)), key=lambda i: (runs[i] >> 26, -i))
        if not out or out[-1][1] != best:
            out.append((runs[best], best))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, texts):
    ids = sorted(texts)
    assert len(rows) == len(ids)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        text, following = texts[i] or "", texts[after] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, r = plain(text), plain(changed), rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{h:x}:{p}" for h, p in own)
        assert r["edited_fingerprint"] == " ".join(f"{h:x}:{p}" for h, p in other)
        assert r["near_edited"] == pytest.approx(likeness(own, other)) and r["near_next"] == pytest.approx(likeness(own, plain(following)))


def digested(found):
    return {r["doc_id"]: r for r in found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), winnowing.printed(F.col("prints")).alias("fingerprint"),
        winnowing.printed(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next").collect()}


def test_query_on_the_given_table(spark, sf, given):
    check({r["doc_id"]: r for r in QUERIES["op9_winnowing"](spark, sf).collect()}, {i: t for i, t, _ in given})


def test_ties_take_the_rightmost_and_few_words_work(docs):
    texts = {1: "a " * 100, 2: "a b " * 60, 3: "one two", 4: "", 5: None, 6: "é\x0bü x " * 30, 7: "w"}
    check(digested(winnowing.compare_neighbours(docs(list(texts.items())))), texts)
    check(digested(winnowing.compare_neighbours(docs([(3, "just one row of words")]))), {3: "just one row of words"})


def test_shared_run_shares_a_hash(docs):
    shared = " ".join(f"s{i}" for i in range(winnowing.K + winnowing.WINDOW - 1))
    found = digested(winnowing.compare_neighbours(docs([(1, " ".join(f"a{i}" for i in range(50)) + " " + shared), (2, shared + " " + " ".join(f"b{i}" for i in range(70)))])))
    assert found[1]["near_next"] > 0


def test_odd_rows(docs, odd_rows):
    found = winnowing.compare_neighbours(docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    same = [r["prints"] for r in found if r["doc_id"] in (5, 6)]
    assert same[0] == same[1] == same[2]
    assert winnowing.compare_neighbours(docs([])).count() == 0


def test_runs_without_python(docs):
    plan = winnowing.compare_neighbours(docs([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
