import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import class_model as m
from riskflow.llm.entries import QUERIES


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def held(identity):
    return identity is None or zlib.crc32(str(identity).encode()) % 5 == 1


def check(rows, texts):
    """Counts and base scores against plain loops. ``texts``: (doc_id, text)."""
    seen = Counter(w for i, t in texts if not held(i) for w in [*tokens(t), None])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t in texts:
        line = [*tokens(t), None]
        want.append((i is not None, i or 0, held(i), len(line), sum(seen[w] > 0 for w in line), n, sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in line)))
    got = [(r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], rel=1e-9)


def plain_scores(rows, n_ends):
    """Scores of texts given as classes and counts, with a loop over words."""
    learn = [list(zip(c, n)) for trained, c, n in rows if trained]
    size, total, moves, rare = Counter(), Counter(), Counter(), Counter()
    words = {}
    for trained, classes, counts in rows:
        if trained:
            for c, n in zip(classes, counts):
                total[c] += 1
                words.setdefault((c, n), 0)
                words[c, n] += 1
    for (c, n), occurrences in words.items():
        size[c] += occurrences // n
    total[m.END], size[m.END] = n_ends, 1
    n1 = sum(k // n for (c, n), k in words.items() if n == 1)
    n2 = sum(k // n for (c, n), k in words.items() if n == 2)
    d = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    for line in learn:
        before, once = m.END, False
        for c, n in [*line, (m.END, n_ends)]:
            moves[before, c] += 1
            if once:
                rare[c] += 1
            before, once = c, n == 1
    all_tokens, all_words = sum(total.values()), sum(size.values())

    def move(a, b):
        row = rare if a is None else {c: moves[a, c] for c in total}
        return (row[b] + m.PRIOR_WEIGHT * total[b] / all_tokens) / (sum(row[c] for c in total) + m.PRIOR_WEIGHT)

    out = []
    for _, classes, counts in rows:
        score, before = 0.0, m.END
        for c, n in [*zip(classes, counts), (m.END, n_ends)]:
            base = (n + 0.5) / (all_tokens + 0.5 * (all_words + 1))
            if n == 0:
                p = sum(move(before, g) * d * size[g] / total[g] for g in total if g != m.END and total[g])
            else:
                p = move(before, c) * (1.0 if c == m.END else (n - d) / total[c])
            score += math.log10((1 - m.MIX) * p + m.MIX * base)
            before = None if n == 0 else c
        out.append(score)
    return out


def texts_of(resolved, model):
    """(id, (trained, classes, counts)) of each text; the class of an unknown word is not used."""
    for row in resolved.collect():
        codes, places = np.frombuffer(row["codes"], np.uint16), iter(np.frombuffer(row["places"], np.int32).tolist())
        own = list(zip(np.frombuffer(row["classes"], np.uint8).tolist(), np.frombuffer(row["counts"], np.int64).tolist()))
        line = [own[next(places)] if c == 65_535 else (int(model.of_class[c]), int(model.of_count[c])) for c in codes]
        ends = np.cumsum(row["sizes"])
        for i, trained, a, b in zip(row["ids"], row["trained"], ends - row["sizes"], ends):
            yield i, (trained, [None if c == m.UNKNOWN else c % m.SINGLE for c, _ in line[a:b]], [n for _, n in line[a:b]])


@pytest.mark.parametrize("dictionary, core", [(60, 25), (10_000, 8_000)])
def test_model(spark, given, dictionary, core):
    """All scores by the definition, from the classes found; words are in the same class everywhere."""
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    rows = docs.select(F.col("doc_id").alias("id"), m.held_out(F.col("doc_id")).alias("held"), "text")
    resolved, model, n_ends = m.fit(rows, dictionary, core)
    coded = sorted(texts_of(resolved, model), key=lambda r: r[0])
    classes = {}
    for (i, text, _), (j, (_, of, counts)) in zip(sorted(given), coded, strict=True):
        assert i == j and len(tokens(text)) == len(of)
        for w, c, n in zip(tokens(text), of, counts):
            assert classes.setdefault(w, (c, n)) == (c, n)
    want = plain_scores([r for _, r in coded], n_ends)
    got = {r["id"]: r["score"] for r in m.score_texts(resolved, model, n_ends).collect()}
    for (i, _), score in zip(coded, want):
        assert got[i] == pytest.approx(score, rel=1e-9)
    # all words and the unknown one together, after each history
    known = [cn for cn in classes.values() if cn[1]]
    words = model.transitions[:, [c for c, _ in known]] * model.emission(np.array([c for c, _ in known]), np.array([n for _, n in known]))
    assert np.allclose(words.sum(1) + model.transitions[:, m.END] + model.unknown, 1)


def test_gains():
    """The gain of a move is the difference of the whole objective."""
    rng = np.random.default_rng(3)
    n, k = 30, m.CLASSES
    pairs = rng.poisson(0.6, (n, n)).astype(float)
    classes = rng.integers(0, 6, n)

    def counts_under(of):
        out = np.zeros((k, k))
        np.add.at(out, (of[:, None], of[None, :]), pairs)
        return out

    counts = counts_under(classes)
    of = np.eye(k)[classes]
    gains = m.move_gains(counts, classes, pairs @ of, pairs.T @ of, np.diag(pairs).copy())
    for w in range(n):
        for to in range(6):
            moved = classes.copy()
            moved[w] = to
            assert gains[w, to] - gains[w, classes[w]] == pytest.approx(m._objective(counts_under(moved)) - m._objective(counts), abs=1e-6)


def test_given(spark, sf, given):
    rows = QUERIES["op11_class_model"](spark, sf).collect()
    check(rows, [(i, t) for i, t, _ in given])
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.85 * sum(r["base_score"] for r in out)
    same = {}
    for r in rows:
        text = next(t for i, t, _ in given if i == r["doc_id"])
        assert same.setdefault(text, r["score"]) == pytest.approx(r["score"], rel=1e-12)


def test_odd_rows(spark, docs, odd_rows):
    rows = m.score(docs(odd_rows)).collect()
    check(rows, odd_rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_nothing_to_learn_from(spark, docs):
    assert m.score(docs([])).collect() == []
    held_only = [i for i in range(40) if held(i)][:3]
    rows = m.score(docs([(i, "some words") for i in held_only] + [(None, None)])).collect()
    assert [r["score"] for r in rows] == [r["base_score"] for r in rows] and {r["train_tokens"] for r in rows} == {0}
    rows = m.score(docs([(i, "") for i in range(6)])).collect()
    assert all(r["n_tokens"] == 1 and math.isfinite(r["score"]) for r in rows)


def test_small_pieces(spark, given, monkeypatch):
    """Chunks of a text each and early flushes give the same counts."""
    monkeypatch.setattr(m, "CHUNK_BYTES", 1)
    monkeypatch.setattr(m, "FLUSH", 50)
    some = given[:60]
    rows = m.score(spark.createDataFrame(some, "doc_id long, text string, source string"), dictionary_size=50, core_size=20).collect()
    check(rows, [(i, t) for i, t, _ in some])
