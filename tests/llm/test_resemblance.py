"""The pipeline's near duplicates against the Jaccard similarities of all pairs."""

import re
from random import Random

import corpus_pipeline
import pytest

from riskflow.llm import lines, resemblance
from riskflow.llm.tables import table
from riskflow.session import materialize


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """rows: list of (id, text). The smallest id of each component over pairs of Jaccard 0.8 or more."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sets = [plain_set(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, (name, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((name is None, name or 0, name))
    return sorted((min(g)[2] for g in groups.values()), key=lambda v: (v is None, v or 0))


@pytest.fixture(scope="module")
def near_copies():
    """Texts with copies in which a growing number of words differs, around the threshold."""
    rng, rows = Random(5), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((12, 60, 300)))]
        for changed in range(5):
            copy = list(words)
            for at in rng.sample(range(len(words)), min(len(words), changed * max(1, len(words) // 120))):
                copy[at] = f"other{rng.randrange(5000)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    return rows


def ids(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=lambda v: (v is None, v or 0))


def test_stage_keeps_one_of_each_group(spark, sf, docs, near_copies, odd_rows):
    rows = near_copies + [(i if i is None else i + 1000, t) for i, t in odd_rows]
    kept = corpus_pipeline.near_duplicates(spark, docs(rows), sf)
    assert kept.columns == docs(rows).columns
    assert ids(kept) == plain_kept(rows)


def test_blocks_lose_no_link(spark, sf, docs, near_copies, monkeypatch):
    monkeypatch.setattr(resemblance, "BLOCK", 2)
    assert ids(corpus_pipeline.near_duplicates(spark, docs(near_copies), sf)) == plain_kept(near_copies)


@pytest.mark.parametrize("deduped", [False, True])
def test_given_documents(spark, deduped):
    given = table(spark, "/root/testdata/sf0.01", "documents")
    given = materialize(lines.remove_repeated(given)) if deduped else given
    rows = [(r["doc_id"], r["text"]) for r in given.select("doc_id", "text").collect()]
    assert ids(corpus_pipeline.near_duplicates(spark, given, "")) == plain_kept(rows)


def test_band_keys_agree_as_often_as_min_hashes_do():
    import numpy as np

    rng = np.random.default_rng(3)
    for both in (133, 178):
        agreed, rounds = 0, 200
        for _ in range(rounds):
            a, b, c = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (200 - both, 200 - both, both))
            agreed += (resemblance.band_keys(np.concatenate([a, c])) == resemblance.band_keys(np.concatenate([b, c]))).sum()
        assert abs(agreed / rounds / resemblance.BANDS - (both / (400 - both)) ** resemblance.ROWS) < 0.03
