import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskflow.llm import bpe
from riskflow.llm.entries import QUERIES, VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids(text):
    return np.frombuffer(bpe.load(VOCABULARY).encode(text), "<u4").tolist()


def test_every_code_point_like_the_library(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for start in range(0, len(points), 200):
        text = "".join(f"a{chr(c)}B {chr(c)}1 " for c in points[start : start + 200])
        assert ids(text) == library.encode(text, add_special_tokens=False).ids, hex(points[start])


def test_random_strings_like_the_library(library):
    rng = random.Random(3)
    letters = "aeiothnsrAE ßéÉΣσİ'’.,!?1290\n\t\x1c\x85 ́中文<|>_-"
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        assert ids(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "it's we'll they'd I'm", "th" * 5000, "日本語" * 3000, ""):
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_never_split_a_merge():
    coder = bpe.load(VOCABULARY)
    assert all(a[-1] + b[0] in coder.joined for a, b in coder.ranks)


def test_query_on_the_given_table(spark, sf, given, library):
    found = {r["doc_id"]: r for r in QUERIES["op1_bpe_round_trip"](spark, sf).collect()}
    assert len(found) == len(given)
    for i, text, _ in given:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(want)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(docs, odd_rows, library):
    coded = bpe.encode(docs(odd_rows), VOCABULARY, with_text=True)
    rows = coded.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in odd_rows)
    assert all(r["decoded"] == "" for r in rows if r["n_tokens"] == 0)
    back = bpe.decode(coded, VOCABULARY)
    assert sorted(r["decoded"] for r in back.collect()) == sorted(r["decoded"] for r in rows)
    assert bpe.encode(docs([]), VOCABULARY).count() == 0
