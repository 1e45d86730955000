import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Small document tables; further columns, named like columns the operators make for themselves, come after the text."""

    def build(rows, extra=("id", "size", "row", "_row", "ids", "blob", "cuts", "bucket", "chunk")):
        columns = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {name} string" for name in extra)
        full = [(i, t, "en", rest[0] if rest else "src1", None if t is None else len(t)) for i, t, *rest in rows]
        return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in full], columns)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties."""
    long = " ".join(WORDS[i * i % 20] + str(i % 977) for i in range(30_000))
    return [(1, None), (2, ""), (3, "one"), (4, long), (5, "same words here\nand one more line\nthree"), (5, "same words here\nand one more line\nthree"),
            (6, "same words here\nand one more line\nthree"), (None, "no id at all"), (None, None), (7, "   \n\t "), (8, "x" * 50_000)]


@pytest.fixture(scope="session")
def given(sf):
    """The given documents, as plain rows."""
    import duckdb

    return duckdb.connect().execute(f"select doc_id, text, source from '{sf}/documents.parquet' order by doc_id").fetchall()
