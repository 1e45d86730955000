"""Ranked lexical search with blocked posting lists.

Per segment of documents each term's posting list is cut into blocks of similar documents, and each block stores the
coordinatewise maximum of its documents' impacts. A query walks its lists from the heaviest; a block is read only
if the summary's score, an upper bound of every document in it, reaches the tenth best score so far, and the walk ends
when the lists left cannot reach it together. Bounds are exact integers, so no result is lost.

1. One pass over all texts keeps, per document, its number of terms and the counts of the terms the queries ask for.
2. N, L and document frequencies are sums over all documents.
3. Tasks gather documents into segments of bounded size, build the blocks and search them. The best scores found so far
   are kept from segment to segment; at most ``k`` rows per query leave a task, and a window with a group limit takes the
   best of all tasks.

The index holds the lists of terms that are asked for. Queries are taken in blocks of bounded vocabulary, so what a task
holds depends neither on the number of queries nor on the documents; each block of queries is one pass.

Clusters: documents are projected to ``DIMENSIONS`` numbers (seeded signs, weighted impacts); every ``BLOCK``-th document of a list,
in the order of its first number, is a centre, and each document joins the nearest centre. A poor cluster costs time only.

Rules for odd input: null texts have no terms and are no result; a text without terms counts for nothing; equal scores go by id,
null ids last, then by the order of the text's hash; repeated rows are ranked each; queries that are null, have no terms
or no match give no row; repeated queries are answered each; null query ids are answered as one more id; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.session import materialize

#: Letters and digits of ASCII and everything beyond it make terms; A-Z become small.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BEST, SCALE, SATURATION, FLAT, SLOPE = 10, 1_000_000_000, 8, 10, 90
MOST_TERMS, MOST_CELLS, BLOCK, DIMENSIONS = 8_192, 8_000_000, 32, 32


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def query_blocks(queries: DataFrame, id_column: str, text_column: str, most_terms: int = MOST_TERMS) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """Lists of (number of the row, id, terms) with at most ``most_terms`` different terms together; a single query may
    exceed it alone."""
    block, vocabulary = [], set()
    rows = queries.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).orderBy("id", "text").toLocalIterator()
    for number, (identity, text) in enumerate(rows):
        terms = sorted(set(terms_of(text)))
        if not terms:
            continue
        if block and len(vocabulary | set(terms)) > most_terms:
            yield block
            block, vocabulary = [], set()
        vocabulary |= set(terms)
        block.append((number, identity, terms))
    if block:
        yield block


def read_terms(documents: DataFrame, vocabulary: list[bytes], id_column: str, text_column: str) -> DataFrame:
    """``id, tie, n, terms, counts`` of every document with a term; ``terms`` are places in the vocabulary."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["id", "tie", "n", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lengths, terms, counts = [], [], []
                for text in part.column(2):
                    found = terms_of(text.as_py())
                    lengths.append(len(found))
                    asked = Counter(filter(place.__contains__, found))
                    terms.append([place[t] for t in asked])
                    counts.append(list(asked.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=names)

    source = documents.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("tie"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, tie long, n long, terms array<int>, counts array<long>").where("n > 0")


class Segment:
    """Blocked posting lists over the rows of ``impacts`` (documents x terms)."""

    def __init__(self, impacts: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        self.impacts = impacts
        self.blocks: dict[int, list[np.ndarray]] = {}
        self.summaries: dict[int, np.ndarray] = {}
        signs = np.random.default_rng(12).integers(0, 2, (impacts.shape[1], DIMENSIONS)) * 2.0 - 1
        points = (impacts * (weights / 1e6)) @ signs
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        self._points, self._block = points, block

    def list_of(self, term: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Blocks (rows) and summaries of a term's list, built when a query first asks for them."""
        if term not in self.blocks:
            rows = np.flatnonzero(self.impacts[:, term])
            points = self._points[rows]
            centres = points[np.argsort(points[:, 0], kind="stable")[:: self._block]]
            of = (points @ centres.T).argmax(1) if len(rows) else np.zeros(0, int)
            order = np.argsort(of, kind="stable")
            rows, of = rows[order], of[order]
            starts = np.flatnonzero(np.diff(of, prepend=-1)) if len(rows) else np.zeros(0, int)
            self.blocks[term] = np.split(rows, starts[1:]) if len(rows) else []
            self.summaries[term] = np.maximum.reduceat(self.impacts[rows], starts) if len(rows) else self.impacts[:0]
        return self.blocks[term], self.summaries[term]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all documents that may be among the best ``k``; none with a score below ``floor`` is owed.
        ``seen`` takes the number of blocks read and of blocks there were."""
        weights = weights[terms]
        most = weights * self.impacts[:, terms].max(0).astype(np.int64)
        order = np.argsort(-most, kind="stable")
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0)
        visited = np.zeros(len(self.impacts), bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for step, at in enumerate(order):
            # a document in none of the lists before scores what is left at most
            if left[step] < floor or most[at] == 0:
                break
            blocks, summaries = self.list_of(int(terms[at]))
            bounds = summaries[:, terms].astype(np.int64) @ weights
            for b in np.argsort(-bounds, kind="stable"):
                if bounds[b] < floor:
                    break
                new = blocks[b][~visited[blocks[b]]]
                if len(new):
                    if seen is not None:
                        seen[0] += 1
                    visited[new] = True
                    rows, scores = np.append(rows, new), np.append(scores, self.impacts[np.ix_(new, terms)].astype(np.int64) @ weights)
                    if len(scores) >= k:
                        floor = max(floor, int(np.partition(scores, -k)[-k]))
            if seen is not None:
                seen[1] += len(blocks)
        keep = scores >= max(floor, 1)
        return rows[keep], scores[keep]


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["score", "id", "tie"], ascending=[False, True, True], na_position="last", kind="stable").head(k)


def search_block(documents: DataFrame, block: list[tuple[int, object, list[bytes]]], k: int, id_column: str, text_column: str, most_cells: int = MOST_CELLS) -> DataFrame:
    """``number, id, tie, score``: at most ``k`` rows per query and task, the best of all among them."""
    spark = documents.sparkSession
    vocabulary = sorted({t for _, _, terms in block for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    read = materialize(read_terms(documents, vocabulary, id_column, text_column))
    n_docs, n_terms = read.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary))
    for term, n in read.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the block
        df[term] = n
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    asked = [(number, np.array([place[t] for t in terms])) for number, _, terms in block]
    shared = spark.sparkContext.broadcast((weights, asked))
    width, in_segment = len(vocabulary), max(16, most_cells // len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = shared.value
        best: dict[int, pd.DataFrame] = {}

        def search(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts)
            n = rows.column("n").to_numpy()
            # 90 * n * N may pass 64 bits; Python numbers do not
            m = np.array([FLAT + SLOPE * int(x) * n_docs // n_terms for x in n], np.int64)
            terms, counts = rows.column("terms").combine_chunks(), rows.column("counts").combine_chunks()
            at = np.repeat(np.arange(len(n)), np.diff(terms.offsets.to_numpy()))
            tf = counts.flatten().to_numpy()
            impacts = np.zeros((len(n), width), np.int32)  # below a million each
            impacts[at, terms.flatten().to_numpy()] = SCALE * tf // (1000 * tf + SATURATION * m[at])
            segment = Segment(impacts, weights)
            ids, ties = rows.column("id").to_pandas().astype("Int64"), rows.column("tie").to_numpy()
            for number, wanted in asked:
                before = best.get(number)
                floor = int(before["score"].iloc[-1]) if before is not None and len(before) == k else 1
                found, scores = segment.search(wanted, weights, k, floor)
                if len(found):
                    new = pd.DataFrame({"id": ids.iloc[found].array, "tie": ties[found], "score": scores})
                    best[number] = _best(new if before is None else pd.concat([before, new]), k)

        waiting, held = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, in_segment - held)
                waiting.append(part)
                held, start = held + part.num_rows, start + part.num_rows
                if held == in_segment:
                    search(waiting)
                    waiting, held = [], 0
        if held:
            search(waiting)
        for number, rows in best.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), number)), pa.Array.from_pandas(rows["id"], type=pa.int64()), pa.array(rows["tie"].to_numpy()), pa.array(rows["score"].to_numpy())],
                names=["number", "id", "tie", "score"])

    return read.mapInArrow(run, "number long, id long, tie long, score long")


def search(documents: DataFrame, queries: DataFrame, k: int = BEST, id_column: str = "doc_id", text_column: str = "text",
           query_id: str = "item_id", query_text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """``query_id, rank, id_column, score``: the ``k`` best documents of every query with a score above 0."""
    spark = documents.sparkSession
    results = []
    for block in query_blocks(queries, query_id, query_text, most_terms):
        found = search_block(documents, block, k, id_column, text_column)
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"), "tie")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(number, identity) for number, identity, _ in block], "number long, query long")
        results.append(materialize(best.join(F.broadcast(names), "number").select(
            F.col("query").alias(query_id), "rank", F.col("id").alias(id_column), "score")))
    if not results:
        return spark.createDataFrame([], f"{query_id} long, rank int, {id_column} long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out


TERMS_SQL = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH terms AS (SELECT doc_id, row_number() OVER () AS row, {TERMS_SQL.format(text="text")} AS found FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row, doc_id, len(found) AS n FROM terms WHERE len(found) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({TERMS_SQL.format(text="text")}) AS term FROM benchmark),
postings AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(found) AS term FROM terms) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weighted AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term),
impacts AS (
    SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS part
    FROM postings JOIN docs USING (row) JOIN weighted USING (term), totals),
scored AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(part)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, row),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
