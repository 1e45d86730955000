"""Quality classifier learned from trusted positives and unlabelled web text.

The non-negative unbiased risk of positive-unlabelled learning is minimised: with logistic loss and class prior p it is
p * E_P[loss(f)] + max(0, E_U[loss(-f)] - p * E_P[loss(-f)]). The model is additive over binned measures of the whole
text (shares of characters, lengths, repetition); bins are quantiles over all documents. Every evaluation of risk and
gradient is one pass of grouped sums over all positives and all unlabelled rows; no row is sampled, and only the sums
(a number per bin) reach the driver, where L-BFGS takes the next step.

The prior is the share of positives among the labelled rows of the learning folds, or a given number. Unlabelled are all
rows of the learning folds, whatever their label. Labels, language, source and id are no inputs of a score.

Rules: a null text counts as empty and is scored like one; ids that are null count as held out and get a score; of several
labels for an id the largest counts; null labels are none; without any positive the score is the prior (0.5 if there is no
label at all); repeated rows count and are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import slices
from riskflow.session import materialize

FOLDS, THRESHOLD = 5, 0.3
MEASURES = ("letters", "upper", "digits", "spaces", "lines", "bars", "stops", "calls", "symbols", "beyond_ascii", "log_words", "word_length",
            "distinct_words", "distinct_near", "distinct_lines", "packed", "short_words", "long_words")
QUANTILES = (0.01, 0.05, 0.15, 0.5, 0.85, 0.95, 0.99)
BINS = len(QUANTILES) + 1
WIDTH = len(MEASURES) * BINS + 1
#: Weight of the squared steps between bins (over the number of rows), evaluations at most, and the relative gain at which to stop.
RIDGE, PASSES, GAIN = 0.8, 60, 1e-6


def measures(text: str) -> list[float]:
    raw = text.encode()
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    spaces, lines, bars = int(seen[32] + seen[9]), int(seen[10]), int(seen[124])
    stops, calls, beyond = int(seen[46] + seen[44]), int(seen[33] + seen[63]), int(seen[128:].sum())
    symbols = n - upper - lower - digits - spaces - lines - bars - stops - calls - beyond if raw else 0
    words = text.split()
    w = max(1, len(words))
    near = [len(set(words[i : i + 50])) / len(words[i : i + 50]) for i in range(0, len(words), 50)]
    rows = text.split("\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        (upper + lower + beyond) / n, upper / max(1, upper + lower), digits / n, spaces / n, lines / n, bars / n, stops / w, calls / n, symbols / n,
        beyond / n, float(np.log2(w)), float(sizes.sum() / w), len(set(words)) / w, sum(near) / max(1, len(near)), len(set(rows)) / len(rows),
        len(zlib.compress(raw, 1)) / (n + 20), float((sizes <= 3).sum() / w), float((sizes >= 12).sum() / w)]


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, x, row``: the measures of every whole text and the text's hash."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    source = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                values = pa.array([measures(text) for text in part.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), values, part.column(2)], names=["id", "x", "row"])

    return source.mapInArrow(run, "id long, x array<double>, row long")


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string")) % FOLDS == 0, F.lit(True))


@dataclass(frozen=True)
class QualityModel:
    edges: np.ndarray  # (measures, BINS - 1)
    weights: np.ndarray  # WIDTH, the last one is the intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[columns(x, self.edges)].sum(1) + self.weights[-1], -40, 40)))


def columns(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The coefficient that each measure of a row picks."""
    return np.stack([np.searchsorted(edges[m], x[:, m], side="left") + m * BINS for m in range(len(MEASURES))], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))


def estimate_edges(rows: DataFrame) -> np.ndarray:
    found = rows.agg(*[F.percentile_approx(F.col("x")[m], list(QUANTILES), 2000).alias(name) for m, name in enumerate(MEASURES)]).first()
    return np.array([found[name] for name in MEASURES], float)


def risk_sums(rows: DataFrame, edges: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over positives and unlabelled rows: loss(f), loss(-f) and the gradients of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, WIDTH + 1))
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            at = columns(_matrix(batch.column(0)), edges)
            f = weights[at].sum(1) + weights[-1]
            losses = np.logaddexp(0, -f), np.logaddexp(0, f)
            slopes = -1 / (1 + np.exp(np.clip(f, -40, 40))), 1 / (1 + np.exp(np.clip(-f, -40, 40)))
            for k, (part, sign) in enumerate(((positive, 0), (positive, 1), (np.ones_like(positive), 1))):
                sums[k, WIDTH] += (part * losses[sign]).sum()
                slope = part * slopes[sign]
                sums[k, : WIDTH - 1] += np.bincount(at.ravel(), np.repeat(slope, at.shape[1]), WIDTH - 1)
                sums[k, WIDTH - 1] += slope.sum()
            sums[3, :2] += positive.sum(), len(positive)
        kind, place = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(kind.ravel()), pa.array(place.ravel()), pa.array(sums.ravel())], names=["kind", "place", "value"])

    out = np.zeros((4, WIDTH + 1))
    for kind, place, value in rows.select("x", "positive").mapInArrow(run, "kind long, place long, value double").groupBy("kind", "place").agg(F.sum("value")).collect():
        out[kind, place] = value
    return {"p_plus": out[0], "p_minus": out[1], "u_minus": out[2], "counts": out[3, :2]}


def _bins(steps: np.ndarray) -> np.ndarray:
    """Coefficients of the bins of each measure as running sums of steps, so that neighbouring bins stay alike."""
    return np.append(np.cumsum(steps[:-1].reshape(len(MEASURES), BINS), axis=1).ravel(), steps[-1])


def _steps(slopes: np.ndarray) -> np.ndarray:
    """The slope in each step from the slopes in the bins."""
    return np.append(np.cumsum(slopes[:-1].reshape(len(MEASURES), BINS)[:, ::-1], axis=1)[:, ::-1].ravel(), slopes[-1])


def non_negative_risk(sums: dict[str, np.ndarray], prior: float, steps: np.ndarray) -> tuple[float, np.ndarray]:
    """Risk with penalty and its gradient in the steps."""
    positives, unlabelled = sums["counts"]
    plus, minus, rest = sums["p_plus"] / positives, sums["p_minus"] / positives, sums["u_minus"] / unlabelled
    ridge = RIDGE / unlabelled
    negative = rest[WIDTH] - prior * minus[WIDTH]
    risk, slopes = prior * plus[WIDTH], prior * plus[:WIDTH]
    if negative > 0:
        risk, slopes = risk + negative, slopes + rest[:WIDTH] - prior * minus[:WIDTH]
    pull = np.append(steps[:-1], 0.0)
    return risk + ridge / 2 * float(pull @ pull), _steps(slopes) + ridge * pull


def fit(rows: DataFrame, prior: float, edges: np.ndarray) -> QualityModel:
    """``rows``: x, positive (1 for trusted positives) of all learning rows. L-BFGS over steps that are scaled by how many
    rows they part, so that steps at rare values settle as fast as those at frequent ones."""
    steps = np.zeros(WIDTH)
    steps[-1] = np.log(prior / (1 - prior))

    def evaluate(v: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        sums = risk_sums(rows, edges, _bins(v))
        return *non_negative_risk(sums, prior, v), sums

    risk, gradient, sums = evaluate(steps)
    # at the start all rows have one score, so these slopes are in proportion to shares of the rows
    share = _steps(sums["u_minus"][:WIDTH]) / max(1e-300, sums["u_minus"][WIDTH - 1])
    scale = 1 / np.sqrt(np.maximum(share * (1 - share), 0.0) / 10 + RIDGE / sums["counts"][1] + 1e-3)
    scale[-1] = 1 / np.sqrt(0.1)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    passes = 1
    while passes < PASSES:
        q, alphas = gradient * scale, []
        for s, y in reversed(history):
            alphas.append((s @ q) / (s @ y))
            q = q - alphas[-1] * y
        if history:
            q = q * (history[-1][0] @ history[-1][1]) / (history[-1][1] @ history[-1][1])
        for (s, y), alpha in zip(history, reversed(alphas)):
            q = q + (alpha - (y @ q) / (s @ y)) * s
        length, slope = 1.0, float((gradient * scale) @ q)
        while True:
            trial = steps - length * q * scale
            new_risk, new_gradient, _ = evaluate(trial)
            passes += 1
            if new_risk <= risk - 1e-4 * length * slope or passes >= PASSES:
                break
            length /= 2
        gain = risk - new_risk
        if gain <= 0:
            break
        s, y = (trial - steps) / scale, (new_gradient - gradient) * scale
        if s @ y > 1e-12:
            history = [*history[-9:], (s, y)]
        steps, risk, gradient = trial, new_risk, new_gradient
        if gain < GAIN * max(1e-3, abs(risk)):
            break
    return QualityModel(edges, _bins(steps))


def learn(rows: DataFrame, labels: DataFrame, prior: float | None = None, id_column: str = "doc_id", label_column: str = "quality") -> QualityModel:
    """``rows``: id, x of all documents (written once). Labels of held-out ids are never read into the fit."""
    known = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label")))
    learning = materialize(
        rows.where(~held_out(F.col("id"))).join(known, "id", "left")
        .select("x", F.coalesce(F.col("label") == 1, F.lit(False)).cast("int").alias("positive"), F.col("label").isNotNull().cast("int").alias("labelled")))
    positives, labelled = learning.agg(F.sum("positive"), F.sum("labelled")).first()
    if prior is None:
        prior = (positives or 0) / labelled if labelled else 0.5
    prior = min(max(prior, 0.01), 0.99)
    edges = estimate_edges(rows) if positives else np.zeros((len(MEASURES), BINS - 1))
    if not positives:
        return QualityModel(edges, np.append(np.zeros(WIDTH - 1), np.log(prior / (1 - prior))))
    return fit(learning, prior, edges)


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``id, score`` (six digits), ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.round(model.score(_matrix(batch.column(1))), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], names=["id", "score", "row"])

    return rows.select("id", "x", "row").mapInArrow(run, "id long, score double, row long")


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", prior: float | None = None) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``."""
    rows = materialize(measured(docs, id_column, text_column))
    scored = score(rows, learn(rows, labels, prior))
    return scored.select(F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", prior: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with all their columns. Rows are scored where they are read: measuring a
    text again costs less than shuffling it to a list of verdicts."""
    model = learn(materialize(measured(docs, id_column, text_column)), labels, prior)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([measures(text) for text in texts], float).reshape(-1, len(MEASURES))
            yield pd.Series(np.round(model.score(x), 6))

    return docs.where(scored(F.coalesce(F.col(text_column).cast("string"), F.lit(""))) >= THRESHOLD)
