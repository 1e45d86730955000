"""Language-model scoring with a class-based bigram model.

P(w | v) = P(class of w | class of v) * P(w | class of w). Words are assigned to classes by exchange: a word moves to the
class that raises the likelihood of the class bigrams most.

1. Every word of the learning texts is counted. Words of more than 64 bytes go by their digest, so no key is long.
2. All texts are written once as numbers, in chunks of about a megabyte: the ``DICTIONARY`` most frequent words have fixed
   numbers, other words a place in the chunk's own list.
3. The ``CORE`` most frequent words are exchanged in rounds. A round computes, for each word, the exact gain of each move
   (its counts are taken out of its class first) and moves half of the words, chosen by hash. Neighbours of a core word are
   counted over all texts: at most CORE squared pairs, one row per word, whatever the size of the corpus. All other words
   are one class meanwhile.
4. Each of the other words, however rare, is exchanged against the classes found, with all its neighbours. Its counts are small against
   a class, so the gain is taken to first order.
5. The classes are joined back to the chunks; class bigrams are counted over all learning texts.

Smoothing. An absolute discount d = n1 / (n1 + 2 n2) moves mass of each class to the unknown word, so a class with many
rare words (names, numbers) expects new ones. Words seen once stand for unknown ones as history. Transitions are smoothed
towards class frequencies, and the whole with ``MIX`` of the base model. The probabilities of all words and the unknown one sum to 1
after every history.

Rules for odd input: a null text is empty and consists of the end alone; null ids are held out; repeated rows count and
are scored each; without any learning text the score is the base score; other columns are not read. Of one text, words go
through one task; nothing else depends on the length of a text or on how often a word occurs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.session import materialize

FOLDS, HELD_OUT = 5, 1
DICTIONARY, CORE = 65_534, 8_192
#: Classes 0 to 61 are free, REST is where words start, END is the class of the end alone.
CLASSES, REST, END = 64, 62, 63
ROUNDS, LEAST_GAIN = 8, 1e-4
PRIOR_WEIGHT, MIX = 64.0, 0.02
#: Codes in the class bytes of a text: SINGLE is added for words seen once; UNKNOWN is the word never seen.
SINGLE, UNKNOWN = 64, 255
LONGEST_WORD, CHUNK_BYTES, FLUSH = 64, 1_000_000, 400_000


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def words_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case; a long one is replaced by its digest."""
    found = (text or "").encode().lower().split()
    if found and max(map(len, found)) > LONGEST_WORD:
        found = [w if len(w) <= LONGEST_WORD else b"\0" + hashlib.md5(w).hexdigest().encode() for w in found]
    return found


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` of a table with the column text, combined in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


CHUNK = "chunk long, ids array<long>, trained array<boolean>, sizes array<int>, codes binary, places binary, words array<binary>"
_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("trained", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
                    ("codes", pa.binary()), ("places", pa.binary()), ("words", pa.list_(pa.binary()))])
_RARE = 65_535


def encode_chunks(docs: DataFrame, dictionary: list[bytes]) -> DataFrame:
    """``docs``: id, held, text. Codes are numbers of the dictionary; _RARE stands for the next one of ``places``, which
    point into ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        task, made = TaskContext.get().partitionId() << 32, 0
        ids, trained, sizes, codes, places, local, size = [], [], [], [], [], {}, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, trained, sizes, codes, places, local, size, made
            row = [task + made, ids, trained, sizes, np.concatenate(codes).tobytes(), np.asarray(places, np.int32).tobytes(), list(local)]
            made += 1
            ids, trained, sizes, codes, places, local, size = [], [], [], [], [], {}, 0
            return pa.RecordBatch.from_arrays([pa.array([value], field.type) for value, field in zip(row, _CHUNK)], schema=_CHUNK)

        for batch in batches:
            for i, held, text in zip(*(batch.column(k) for k in range(3))):
                words = words_of(text.as_py())
                coded = np.fromiter((number.get(w, _RARE) for w in words), np.uint16, len(words))
                places += [local.setdefault(words[p], len(local)) for p in np.flatnonzero(coded == _RARE).tolist()]
                ids.append(i.as_py()), trained.append(not held.as_py()), sizes.append(len(words)), codes.append(coded)
                size += 8 * len(words) + 32
                if size > CHUNK_BYTES:
                    yield close()
        if ids:
            yield close()

    return docs.select("id", "held", "text").mapInArrow(run, CHUNK)


def _with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a chunk after one another, each followed by ``end``, and the places of the ends."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(values) + len(sizes), end, values.dtype)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = values
    return out, ends


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One chunk at a time, columns as arrays; ``words`` stays an Arrow array."""
    kinds = {"codes": np.uint16, "places": np.int32, "classes": np.uint8, "counts": np.int64}
    for batch in batches:
        for k in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                if name in kinds:
                    row[name] = np.frombuffer(column[k].as_buffer(), kinds[name])
                elif name == "words" or name == "ids":
                    row[name] = column[k].values
                else:
                    row[name] = column[k].values.to_numpy(zero_copy_only=False)
            yield row


def _learning(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, places and sizes of a chunk's learning texts."""
    sizes, mine, codes = row["sizes"].astype(np.int64), row["trained"].astype(bool), row["codes"].astype(np.int64)
    of_text = np.repeat(mine, sizes)
    return codes[of_text], row["places"][of_text[codes == _RARE]], sizes[mine]


# ---- exchange of the core words -------------------------------------------------------------------------------------

def core_neighbours(chunks: DataFrame, core: int) -> DataFrame:
    """``w, others, counts, sides``: all neighbours of each core word (and of the rest, number ``core``, and the end, ``core`` + 1)."""
    width = core + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def flush() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs // width, pa.int32()), pa.array(pairs % width, pa.int32()), pa.array(n)], names=["a", "b", "n"])

        for row in _rows(batches):
            codes, _, sizes = _learning(row)
            if len(sizes):
                line, _ = _with_ends(np.minimum(codes, core), sizes, core + 1)
                before = np.concatenate(([core + 1], line[:-1]))
                waiting.append(before * width + line)
                held += len(line)
                if held > 10 * FLUSH:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    pairs = chunks.select("trained", "sizes", "codes", "places").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("w"), F.col("b").alias("other"), "n", F.lit(0).alias("side")),
        F.struct(F.col("b").alias("w"), F.col("a").alias("other"), "n", F.lit(1).alias("side")))).alias("p")).select("p.*")
    # a word has at most 2 * (core + 2) neighbours
    return both.groupBy("w").agg(F.collect_list(F.struct("other", "n", "side")).alias("near")).select(
        "w", F.col("near.other").alias("others"), F.col("near.n").alias("counts"), F.col("near.side").alias("sides"))


def _histograms(batch: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; counts of classes after and before each, of the word after itself."""
    words = batch.column(0).to_numpy().astype(np.int64)
    lengths = np.diff(batch.column(1).offsets.to_numpy())
    other, n, side = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
    row = np.repeat(np.arange(len(words)), lengths)
    table = np.bincount((row * 2 + side) * CLASSES + classes[other], n, len(words) * 2 * CLASSES).reshape(len(words), 2, CLASSES)
    same = (other == words[row]) & (side == 0)
    return words, table[:, 0], table[:, 1], np.bincount(row[same], n[same], len(words))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def move_gains(counts: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """Log-likelihood of class bigrams for each word in each class, the word's counts taken out of its own class first.
    ``counts``: class bigrams with the word in its class ``own``; the difference of two columns is the gain of a move."""
    k, n_words = len(counts), len(own)
    rows = np.arange(n_words)
    left = np.repeat(counts[None], n_words, 0)
    left[rows, own] -= after
    left[rows, :, own] -= before
    left[rows, own, own] += itself
    after, before = after.copy(), before.copy()
    after[rows, own] -= itself
    before[rows, own] -= itself
    old = _xlogx(left)
    gain = (_xlogx(left + after[:, None, :]) - old).sum(2) + (_xlogx(left + before[:, :, None]) - old).sum(1)
    diagonal = np.arange(k)
    d = left[:, diagonal, diagonal]
    both = d + after + before + itself[:, None]
    gain += _xlogx(both) - _xlogx(d + after) - _xlogx(d + before) + _xlogx(d)
    # sizes of the classes without the word, as history and as follower
    for total, extra in ((left.sum(2) + before, after.sum(1) + itself), (left.sum(1) + after, before.sum(1) + itself)):
        gain -= _xlogx(total + extra[:, None]) - _xlogx(total)
    return gain


def _class_counts(near: DataFrame, classes: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            words, after, _, _ = _histograms(batch, classes)
            np.add.at(sums, classes[words], after)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at].astype(np.int64))], names=["at", "n"])

    return _square(near.mapInArrow(run, "at long, n long"), CLASSES)


def _square(cells: DataFrame, rows: int) -> np.ndarray:
    """A table of classes from summed cells ``at, n``: its size is fixed."""
    table = np.zeros(rows * CLASSES)
    for at, n in cells.groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[at] = n
    return table.reshape(rows, CLASSES)


def _objective(counts: np.ndarray) -> float:
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(0)).sum() - _xlogx(counts.sum(1)).sum())


def exchange(near: DataFrame, core: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the core words, the rest and the end, and the class bigram counts under them. The best round counts."""
    classes = np.append(np.arange(core) % REST, [REST, END])
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for turn in range(rounds + 1):
        counts = _class_counts(near, classes)
        value = _objective(counts)
        settled = best is not None and value - best[0] < LEAST_GAIN * abs(best[0])
        if best is None or value > best[0]:
            best = value, classes, counts
        if turn == rounds or settled and turn > 2:
            break
        shared = near.sparkSession.sparkContext.broadcast((classes, counts))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            classes, counts = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    words, after, before, itself = _histograms(batch.slice(start, 64), classes)
                    mine = (words < core) & ((words * 2_654_435_761 >> 7 + turn) % 2 == 0)
                    words = words[mine]
                    gain = move_gains(counts, classes[words], after[mine], before[mine], itself[mine])[:, :END]
                    to = gain.argmax(1)
                    rows = np.arange(len(words))
                    better = gain[rows, to] > gain[rows, classes[words]] + 1e-6
                    yield pa.RecordBatch.from_arrays([pa.array(words[better], pa.int32()), pa.array(to[better], pa.int32())], names=["w", "to"])

        moves = near.mapInArrow(run, "w int, to int").collect()  # at most one row per core word
        shared.destroy()
        classes = classes.copy()
        for w, to in moves:
            classes[w] = to
    return best[1], best[2]


# ---- classes of all other words -------------------------------------------------------------------------------------

def other_classes(chunks: DataFrame, dictionary: list[bytes], classes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``word, c, class`` of every word outside the core. Neighbours are gathered per task as pairs of class bytes, turned
    into a histogram where that is shorter, and summed word by word in a sorted stream."""
    core = len(classes) - 2
    smooth = counts + 0.5
    follow = np.log(smooth / smooth.sum(1, keepdims=True))  # class b, then class c
    precede = np.log(smooth / smooth.sum(0, keepdims=True))  # class c, then class b
    shared = chunks.sparkSession.sparkContext.broadcast((dictionary, classes.astype(np.uint8), follow, precede))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of_core, _, _ = shared.value
        names = pa.array(names, pa.binary())
        words, at, near, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            # equal words of several chunks get one number; numbers of the dictionary follow
            one = pa.concat_arrays(words).dictionary_encode() if words else pa.array([], pa.binary()).dictionary_encode()
            same, fresh = one.indices.to_numpy(), len(one.dictionary)
            number = np.concatenate(at)
            own = number >= 0
            number[own] = same[number[own]]
            number[~own] = fresh - 1 - number[~own]
            order = np.argsort(number, kind="stable")
            pairs, number = np.concatenate(near)[order], number[order]
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            lengths = np.diff(np.append(starts, len(number)))
            every = pa.concat_arrays([one.dictionary, names])
            few = lengths <= 64
            offsets = np.concatenate(([0], np.cumsum(2 * lengths[few]))).astype(np.int32)
            data = pairs[np.repeat(few, lengths)].tobytes()
            packed = pa.BinaryArray.from_buffers(pa.binary(), int(few.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([every.take(pa.array(number[starts[few]])), packed], names=["word", "near"])
            for k in np.flatnonzero(~few):
                table = _histogram(pairs[starts[k] : starts[k] + lengths[k]])
                yield pa.RecordBatch.from_arrays([every.take(pa.array(number[starts[k : k + 1]])), pa.array([table.tobytes()], pa.binary())], names=["word", "near"])
            words.clear(), at.clear(), near.clear()

        before = 0
        for row in _rows(batches):
            codes, places, sizes = _learning(row)
            others = codes >= core
            if not others.any():
                continue
            line, ends = _with_ends(of_core[np.minimum(codes, core)], sizes, END)
            texts = np.ones(len(line), bool)
            texts[ends] = False
            around = np.stack([np.concatenate(([END], line[:-1])), np.append(line[1:], END)], 1).astype(np.uint8)
            number = -1 - codes
            number[codes == _RARE] = places + before
            words.append(row["words"]), at.append(number[others]), near.append(around[texts][others])
            before += len(row["words"])
            held += int(others.sum())
            if held > 10 * FLUSH:
                yield from flush()
                before, held = 0, 0
        if held:
            yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, follow, precede = shared.value
        last, total = None, np.zeros(2 * CLASSES)

        def chosen(words: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            before, after = sums[:, :CLASSES], sums[:, CLASSES:]
            best = (after @ follow.T + before @ precede)[:, :END].argmax(1)
            return pa.RecordBatch.from_arrays([words, pa.array(before.sum(1).astype(np.int64)), pa.array(best, pa.int32())], names=["word", "c", "class"])

        for whole in batches:
            for batch in (whole.slice(k, 4_000) for k in range(0, whole.num_rows, 4_000)):
                words, near = batch.column(0), batch.column(1)
                new = np.ones(len(words), bool)
                new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
                of = np.cumsum(new) - 1
                lengths = np.array(pc.binary_length(near))
                short = lengths <= 128
                flat = np.frombuffer(b"".join(near.filter(pa.array(short)).to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
                row = np.repeat(of[short], lengths[short] // 2)[:, None]
                sums = np.bincount((row * 2 * CLASSES + flat + [0, CLASSES]).ravel(), minlength=(of[-1] + 1) * 2 * CLASSES).reshape(-1, 2 * CLASSES).astype(float)
                for k in np.flatnonzero(~short):
                    sums[of[k]] += np.frombuffer(near[int(k)].as_buffer(), np.int64)
                words = words.filter(pa.array(new))
                if last is not None and words[0].as_py() == last:
                    sums[0] += total
                elif last is not None:
                    yield chosen(pa.array([last], pa.binary()), total[None])
                yield chosen(words[:-1], sums[:-1])
                last, total = words[len(words) - 1].as_py(), sums[-1]
        if last is not None:
            yield chosen(pa.array([last], pa.binary()), total[None])

    gathered = chunks.select("trained", "sizes", "codes", "places", "words").mapInArrow(gather, "word binary, near binary").repartition("word").sortWithinPartitions("word")
    return gathered.mapInArrow(decide, "word binary, c long, class int")


def _histogram(pairs: np.ndarray) -> np.ndarray:
    """Counts of classes before, then after."""
    return np.bincount((pairs.astype(np.int64) + [0, CLASSES]).ravel(), minlength=2 * CLASSES)


# ---- the model ------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ClassModel:
    tokens: int  # N
    words: int  # V
    discount: float
    sizes: np.ndarray  # words of each class
    totals: np.ndarray  # occurrences of each class
    transitions: np.ndarray  # (CLASSES + 1, CLASSES); the last row is the history of an unknown word
    unknown: np.ndarray  # (CLASSES + 1): probability of an unknown word after each history
    of_class: np.ndarray  # of the words of the dictionary
    of_count: np.ndarray

    def emission(self, classes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """P(word | class) of known words."""
        return np.where(classes == END, 1.0, (c - self.discount) / np.maximum(self.totals[classes], 1))

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.words + 1))


def fit_transitions(counts: np.ndarray, tokens: int, words: int, discount: float, sizes: np.ndarray, totals: np.ndarray, *dictionary: np.ndarray) -> ClassModel:
    """``counts``: (CLASSES + 1, CLASSES) class bigrams, the last row after words seen once."""
    prior = totals / max(1, totals.sum())
    moves = (counts + PRIOR_WEIGHT * prior) / (counts.sum(1, keepdims=True) + PRIOR_WEIGHT)
    fresh = np.where(np.arange(CLASSES) == END, 0.0, discount * sizes / np.maximum(totals, 1))
    return ClassModel(tokens, words, discount, sizes, totals, moves, moves @ fresh, *dictionary)


RESOLVED = "ids array<long>, trained array<boolean>, sizes array<int>, codes binary, places binary, classes binary, counts binary"


def resolve(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks with class and count of each word of their own lists. ``known``: word, c, class of words outside the dictionary."""
    wanted = chunks.select("chunk", F.posexplode("words").alias("place", "word"))
    found = wanted.join(known, "word").groupBy("chunk").agg(F.collect_list(F.struct("place", "class", "c")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column(5)[k].as_py()
                classes, counts = np.full(n, UNKNOWN, np.uint8), np.zeros(n, np.int64)
                at, of, c = (batch.column(i)[k].values for i in (6, 7, 8))
                if at is not None:
                    at = at.to_numpy()
                    classes[at], counts[at] = of.to_numpy(), c.to_numpy()
                classes[counts == 1] += SINGLE
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(k, 1) for i in range(5)), pa.array([classes.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                    names=["ids", "trained", "sizes", "codes", "places", "classes", "counts"])

    whole = chunks.select("chunk", "ids", "trained", "sizes", "codes", "places", F.size("words").alias("n_words")).join(found, "chunk", "left")
    return whole.select("ids", "trained", "sizes", "codes", "places", "n_words", "found.place", "found.class", "found.c").mapInArrow(run, RESOLVED)


def _expanded(row: dict, of_class: np.ndarray, of_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class byte and count of every word of a chunk. ``of_class``, ``of_count``: those of the dictionary."""
    codes = row["codes"]
    rare = codes == _RARE
    line, c = np.empty(len(codes), np.uint8), np.empty(len(codes), np.int64)
    line[~rare], c[~rare] = of_class[codes[~rare]], of_count[codes[~rare]]
    line[rare], c[rare] = row["classes"][row["places"]], row["counts"][row["places"]]
    return line, c


def _histories(line: np.ndarray) -> np.ndarray:
    """The row of the transition table for the word before each; a text starts after the end of another."""
    state = np.where(line == UNKNOWN, CLASSES, line % SINGLE)
    return np.concatenate(([END], state[:-1]))


def count_transitions(resolved: DataFrame, of_class: np.ndarray, of_count: np.ndarray) -> np.ndarray:
    shared = resolved.sparkSession.sparkContext.broadcast((of_class, of_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES + 1, CLASSES), np.int64)
        for row in _rows(batches):
            sizes, mine = row["sizes"].astype(np.int64), row["trained"].astype(bool)
            line, _ = _with_ends(_expanded(row, *shared.value)[0][np.repeat(mine, sizes)], sizes[mine], END)
            if len(line):
                now, before = line % SINGLE, _histories(line)
                sums += np.bincount(before.astype(np.int64) * CLASSES + now, minlength=sums.size).reshape(sums.shape)
                after_single = np.flatnonzero(line >= SINGLE) + 1
                sums[CLASSES] += np.bincount(now[after_single], minlength=CLASSES)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["at", "n"])

    return _square(resolved.drop("ids").mapInArrow(run, "at long, n long"), CLASSES + 1)


SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(resolved: DataFrame, model: ClassModel, n_ends: int) -> DataFrame:
    shared = resolved.sparkSession.sparkContext.broadcast(model)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for row in _rows(batches):
            sizes = row["sizes"].astype(np.int64)
            line, c = _expanded(row, model.of_class, model.of_count)
            (line, ends), (c, _) = _with_ends(line, sizes, END), _with_ends(c, sizes, n_ends)
            base = model.base(c)
            if model.tokens:
                before, new = _histories(line), line == UNKNOWN
                now = np.where(new, END, line % SINGLE).astype(np.int64)
                p = np.where(new, model.unknown[before], model.transitions[before, now] * model.emission(now, c))
                p = (1 - MIX) * p + MIX * base
            else:
                p = base
            starts = np.append(0, ends[:-1] + 1)
            sums = [np.add.reduceat(v, starts) for v in ((c > 0).astype(np.int64), np.log10(base), np.log10(p))]
            yield pa.RecordBatch.from_arrays([
                row["ids"], pa.array(~row["trained"].astype(bool)), pa.array(sizes + 1), pa.array(sums[0]),
                pa.array(np.full(len(sizes), model.tokens)), pa.array(sums[1]), pa.array(sums[2])], names=names)

    return resolved.mapInArrow(run, SCORED)


def fit(docs: DataFrame, dictionary_size: int = DICTIONARY, core_size: int = CORE) -> tuple[DataFrame, ClassModel, int]:
    """``docs``: id, held, text. Returns the texts as classes, the model, and how often the end was seen."""
    learning = docs.where(~F.col("held"))
    counted = materialize(count_words(learning), "zstd")
    n_ends = learning.count()
    totals = counted.agg(F.count(F.lit(1)), F.sum("c"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    tokens, words = (totals[1] or 0) + n_ends, totals[0] + (n_ends > 0)
    discount = min(0.95, max(0.05, totals[2] / max(1, totals[2] + 2 * totals[3])))
    top = most_frequent(counted, dictionary_size)
    dictionary, core = [w for w, _ in top], min(core_size, len(top))

    chunks = materialize(encode_chunks(docs, dictionary), "zstd")
    classes, counts = exchange(materialize(core_neighbours(chunks, core)), core)
    others = materialize(other_classes(chunks, dictionary, classes, counts), "zstd")
    # classes of the dictionary: at most dictionary_size rows
    of_class, of_count = np.zeros(max(1, len(top)), np.uint8), np.array([c for _, c in top] or [0], np.int64)
    of_class[:core] = classes[:core]
    number = {w: i for i, w in enumerate(dictionary)}
    frequent = others.sparkSession.createDataFrame([(w,) for w in dictionary[core:]], "word binary")
    for word, at in others.join(F.broadcast(frequent), "word").select("word", "class").collect():
        of_class[number[bytes(word)]] = at
    resolved = materialize(resolve(chunks, others), "zstd")
    sizes, sums = _class_sizes(others, of_class[:core], of_count[:core])
    sizes[END], sums[END] = 1, n_ends
    of_class[(of_count == 1) & (len(top) > 0)] += SINGLE
    moves = count_transitions(resolved, of_class, of_count)
    return resolved, fit_transitions(moves, tokens, words, discount, sizes, sums, of_class, of_count), n_ends


def most_frequent(counted: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words, by falling counts: all words above a count that sixteenths of octaves tell, so that no
    whole sort is needed and only these words reach the driver."""
    level = F.floor(16 * F.log2("c"))
    total, least = 0, None
    for at, n in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 1,024 levels at most
        total += n
        if total > most:
            break
        least = at
    if least is None:
        return []
    return sorted(((bytes(w), c) for w, c in counted.where(level >= least).select("word", "c").collect()), key=lambda r: (-r[1], r[0]))


def _class_sizes(others: DataFrame, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes, sums = np.bincount(classes, minlength=CLASSES).astype(float), np.bincount(classes, counts, CLASSES)
    for at, n, c in others.groupBy("class").agg(F.count(F.lit(1)), F.sum("c")).collect():
        sizes[at] += n
        sums[at] += c
    return sizes, sums


def score(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", dictionary_size: int = DICTIONARY, core_size: int = CORE) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    docs = documents.select(
        F.col(id_column).cast("long").alias("id"), held_out(F.col(id_column)).alias("held"), F.col(text_column).cast("string").alias("text"))
    resolved, model, n_ends = fit(docs, dictionary_size, core_size)
    return score_texts(resolved, model, n_ends).withColumnRenamed("id", id_column)
