"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two neighbouring symbols if their pair stands inside some vocabulary token. Every other pair marks
a certain cut: the fragments between cuts are encoded independently and concatenated. Fragments are much fewer than
words, so they are kept in a bounded cache of each Python worker.

Rules: a null text counts as empty; an empty text has no ids and decodes to an empty text; rows are independent, so
repeated rows give repeated results; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from riskflow.llm.tables import slices

#: The last symbol of a word is a symbol of its own; it is held as one character of this private range.
WORD_END = 0xE000
#: Entries of each of a worker's caches before it starts anew.
CACHE_ENTRIES = 400_000
#: Marks that stand alone after a word: no piece of letters takes them in.
_MARKS = frozenset(".,;:!?|")
#: Control characters that Python alone counts as white space.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: All but the blocks that Unicode versions class alike.
_UNUSUAL = re.compile("[^\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


class ForcedBoundaryBpe:
    """Encodes as the tokenizer file says: NFC, lower case, split by the file's pattern, bytes, merges by rank."""

    def __init__(self, spec: dict, library: Tokenizer):
        model = spec["model"]
        suffix = model["end_of_word_suffix"]

        def inner(token: str) -> str:
            if suffix and token.endswith(suffix) and token != suffix:
                token = token[: -len(suffix)]
                return token[:-1] + chr(WORD_END + ord(token[-1]))
            return token

        self.ids = {inner(token): i for token, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*model["vocab"].values(), *self.added.values()]))
        for token, i in [*model["vocab"].items(), *self.added.items()]:
            self.tokens[i] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(inner(a), inner(b)): rank for rank, (a, b) in enumerate(pairs)}
        #: neighbouring symbols inside any token; all other pairs are certain cuts
        self.joined = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.byte_symbols = dict(enumerate(_byte_symbols()))
        self.packed = {symbols: _packed([i]) for symbols, i in self.ids.items()}
        self.library = library
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.fragments: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        parts = self.special.split(text)
        return b"".join(_packed([self.added[p]]) if p in self.added else self._ordinary(p) for p in parts)

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: tokens are joined by one space, special ones included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _ordinary(self, text: str) -> bytes:
        if any(map(text.__contains__, _CONTROLS)) or not text.isascii() and _UNUSUAL.search(text):
            return b"".join(map(self._word, self._library_pieces(text)))
        # the pattern's pieces, NFC and lower case never reach over white space, so white space splits first
        known, new = self.chunks.get, self._chunk
        return b"".join([known(chunk) or new(chunk) for chunk in text.split()])

    def _chunk(self, chunk: str) -> bytes:
        return _kept(self.chunks, chunk, self._new_chunk(chunk))

    def _new_chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable():  # its bytes are their own symbols
            plain = chunk.lower()
            if plain.isalpha():
                return self._word(plain)
            if plain[:-1].isalpha() and plain[-1] in _MARKS:
                return self._word(plain[:-1]) + self._word(plain[-1])
            return b"".join(map(self._word, self.pieces.findall(plain)))
        # the sigma rule of str.lower looks at neighbours; the tokenizer lowers each character alone
        plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return b"".join([self._word(piece.encode().decode("latin-1").translate(self.byte_symbols)) for piece in self.pieces.findall(plain)])

    def _library_pieces(self, text: str) -> list[str]:
        """Characters that Unicode versions class differently: the tokenizer's own normalizer and splitter decide."""
        plain = self.library.normalizer.normalize_str(text)
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _word(self, symbols: str) -> bytes:
        ids = self.words.get(symbols)
        if ids is not None:
            return ids
        ended, joined, out, start = symbols[:-1] + chr(WORD_END + ord(symbols[-1])), self.joined, [], 0
        for cut in range(1, len(ended)):
            if ended[cut - 1 : cut + 1] not in joined:
                out.append(self._fragment(ended[start:cut]))
                start = cut
        out.append(self._fragment(ended[start:]))
        return _kept(self.words, symbols, out[0] if len(out) == 1 else b"".join(out))

    def _fragment(self, symbols: str) -> bytes:
        ids = self.fragments.get(symbols)
        if ids is None:
            parts = self._merged(symbols) if len(symbols) > 32 else self._merged_short(symbols)
            ids = b"".join(map(self.packed.__getitem__, parts))
            if len(symbols) <= 6:  # longer ones hardly come back apart from their word
                _kept(self.fragments, symbols, ids)
        return ids

    def _merged_short(self, symbols: str) -> list[str]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        parts, ranks, never = list(symbols), self.ranks, len(self.ranks)
        found = [ranks.get(pair, never) for pair in zip(parts, parts[1:])]
        while found and (least := min(found)) < never:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), never)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), never)
        return parts

    def _merged(self, symbols: str) -> list[str]:
        """The same for long fragments in n log n steps."""
        parts: list[str | None] = list(symbols)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ranks, last = self.ranks, len(parts)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(last - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= last or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < last and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]


def _kept(cache: dict[str, bytes], key: str, ids: bytes) -> bytes:
    if len(key) <= 64:
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        cache[key] = ids
    return ids


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _byte_symbols() -> list[str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBpe:
    with open(path, encoding="utf-8") as file:
        return ForcedBoundaryBpe(json.load(file), Tokenizer.from_file(path))


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """``id, n_tokens, ids`` (packed little-endian unsigned 32-bit), and with ``with_text`` what the ids decode to as
    ``decoded``. ``vocabulary`` is a tokenizer file that every executor has at this path (part of the installation)."""
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [bpe.encode(text) for text in part.column(1).to_pylist()]
                decoded = [bpe.decode(i) if with_text else None for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    coded = source.mapInArrow(run, schema)
    kept = [F.col("id").alias(id_column), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"]
    return coded.select(*kept, *(["decoded"] if with_text else []))


def decode(coded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id, decoded`` from packed ids; null ids decode to an empty text."""
    source = coded.select(F.col(id_column).alias("id"), F.coalesce(F.col(ids_column), F.lit(b"")).alias("ids"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(bpe.decode, part.column(1).to_pylist()), pa.string())], names=["id", "decoded"])

    return source.mapInArrow(run, schema).select(F.col("id").alias(id_column), "decoded")
