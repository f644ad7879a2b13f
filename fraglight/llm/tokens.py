"""Problem 8: token ids of whole texts by a public byte-level BPE vocabulary.

Each piece of a text (the vocabulary's public split pattern) is encoded by backtracking over longest token matches:
an Aho-Corasick automaton finds every token that occurs in the piece in one pass, the longest at the current place is
tried first, and it stands only if the merges of byte-pair encoding could leave it beside its left neighbour. That
check needs a table of which tokens merge, and how each token was merged. The result equals that of merging pair by
pair, in time linear in the piece.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie; every function takes another place.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it forgets them all, so its memory stays bounded.
REMEMBERED = 400_000


class Vocabulary:
    """A rank file with the tables that encoding and decoding need."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.split = regex.compile(PATTERN).findall
        self.rank = ranks
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = [len(t) for t in tokens]
        #: Decoding: all tokens one after the other, token k at offsets[k]:offsets[k + 1].
        self.bytes = b"".join(tokens)
        self.offsets = array("q", [0])
        for n in self.lengths:
            self.offsets.append(self.offsets[-1] + n)
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(self.size)]
        self.shorter: list[int] = [-1] * self.size
        for k, token in enumerate(tokens):
            for n in range(len(token) - 1, 0, -1):
                if (p := ranks.get(token[:n])) is not None:
                    self.shorter[k] = p
                    break
            for n in range(1, len(token)):
                a, b = ranks.get(token[:n], k), ranks.get(token[n:], k)
                if a < k and b < k and self._stands(a, b):
                    self.parts[k] = (a, b)
                    self.merged[a, b] = k
                    break
        self.automaton = ahocorasick.Automaton()
        for k, token in enumerate(tokens):
            if token:
                self.automaton.add_word(token.decode("latin-1"), k)
        self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, array] = {}

    def _stands(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves left and right side by side: undo their merges from the latest on, and see
        that no pair across the border would have been merged before."""
        parts, merged, last = self.parts, self.merged, self.size
        while True:
            if merged.get((left, right), last) < last:
                return False
            if left > right:
                last, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                last, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                last, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                last, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def _fits(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 4 * REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self._stands(left, right)
        return known

    def _piece(self, piece: bytes) -> array:
        if (whole := self.rank.get(piece)) is not None:
            return array("i", [whole])
        n, lengths = len(piece), self.lengths
        longest = array("i", bytes(4 * n))
        for end, k in self.automaton.iter(piece.decode("latin-1")):
            longest[end - lengths[k] + 1] = k  # ends come in order, so the last is the longest
        dead = bytearray(n + 1)
        out = array("i")
        at, k = 0, longest[0]
        while True:
            end = at + lengths[k]
            if not dead[end] and (not out or self._fits(out[-1], k)):
                out.append(k)
                at = end
                if at == n:
                    return out
                k = longest[at]
            elif self.shorter[k] >= 0:
                k = self.shorter[k]
            else:
                dead[at] = 1
                k = out.pop()
                at -= lengths[k]

    def encode_into(self, text: str, out: array) -> None:
        pieces = self._pieces
        for piece in self.split(text):
            ids = pieces.get(piece)
            if ids is None:
                if len(pieces) > REMEMBERED:
                    pieces.clear()
                ids = self._piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 64:
                    pieces[piece] = ids
            out.extend(ids)

    def encode(self, text: str) -> list[int]:
        self.encode_into(text, out := array("i"))
        return list(out)

    def decode(self, ids) -> str:
        whole, offsets = self.bytes, self.offsets
        return b"".join(whole[offsets[k] : offsets[k + 1]] for k in ids).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}
_sent: set[tuple[str, str]] = set()


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker, from the path or, where it isn't there, from what the driver sent."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _loaded[path]


def send(spark: SparkSession, path: str) -> None:
    """Lets executors without the file have the driver's."""
    if os.path.exists(path) and (spark.sparkContext.applicationId, path) not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add((spark.sparkContext.applicationId, path))


def encode_column(
    df: DataFrame,
    key: str,
    text: str,
    counts_only: bool = False,
    name: str = "byte_bpe_50k",
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """(key, ids array<int>) of every row, or (key, n_tokens bigint). Null and empty texts have no ids: an empty list, or
    0. Strings that look like special tokens are ordinary text. A null key stays null; other columns are not carried, so
    none can clash. The rows keep their partitions: no shuffle."""
    path = f"{tokenizers}/{name}.tiktoken"
    send(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                flat, offsets = array("i"), array("i", [0])
                for value in part.column(1).to_pylist():
                    if value:
                        words.encode_into(value, flat)
                    offsets.append(len(flat))
                if counts_only:
                    n = pa.array(offsets, pa.int64())
                    out = pa.compute.subtract(n[1:], n[:-1])
                else:
                    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["k", "v"])

    import pyarrow.compute  # noqa: F401

    made = df.select(key, text).mapInArrow(run, f"k {kind}, v {'bigint' if counts_only else 'array<int>'}")
    return made.toDF(key, "n_tokens" if counts_only else "ids")


def decode_column(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, text): the texts that the ids stand for. A null or empty list gives the empty text."""
    path = f"{tokenizers}/{name}.tiktoken"
    send(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [words.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "v"])

    return df.select(key, ids).mapInArrow(run, f"k {kind}, v string").toDF(key, "text")
