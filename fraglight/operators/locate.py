"""Candidate pairs of texts and needles by shared grams, so that a hot group isn't expanded into all its pairs.

A needle has its first minimizer as a key: the least hash of the first so many grams. A text that holds the needle holds that
window, so it has the same minimizer among its own. There are three lengths of windows; a text has keys for those that
needles of its group ask for, so short needles, for which every gram counts, cost nothing where there are none. Needles
below a gram, which match almost any text, are tried once for each distinct one on the texts of their group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglight.functions.text import WHITE, stripped

#: Length of grams and number of them in a window, for needles of at least gram + window - 1 characters.
CLASSES = [(12, 8), (6, 5), (6, 1)]
SHORT = 6
_BLANK = re.compile(f"[{WHITE},]+")


def _hashes(text: str, n: int) -> np.ndarray:
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.full(max(0, len(chars) - n + 1), n, np.uint64)
    for k in range(n if len(h) else 0):
        h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _minimizers(text: str, gram: int, window: int) -> np.ndarray:
    h = _hashes(text, gram) ^ np.uint64(window)
    return np.lib.stride_tricks.sliding_window_view(h, window).min(1) if len(h) >= window else h[:0]


def class_of(size: int) -> int:
    """The class of a needle by its length."""
    return next(k for k, (gram, window) in enumerate(CLASSES) if size >= gram + window - 1)


def text_keys(text: str, asked: int) -> np.ndarray:
    """The keys of a text for the classes whose bits are asked for."""
    text = _BLANK.sub("", text)
    return np.unique(np.concatenate([np.empty(0, np.uint64), *(_minimizers(text, *c) for k, c in enumerate(CLASSES) if asked >> k & 1)])).view(np.int64)


def needle_keys(needle: str, _) -> np.ndarray:
    needle = _BLANK.sub("", needle)
    gram, window = CLASSES[class_of(len(needle))]
    return _minimizers(needle[: gram + window - 1], gram, window).view(np.int64)


def _keyed(df: DataFrame, group: str, key: str, text: str, asked: F.Column, keys, name: str) -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [keys(t, k) for t, k in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                flat = np.concatenate(found) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(flat)], ["g", name, "gram"])

    return df.select(group, key, text, asked.alias("asked")).mapInArrow(run, f"g {kinds[group]}, {name} {kinds[key]}, gram bigint")


def candidates(texts: DataFrame, needles: DataFrame, group: str, text_id: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """(text_id, needle_id) of the pairs of a group whose text may hold the needle, white space and commas aside: every pair that
    matches, and few others. Rows with a null group, text or needle, and blank needles, are in none."""
    texts = texts.filter(F.col(group).isNotNull() & F.col(text).isNotNull())
    needles = needles.filter(F.col(group).isNotNull() & F.col(needle).isNotNull())
    size = F.length(stripped(F.col(needle)))
    long = needles.filter(size >= SHORT)
    bit = F.lit(1 << len(CLASSES) - 1)
    for k in range(len(CLASSES) - 2, -1, -1):
        bit = F.when(size >= sum(CLASSES[k]) - 1, 1 << k).otherwise(bit)
    asked = long.groupBy(group).agg(F.bit_or(bit).alias("asked"))
    left = _keyed(texts.select(group, text_id, text).join(asked, group), group, text_id, text, F.col("asked"), text_keys, "t")
    right = _keyed(long, group, needle_id, needle, F.lit(0), needle_keys, "n")
    keyed = left.join(right, ["g", "gram"]).select("t", "n")
    tiny = needles.filter((size > 0) & (size < SHORT)).select(group, F.col(needle_id).alias("n"), stripped(F.col(needle)).alias("w"))
    each = texts.select(group, F.col(text_id).alias("t"), stripped(F.col(text)).alias("h")).join(tiny.select(group, "w").distinct(), group)
    held = each.filter(F.contains("h", F.col("w"))).select(group, "t", "w").join(tiny, [group, "w"]).select("t", "n")
    return keyed.unionAll(held).select(F.col("t").alias(text_id), F.col("n").alias(needle_id))
