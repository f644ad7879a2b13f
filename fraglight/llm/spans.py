"""Problem 1: long exact spans shared between records.

A paragraph is a window of `span` characters, at every offset of a record. Its signature are minima of hashes over its
k-character shingles, in bands of one minimum; bands_for() tunes their number to a recall for paragraphs of a Jaccard
similarity. Paragraphs that are equal word for word have a similarity of 1, for which one band has a recall of 1.
Neighbouring windows mostly share their least shingle, so a record has about one band key for each (span - k) / 2
characters and band, not one for each window; such a stretch of windows is one row here, its context the characters that
they cover.

Colliding paragraphs are joined on the band key, then verified:
* contexts are equal as a whole (128 bits of hash over all their characters) in two records: all their windows are shared;
* contexts differ, as at the ends of a shared run: they are aligned at the common shingle, and each window must have an
  edit distance of 0 to the one beside it; where a key has many contexts, windows are looked up by hash instead, which
  stays linear.

Removals are clustered: records that share windows are grouped by components, and overlapping spans are merged within
each record of a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraglight.llm.components import components
from fraglight.sources.tables import staged

SPAN, SHINGLE = 160, 40
#: Contexts of a band key up to which they are compared with each other; beyond, windows are looked up by their hash.
COMPARED = 24
#: Characters that a worker handles at once, and of a piece of a text to which contexts are joined.
BLOCK, PIECE = 1 << 19, 1 << 13
#: Recall that bands are tuned to, for paragraphs of a similarity.
RECALL, SIMILARITY = 0.9999, 1.0
_WHERE = np.uint64((1 << 24) - 1)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def bands_for(recall: float = RECALL, similarity: float = SIMILARITY, rows: int = 1) -> int:
    """The least number of bands of so many minima by which a pair of paragraphs of the similarity collides with the recall."""
    missed = 1 - similarity**rows
    return 1 if missed <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n, base, np.uint64))])


class _Rolling:
    """Hashes of any stretch of a character array, from prefix sums modulo 2^64."""

    def __init__(self, chars: np.ndarray, base: int, salt: int):
        self.forward = _powers(base, len(chars))
        back = _powers(pow(base, -1, 1 << 64), len(chars))
        self.back = back
        self.sums = np.concatenate([[_U(0)], np.cumsum(_mix(chars.astype(np.uint64) + _U(salt)) * self.forward[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


_BASES = ((0x9E3779B97F4A7C15 | 1, 0x1234567), (0xC2B2AE3D27D4EB4F | 1, 0x89ABCDE))


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of `width`."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def stretches(texts: list[str], span: int, shingle: int, band: int = 0) -> tuple[np.ndarray, ...]:
    """Stretches of windows with the same least shingle by a band's order, of all texts: (text number, first window, windows, offset of the
    shingle from the first window, hash of the shingle, two hashes of the context)."""
    keep = [i for i, t in enumerate(texts) if len(t) >= span]
    if not keep:
        return tuple(np.empty(0, np.int64) for _ in range(7))
    parts = [_characters(texts[i]) for i in keep]
    sizes = np.array([len(p) for p in parts])
    chars = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = len(chars)
    one, two = (_Rolling(chars, *x) for x in _BASES)
    at = np.arange(n - shingle + 1)
    hashes = one.of(at, at + shingle)
    if band:
        hashes = _mix(hashes + _U(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    if n > int(_WHERE):
        order = None  # a text beyond 2^24 characters comes alone, in two arrays instead of one packed
        least = _far_minima(_mix(hashes), span - shingle + 1)
    else:
        order = (_mix(hashes) & ~_WHERE) | (_WHERE - at.astype(np.uint64))
        least = (_WHERE - (_sliding_min(order, span - shingle + 1) & _WHERE)).astype(np.int64)
    text_of = np.repeat(np.arange(len(keep)), sizes)[: n - span + 1]
    window = np.arange(n - span + 1)
    inside = window + span <= (starts + sizes)[text_of]
    window, least, text_of = window[inside], least[inside], text_of[inside]
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    begin, place, who = window[first], least[first], text_of[first]
    end = begin + count - 1 + span
    shape = _mix((place - begin).astype(np.uint64) * _U(1 << 32) + count.astype(np.uint64))
    c1, c2 = one.of(begin, end) ^ shape, two.of(begin, end)
    return np.array(keep)[who], begin - starts[who], count, place - begin, hashes[place].view(np.int64), c1.view(np.int64), c2.view(np.int64)


def _far_minima(x: np.ndarray, width: int) -> np.ndarray:
    """As the packed minima: place of the least value of each window, the last of equals; block by block."""
    out, step = [], 1 << 22
    for a in range(0, len(x) - width + 1, step):
        part = x[a : a + step + width - 1]
        at = np.arange(len(part), dtype=np.uint64)
        out.append((_WHERE - (_sliding_min((part & ~_WHERE) | (_WHERE - at), width) & _WHERE)).astype(np.int64) + a)
    return np.concatenate(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Rows of (record, text), about BLOCK characters at a time; a longer text comes alone and whole."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and size + len(t) > BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(k)
            texts.append(t)
            size += len(t)
        if texts:
            yield ids, texts


def _find_stretches(records: DataFrame, span: int, shingle: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, texts), band in ((x, b) for x in _blocks(batches) for b in range(bands)):
            who, begin, count, place, key, c1, c2 = stretches(texts, span, shingle, band)
            rec = np.array(ids, np.int64)[who] if len(who) else who
            yield pa.RecordBatch.from_arrays(
                [pa.array(rec), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(place.astype(np.int16)), pa.array(key), pa.array(c1), pa.array(c2)],
                ["rec", "begin", "windows", "place", "band", "c1", "c2"],
            )

    return records.mapInArrow(run, "rec bigint, begin int, windows smallint, place smallint, band bigint, c1 bigint, c2 bigint")


def distances(a: np.ndarray, b: np.ndarray, shift: int, span: int) -> np.ndarray:
    """Edit distance, in characters replaced, of each window of a to the window of b at `shift` from it; span + 1 where b has none."""
    low, high = max(0, -shift), min(len(a), len(b) - shift)
    out = np.full(max(0, len(a) - span + 1), span + 1)
    if high - low >= span:
        changed = np.concatenate([[0], np.cumsum(a[low:high] != b[low + shift : high + shift])])
        out[low : high - span + 1] = changed[span:] - changed[:-span]
    return out


def _compare(members: list, span: int) -> list[list[tuple[int, int, int]]]:
    """For each context of one band key (least and greatest record, place of the shingle, windows, text): the runs of its
    windows, as (first, number, record), that stand in a context of another record."""
    texts = [_characters(m["text"]) for m in members]
    found: list[list[tuple[int, int, int]]] = [[] for _ in members]
    for i, x in enumerate(members):
        for j, y in enumerate(members):
            if i == j or x["r0"] == y["r0"] == x["r1"] == y["r1"]:
                continue
            same = np.flatnonzero(distances(texts[i], texts[j], y["place"] - x["place"], span) == 0)
            for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:
                found[i].append((int(run[0]), len(run), y["r0"] if y["r0"] != x["r0"] else y["r1"]))
    return found


def _partly_shared(contexts: DataFrame, span: int) -> DataFrame:
    """contexts (band, c1, c2, r0, r1, place, windows, text, rivals) -> (band, c1, c2, r0, low, windows, hub): runs of
    shared windows, and a record that has them too; of a context of several records, which are linked and shared as a whole,
    one run for each such record."""
    few = contexts.filter(F.col("rivals") <= COMPARED).groupBy("band").agg(
        F.collect_list(F.struct("c1", "c2", "r0", "r1", "place", "windows", "text")).alias("members")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for band, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for m, runs in zip(members, _compare(members, span)):
                    runs = set(runs) if m["r0"] == m["r1"] else {hub: (low, n, hub) for low, n, hub in runs}.values()
                    rows += [(band, m["c1"], m["c2"], m["r0"], low, n, hub) for low, n, hub in runs]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["band", "c1", "c2", "r0", "low", "windows", "hub"])

    compared = few.mapInArrow(compare, "band bigint, c1 bigint, c2 bigint, r0 bigint, low int, windows int, hub bigint")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            for band, c1, c2, r0, r1, n, text in zip(*cols):
                chars = _characters(text)
                low = np.arange(n)
                h1, h2 = (_Rolling(chars, *x).of(low, low + span).view(np.int64) for x in _BASES)
                same = lambda v: pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([same(band), same(c1), same(c2), same(r0), same(r1), pa.array(low.astype(np.int32)), pa.array(h1), pa.array(h2)], ["band", "c1", "c2", "r0", "r1", "low", "h1", "h2"])

    each = (
        contexts.filter(F.col("rivals") > COMPARED)
        .select("band", "c1", "c2", "r0", "r1", "windows", "text")
        .mapInArrow(windows, "band bigint, c1 bigint, c2 bigint, r0 bigint, r1 bigint, low int, h1 bigint, h2 bigint")
    )
    shared = each.groupBy("h1", "h2").agg(F.min("r0").alias("x"), F.max("r1").alias("y")).filter("x <> y")
    hub = F.when(F.col("x") == F.col("r0"), F.col("y")).otherwise(F.col("x")).alias("hub")
    looked_up = each.join(shared, ["h1", "h2"]).groupBy("band", "c1", "c2", "r0", hub, F.when(F.expr("r0 = r1"), F.col("low"))).agg(F.min("low").alias("low"))
    return compared.unionAll(looked_up.select("band", "c1", "c2", "r0", "low", F.lit(1).alias("windows"), "hub"))


def _pieces(records: DataFrame, span: int) -> DataFrame:
    """(rec, piece, text): texts cut so that each context lies in the piece in which it begins."""
    begin = F.sequence(F.lit(0), F.length("text") - 1, F.lit(PIECE))
    cut = records.select("rec", "text", F.explode(begin).alias("at"))
    return cut.select("rec", F.expr(f"at div {PIECE}").cast("int").alias("piece"), F.substr("text", F.col("at") + 1, F.lit(PIECE + 2 * span)).alias("text"))


def _shared_stretches(records: DataFrame, span: int, shingle: int, bands: int) -> DataFrame:
    """(rec, s, e, hub) of characters in shared windows, some of them overlapping, and a record that has them too."""
    records = records.filter(F.length("text") >= span)
    found = staged(_find_stretches(records, span, shingle, bands), "stretches")
    contexts = found.groupBy("band", "c1", "c2").agg(F.min("rec").alias("r0"), F.max("rec").alias("r1"))
    bands = contexts.groupBy("band").agg(F.min("r0").alias("x"), F.max("r1").alias("y"), F.count("*").alias("rivals"), F.max(F.expr("r0 = r1")).alias("any_lone"), F.max("r0").alias("z"))
    bands = bands.filter("x <> y").withColumn("open", F.expr("any_lone or x <> z"))
    live = staged(contexts.join(bands, "band").select("band", "c1", "c2", "r0", "r1", "rivals", "open"), "contexts")
    whole = found.join(live.filter("r0 <> r1").select("band", "c1", "c2", "r0"), ["band", "c1", "c2"])
    whole = whole.select("rec", F.col("begin").alias("s"), (F.col("begin") + F.col("windows") - 1 + span).alias("e"), F.col("r0").alias("hub"))

    # Bands with a context that only one record has, or with contexts that nothing links so far: compare them, one holder each.
    open_ = live.filter("open").select("band", "c1", "c2", "r0", "r1", "rivals")
    holders = found.join(open_, ["band", "c1", "c2"]).filter("rec = r0").dropDuplicates(["band", "c1", "c2"])
    texts = holders.withColumn("piece", F.expr(f"begin div {PIECE}").cast("int")).join(_pieces(records, span), ["rec", "piece"]).select(
        "band", "c1", "c2", "r0", "r1", "rivals", "place", "windows", F.expr(f"substring(text, begin % {PIECE} + 1, windows - 1 + {span})").alias("text"),
    )
    partly = staged(_partly_shared(staged(texts, "open"), span), "partly")
    ends = found.join(partly, ["band", "c1", "c2"]).filter("rec = r0").select(
        "rec", (F.col("begin") + F.col("low")).alias("s"), (F.col("begin") + F.col("low") + partly["windows"] - 1 + span).alias("e"), "hub"
    )
    return whole.unionAll(ends)


def merged_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key, s, e) with overlapping and touching spans of a key made one."""
    order = Window.partitionBy(*key).orderBy("s", "e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("reach", F.max("e").over(before))
        .withColumn("run", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(order))
        .groupBy(*key, "run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("run")
    )


def shared_spans(records: DataFrame, span: int = SPAN, shingle: int = SHINGLE, bands: int | None = None) -> DataFrame:
    """records (rec bigint, text string) -> (rec, cluster, s, e): the maximal runs of characters that lie in a window of `span`
    characters which stands verbatim in another record, and the least record of the component of records that share windows.

    Rows with a null rec or text give nothing, nor do texts shorter than `span`. Rows of the same rec are one record,
    so a record that is there twice shares nothing with itself; a run repeated inside one record only isn't shared either.
    Offsets are code points. Other columns are ignored; an empty table gives an empty one."""
    records = records.select("rec", "text").filter("rec is not null and text is not null")
    spans = staged(_shared_stretches(records, span, shingle, bands or bands_for()).distinct(), "spans")
    roots = components(spans.select("rec", "hub").distinct(), "rec", "hub").withColumnRenamed("node", "rec").withColumnRenamed("root", "cluster")
    return merged_spans(spans.select("rec", "s", "e").distinct().join(roots, "rec"), ["cluster", "rec"])


def shared_clusters(records: DataFrame, span: int = SPAN, shingle: int = SHINGLE) -> DataFrame:
    """records (rec, text) -> (rec, cluster, shared): every record with a shared span, the least record of its component,
    and how many of its characters are shared. Nulls and short texts as in shared_spans."""
    return shared_spans(records, span, shingle).groupBy("rec", "cluster").agg(F.sum(F.col("e") - F.col("s")).alias("shared"))
