"""Problem 3: groups of near-duplicate records, also far apart in order and with small edits.

MinHash: each text is the set of its five-character substrings after formatting is taken off; 80 universal hash minima
of the set make 20 bands of 4. Texts of a band bucket are candidates. Candidates pass the verification of signatures (the
low bits of 64 minima) and then of the exact Jaccard similarity, and the links are grouped by connected components.

No bucket is expanded into all pairs. First each member is compared with the least and the greatest member of its bucket.
Once components are known, buckets of one component need no more. Members of large buckets with several meet some more
members, drawn by hash, which brings most of a component together. In buckets that still have several components, small
ones compare members of different components; the texts of large ones, which mostly share some common passage, are joined
by their rare substrings instead: of two sets with a similarity of t the rarest (1 - t) of the larger and (1 - t) / (1 + t)
of the smaller have one in common. That loses no link, and texts whose common part is below the threshold meet no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglight.llm.components import components
from fraglight.sources.tables import discard, staged

BANDS, ROWS, CHARACTERS = 20, 4, 5
#: Equal low bits among 64 below which a pair of signatures can't come from a similarity of the threshold (4 sigma).
SIGMAS = 4.0
#: Members of a bucket up to which those of different components are compared with each other.
SMALL = 32
#: Times that members of larger ones meet a member drawn by hash.
ROUNDS = 2
#: Texts or pairs that a worker handles at once: their hashes stay in the cache.
BLOCK = 125


def formatting_off(column: str) -> F.Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"[^\p{L}\p{N}]+", ""))


def _shingle_keys(texts: list[str], n: int) -> np.ndarray:
    """Distinct n-character substrings of each text, sorted: text number and 32-bit hash in one number. A text shorter than n
    is its own only substring."""
    texts = [t if len(t) >= n else t.ljust(n, "\0") for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(chars) - n + 1), np.uint64)
    for k in range(n):
        h *= np.uint64(0x100000001B3)
        h += chars[k : len(h) + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h >>= np.uint64(32)
    h |= np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(32), sizes)[: len(h)]
    inside = np.ones(len(h), bool)
    for k in range(1, n):
        inside[np.cumsum(sizes)[:-1] - k] = False
    both = np.sort(h[inside])
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    return both[new]


def _shingle_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as (text number, hash)."""
    both = _shingle_keys(texts, n)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    return draw.integers(1, 1 << 32, hashes, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, hashes, np.uint32)


def minima(texts: list[str], n: int, hashes: int) -> np.ndarray:
    """(texts, hashes) minima of x -> a * x + b modulo 2^32."""
    owner, x = _shingle_hashes(texts, n)
    begin = np.searchsorted(owner, np.arange(len(texts)))
    a, b = _universal(hashes)
    out = np.empty((hashes, len(texts)), np.uint32)
    y, high = np.empty_like(x), np.empty_like(x)
    for k in range(hashes):
        np.multiply(x, a[k], out=y)
        y += b[k]
        y ^= np.right_shift(y, np.uint32(15), out=high)
        np.minimum.reduceat(y, begin, out=out[k])
    return out.T.copy()


def _band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(low), bands), np.uint64)
    parts = low[:, : bands * rows].reshape(len(low), bands, rows).astype(np.uint64)
    for k in range(rows):
        key = (key ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return (key * np.uint64(64) + np.arange(bands, dtype=np.uint64)).view(np.int64) if bands <= 64 else key.view(np.int64)


def _signed(texts: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """texts (node, text, salt) -> (node, text, bits, keys): signature and band keys; salt keeps buckets of different kinds apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                low = minima(part.column(1).to_pylist(), n, bands * rows)
                bits = np.packbits((low[:, :64] & 1).astype(np.uint8), axis=1).view(">i8").astype(np.int64).ravel()
                keys = _band_keys(low, bands, rows) ^ part.column(2).to_numpy(zero_copy_only=False)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits), lists], ["node", "text", "bits", "keys"])

    return texts.mapInArrow(run, "node bigint, text string, bits bigint, keys array<bigint>")


def jaccard(pairs: list[tuple[str, str]], n: int) -> np.ndarray:
    """Exact similarity of the sets of n-character substrings of each pair."""
    a, b = (_shingle_keys([p[k] for p in pairs], n) for k in (0, 1))
    every = np.sort(np.concatenate([a, b]))
    both, left, right = (np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=len(pairs)) for x in (every[1:][every[1:] == every[:-1]], a, b))
    return both / (left + right - both)


def _verified(pairs: DataFrame, signed: DataFrame, threshold: float, n: int) -> DataFrame:
    """pairs (a, b) whose signatures may reach the threshold, and whose texts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                keep = jaccard(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist())), n) >= threshold
                yield part.select([0, 1]).filter(pa.array(keep))

    enough = 64 * (1 + threshold) / 2 - SIGMAS * np.sqrt(64 * (1 - threshold**2) / 4)
    left = signed.select(F.col("node").alias("a"), F.col("text").alias("x"), F.col("bits").alias("x_bits"))
    right = signed.select(F.col("node").alias("b"), F.col("text").alias("y"), F.col("bits").alias("y_bits"))
    met = pairs.join(left, "a").join(right, "b").filter(F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits"))) <= 64 - enough)
    return met.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _shingles(texts: DataFrame, n: int) -> DataFrame:
    """texts (node, root, text) -> (node, root, size, h): the distinct substrings of each text, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                owner, h = _shingle_hashes(part.column(2).to_pylist(), n)
                size = np.bincount(owner, minlength=part.num_rows)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(size[owner]), pa.array(h.astype(np.int64))], ["node", "root", "size", "h"])

    return texts.select("node", "root", "text").mapInArrow(run, "node bigint, root bigint, size bigint, h bigint")


def rare_pairs(texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """texts (node, root, text) -> (a, b): pairs of different roots among which are all that reach the threshold. Substrings are
    ordered by how many texts have them; the larger set of a similar pair has one of its first (1 - t) of them among the first
    (1 - t) / (1 + t) of the smaller."""
    shingles = staged(_shingles(texts, n), "shingles")
    known = shingles.groupBy("h").agg(F.count("*").alias("df"))
    first = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
    listed = shingles.join(known, "h").groupBy("node", "root", "size").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("order"))
    rare = listed.select("node", "root", "size", F.posexplode(F.slice("order", F.lit(1), first(threshold).cast("int"))).alias("pos", "x"))
    rare = staged(rare.filter("x.df > 1").select("node", "root", "size", F.col("x.h").alias("h"), (F.col("pos") < first(2 * threshold / (1 + threshold))).alias("held")), "rare")
    # pairs within a root are of no use: those outside a substring's commonest root meet the others
    by_root = rare.groupBy("h", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    strays = rare.join(mixed.select("h", "main"), "h").filter("root <> main").select("h", *(F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "held")))
    near = lambda x, y: (F.col(x) >= F.col(y)) & (F.col(y) >= F.col(x) * threshold - 1e-9)
    met = rare.join(strays, "h").filter("root <> x_root").filter((near("size", "x_size") & F.col("x_held")) | (near("x_size", "size") & F.col("held")))
    return met.select(*_pair("node", "x_node")).distinct()


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, n, root) of the buckets whose members are of several components."""
    named = shared.select("key", "node", "n").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    return staged(named.join(several, "key"), "mixed")


def near_duplicate_groups(
    df: DataFrame, key: str, text: str, threshold: float = 0.7, least: int = 100, bands: int = BANDS, rows: int = ROWS, n: int = CHARACTERS, kind: str | None = None
) -> DataFrame:
    """(kind, first_id, other_id): for each group of records of the same kind (a column, or one kind if None), its least
    id with each other member. Records are linked if the similarity of their n-character substrings, formatting aside, is
    at least the threshold, and grouped also through others.

    Rows with a null id, kind or text, and texts with fewer than `least` letters and digits, are in no group. Repeated
    rows of an id are one record; exact copies under other ids belong to one group. If an id comes with different texts,
    all count. Other columns are ignored, whatever their names; an empty table gives no rows."""
    source = df.select((F.col(kind) if kind else F.lit("")).alias("kind"), F.col(key).alias("id"), formatting_off(text).alias("text"))
    source = source.filter("kind is not null and id is not null").filter(F.length("text") >= least)
    source = staged(source.withColumn("h", F.unhex(F.md5(F.concat_ws("\u0001", "kind", "text")))), "source")
    texts = staged(source.dropDuplicates(["h"]).select("h", "kind", "text", F.monotonically_increasing_id().alias("node")), "texts")
    signed = staged(_signed(texts.select("node", "text", F.xxhash64("kind")), bands, rows, n), "signed")

    each = signed.select("node", F.explode("keys").alias("key")).repartition("key")  # the one shuffle of what follows
    sizes = each.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low <> high")
    shared = staged(each.join(sizes, "key"), "buckets")
    to_hubs = shared.filter("node <> low").select(*_pair("node", "low")).union(shared.filter("node <> high").select(*_pair("node", "high")))
    compared = staged(to_hubs.distinct(), "compared")
    links = staged(_verified(compared, signed, threshold, n), "links")
    roots = staged(components(links), "roots")

    mixed = _mixed(shared, roots)
    for n_round in range(ROUNDS):
        # members of large buckets meet another one, drawn by hash, which mostly brings together what is left of a component
        large = mixed.filter(F.col("n") > SMALL).withColumn("h", F.xxhash64("node", F.lit(n_round)))
        if large.isEmpty():
            break
        drawn = large.join(large.groupBy("key").agg(F.min("h").alias("h")), ["key", "h"]).select("key", F.col("node").alias("hub"), F.col("root").alias("hub_root"))
        to_hub = large.join(drawn, "key").filter("root <> hub_root").select(*_pair("node", "hub")).distinct().join(compared, ["a", "b"], "left_anti")
        compared, last = staged(compared.union(fresh := staged(to_hub, "fresh")), "compared"), compared
        links, before = staged(links.unionAll(_verified(fresh, signed, threshold, n)), "links"), links
        for done in (last, before, fresh, mixed, roots):
            discard(done)
        roots = staged(components(links), "roots")
        mixed = _mixed(shared, roots)

    few = mixed.filter(F.col("n") <= SMALL)
    other = few.select("key", F.col("node").alias("y"), F.col("root").alias("y_root"))
    rest = few.join(other, "key").filter("node < y and root <> y_root").select(*_pair("node", "y"))
    crowded = signed.select("node", "text").join(mixed.filter(F.col("n") > SMALL).select("node", "root").distinct(), "node")
    rest = rest.union(rare_pairs(crowded, threshold, n)).distinct().join(compared, ["a", "b"], "left_anti")
    more = staged(_verified(staged(rest, "rest"), signed, threshold, n), "links")
    roots = components(links.unionAll(more))

    of = texts.select("h", "node").join(roots, "node", "left").select("h", F.coalesce("root", "node").alias("root"))
    members = staged(source.select("kind", "id", "h").distinct().join(of, "h").select("kind", "id", "root").distinct(), "members")
    firsts = members.groupBy("root").agg(F.min("id").alias("first_id"), F.max("id").alias("last")).filter("first_id <> last")
    for done in (source, texts, signed, shared, compared, mixed):
        discard(done)
    return members.join(firsts, "root").filter("id <> first_id").select("kind", "first_id", F.col("id").alias("other_id"))
