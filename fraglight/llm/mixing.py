"""Problem 9: mixing sources to target weights, by soft membership.

A naive Bayes classifier, fitted on the documents whose source is known, gives each document its probability of each
domain. Document rates between 0 and the source's cap are fitted by projected-gradient least squares, so that the tokens
of each domain, expected by membership as well as by label, meet their target. Rates become whole repeats by a hash of
the document, and the totals that the descent looks at are those of the repeats, so what it reaches is what comes out.
A step is one pass over the documents: it tries several lengths along the gradient at once, and gives a few sums for each
mix and domain; rates are replayed from the shifts so far, so none are stored or moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglight.llm.tokens import TOKENIZERS, send, vocabulary
from fraglight.sources.tables import staged

#: Numbers of the classifier at most, features of a domain at most, and steps of the descent.
MODEL, FEATURES, STEPS = 1 << 23, 1 << 14, 14
#: Sources up to which their numbers are broadcast.
BROADCAST = 10_000
#: Lengths along the gradient that a step tries; 0 stays.
LENGTHS = np.array([0, 1, 0.5, 2, -0.5, 4, 0.25, 1.5, -1, 3, 0.75, 8, -2, 0.1, 16, 1.25, -4, 6, -8, 12])


def _word_features(text: str, features: int) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) < 4:
        return np.zeros(1, np.int64)
    x = raw.astype(np.uint64)
    grams = ((x[:-3] << np.uint64(24)) | (x[1:-2] << np.uint64(16)) | (x[2:-1] << np.uint64(8)) | x[3:]) * np.uint64(0x9E3779B97F4A7C15)
    return ((grams >> np.uint64(40)) % np.uint64(features)).astype(np.int64)


class Model:
    """Naive Bayes over hashed four-byte grams."""

    def __init__(self, counts: np.ndarray):
        self.features = counts.shape[1]
        self.log = np.log(counts + 0.5) - np.log((counts + 0.5).sum(1, keepdims=True))

    def posterior(self, text: str | None) -> np.ndarray:
        seen = np.bincount(_word_features(text or "", self.features), minlength=self.features)
        score = self.log @ seen / max(1.0, np.sqrt(seen.sum()))  # grams overlap: their evidence is tempered
        p = np.exp(score - score.max())
        return p / p.sum()


def _fit(labelled: DataFrame, domains: int) -> Model:
    """labelled (domain int, text): counts of all documents, summed in tasks first. The features of a domain are fewer where there
    are very many domains, so that the model's size is bounded."""
    features = max(64, min(FEATURES, MODEL // max(1, domains)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts.setdefault(k, np.zeros(features, np.int64))
                counts[k] += np.bincount(_word_features(text, features), minlength=features)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["k", "f", "n"])

    counts = np.zeros((domains, features))
    summed = labelled.mapInArrow(run, "k int, f int, n bigint").groupBy("k", "f").agg(F.sum("n").alias("n"))
    for k, f, n in summed.collect():  # the model's numbers, at most MODEL
        counts[k, f] = n
    return Model(counts)


def _uniform(key: str, mix: str) -> F.Column:
    """A number in [0, 1) of each document and mix, the same in every run."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(mix)), F.lit(1 << 40)) / float(1 << 40)


def mixed(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, source, text), targets (mix_name, source, target_share, max_repeats) -> two tables: chosen
    (mix_name, source, doc_id, repeats, n_tokens), and shares (mix_name, source, target_share, actual_share, tokens,
    documents, most_repeats), one row for each named source.

    Shares are relative; those of null, zero or negative weight and of sources without tokens come out as 0, and the others
    share all tokens. The mix is as large as the scarcest source allows. A null cap means 1; no document comes oftener
    than the cap of its source. Documents with a null id or source or without tokens, and mixes or sources with a null name,
    are left out; of repeated targets the greatest weight and cap count. Empty tables give empty results."""
    spark = documents.sparkSession
    wanted = targets.filter("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("cap"))
    rows = wanted.orderBy("mix_name", "source").collect()  # the targets themselves: a row for each source that a mix names
    mixes, names = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    share, cap = np.zeros((len(mixes), len(names))), np.zeros((len(mixes), len(names)))
    for r in rows:
        share[mixes.index(r[0]), names.index(r[1])] = max(0.0, r[2] or 0.0)
        cap[mixes.index(r[0]), names.index(r[1])] = 1 if r[3] is None else max(0, r[3])
    chosen_schema = "mix_name string, source string, doc_id bigint, repeats int, n_tokens bigint"
    if not names:
        empty = "mix_name string, source string, target_share double, actual_share double, tokens bigint, documents bigint, most_repeats bigint"
        return spark.createDataFrame([], chosen_schema), spark.createDataFrame([], empty)

    numbered = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "source string, domain int")
    numbered = F.broadcast(numbered) if len(names) <= BROADCAST else numbered  # a row for each source named
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").filter("source is not null and doc_id is not null and text <> ''")
    named = named.join(numbered, "source").select("doc_id", "domain", "text")
    given = spark.sparkContext.broadcast(_fit(named.select("domain", "text"), len(names)))  # at most MODEL numbers
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"
    send(spark, path)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for b in batches:
            texts = b.column(2).to_pylist()
            q = [given.value.posterior(t).astype(np.float32) for t in texts]
            n = [len(words.encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(q, pa.list_(pa.float32())), pa.array(n, pa.int64())], ["doc_id", "domain", "q", "n_tokens"])

    table = named.mapInArrow(members, "doc_id bigint, domain int, q array<float>, n_tokens bigint").filter("n_tokens > 0")
    table = staged(table.withColumn("u", F.array(*(_uniform("doc_id", m) for m in mixes))), "members")

    def arrays(b: pa.RecordBatch) -> tuple:
        q = np.asarray(b.column(2).flatten()).reshape(b.num_rows, len(names)).astype(float)
        u = np.asarray(b.column(4).flatten()).reshape(b.num_rows, len(mixes))
        return b.column(0), np.asarray(b.column(1)), q, np.asarray(b.column(3)).astype(float), u

    def summed(function) -> np.ndarray:
        """Sum over all documents of an array that function makes of a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                if b.num_rows:
                    x = function(*arrays(b))
                    out = x if out is None else out + x
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["k", "x"])

        out = {k: x for k, x in table.mapInArrow(run, "k bigint, x double").groupBy("k").agg(F.sum("x")).collect()}
        return np.array([out.get(k, 0.0) for k in range(max(out, default=-1) + 1)])

    def by_domain(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(mixes, domains) sums of x (documents, mixes) by label."""
        return np.array([np.bincount(at, x[:, m], len(names)) for m in range(x.shape[1])])

    sizes = summed(lambda _, at, q, n, u: np.array([by_domain(at, n[:, None])[0], n @ q]))
    own, soft = sizes.reshape(2, -1) if len(sizes) else np.zeros((2, len(names)))
    share = np.where(own > 0, share, 0.0) * (cap > 0)
    weight = share / np.maximum(share.sum(1, keepdims=True), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(weight > 0, cap * own / weight, np.inf).min(1)
    total = np.where(np.isfinite(room), room, 0.0)
    target = weight * total[:, None]
    allowed = np.where(weight > 0, cap, 0.0)
    start = np.where(own > 0, target / np.maximum(own, 1), 0.0)

    def repeats(at: np.ndarray, q: np.ndarray, u: np.ndarray, by_q: np.ndarray, by_label: np.ndarray) -> np.ndarray:
        """(documents, mixes): how often each document comes, by the shifts of its rate."""
        most = allowed[:, at].T
        rates = np.clip(start[:, at].T - q @ by_q.T - by_label[:, at].T, 0.0, most)
        return np.minimum(np.floor(rates + u), most)

    def totals(by_q: np.ndarray, by_label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by label and as expected by membership, each (lengths, mixes, domains), for several shifts at once."""

        def function(_, at: np.ndarray, q: np.ndarray, n: np.ndarray, u: np.ndarray) -> np.ndarray:
            out = []
            for x, y in zip(by_q, by_label):
                tokens = repeats(at, q, u, x, y) * n[:, None]
                out.append([by_domain(at, tokens), tokens.T @ q])
            return np.array(out)

        got = summed(function).reshape(len(by_q), 2, len(mixes), len(names))
        return got[:, 0], got[:, 1]

    shift_q, shift = np.zeros_like(target), np.zeros_like(target)
    expected_target = None
    if own.sum():
        label, expected = (x[0] for x in totals(shift_q[None], shift[None]))
        # what the targets by label are as expected tokens: memberships of what each source would give at its rate
        expected_target = summed(lambda _, at, q, n, u: (start[:, at] * n) @ q).reshape(target.shape)
    for step in range(STEPS if own.sum() else 0):
        lengths = (LENGTHS * (1 + step / 5))[:, None, None]  # other lengths in each step: totals move by whole documents
        if step % 4 == 1 and step < STEPS - 3:  # along the memberships, one length for each mix
            slope = (expected - expected_target) / np.maximum(soft, 1e-9)
            labels, means = totals(shift_q + lengths * slope, np.broadcast_to(shift, (len(LENGTHS), *shift.shape)))
            loss = ((labels - target) ** 2).sum(-1) + ((means - expected_target) ** 2).sum(-1)
            best = loss.argmin(0)
            shift_q = shift_q + lengths[best, 0] * slope
            label, expected = labels[best, range(len(mixes))], means[best, range(len(mixes))]
        else:  # along the labels, where each source has its own length
            slope = (label - target) / np.maximum(own, 1e-9)
            labels, means = totals(np.broadcast_to(shift_q, (len(LENGTHS), *shift.shape)), shift + lengths * slope)
            best = np.abs(labels - target).argmin(0)
            shift = shift + lengths[best, 0, 0] * slope
            label = np.take_along_axis(labels, best[None], 0)[0]
            expected = means[0]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, q, n, u = arrays(b)
            r = repeats(at, q, u, shift_q, shift)
            for m, mix in enumerate(mixes):
                k = np.flatnonzero(r[:, m] >= 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mix] * len(k), pa.string()), pa.array([names[x] for x in at[k]], pa.string()), ids.take(pa.array(k)), pa.array(r[k, m].astype(np.int32)), pa.array(n[k].astype(np.int64))],
                    ["mix_name", "source", "doc_id", "repeats", "n_tokens"],
                )

    chosen = table.mapInArrow(choose, chosen_schema)
    plan = spark.createDataFrame(
        [(m, n, float(weight[i, k])) for i, m in enumerate(mixes) for k, n in enumerate(names) if any(r[0] == m and r[1] == n for r in rows)],
        "mix_name string, source string, target_share double",
    )
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").cast("bigint").alias("most_repeats"))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("whole"))  # a row for each mix
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    shares = plan.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    shares = shares.select("mix_name", "source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"))
    return chosen, shares
