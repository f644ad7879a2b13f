"""Problem 10: abusive, hateful or sexual content, with its places in the text.

A linear-chain conditional random field tags the tokens of each sentence. Labels are given by document, so the labels of
tokens are found in turns: the field of the last turn says which sentences of a document labelled abusive are meant; in the
first turn a small list of words does. Each turn trains emission weights and the four transition scores on parts of the
labelled documents side by side in Spark tasks, and averages them (iterative parameter mixing). Forward-backward marginals of the tokens then make the score
of a sentence or of its strongest stretch, the greatest of them that of the document, and their stretches above one half the offending offsets.

Disguises are taken off before: letters of other scripts or digits in place of similar letters, letters repeated, spaced
or masked, characters without width.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglight.sources.tables import staged

SIZE = 1 << 18
#: Labelled documents that training takes at most (by hash of their id), documents of a part at least, most parts, turns, passes.
MOST_LABELLED, PART, PARTS, TURNS, PASSES = 20_000, 1000, 8, 4, 6
THRESHOLD = 0.6
#: Tokens that chains side by side fill, with the room that shorter ones leave; a longer chain comes alone.
AREA = 1 << 17
#: Tokens of a window by which a long sentence is scored.
STRETCH = 6

# Words by which the first turn finds sentences, by class. Each is compared without disguise.
WORDS = {
    "insult": """idiot moron imbecile loser clown parasite scum trash garbage worthless pathetic braindead brainless spineless dumbass
        asshole arsehole scumbag slag rat bastard bitch cunt dickhead dipshit shithead fuckwit fuckhead halfwit retard retarded jackass douchebag prick twat wanker whore
        slut pig dimwit cretin freak vermin subhuman subhumans filth disgusting
        arschloch wichser hurensohn missgeburt vollidiot trottel versager abschaum dreckskerl schlampe fotze spast depp dummkopf penner ungeziefer
        gilipollas cabron idiota imbecil hijo puta pendejo mierda basura inutil escoria payaso estupido
        connard connasse salope pute encule debile abruti cretin imbecile ordure batard crever merde""",
    "threat": """kill murder strangle stab shoot bullet throat exterminated exterminate rape
        umbringen vergasen schlag zahne verrecke abstechen matar matare romper infierno tuer creve egorger gueule""",
    "sexual": """cock grope dick pussy tits boobs nipples naked horny porn fuck fucking suck cum nude anal penis blowjob masturbate lick
        titten nackt geil ficken schwanz desnuda tetas polla follar verga nichons baise""",
    "group": """foreigners immigrants refugees women gays gay jews muslims blacks disabled trans migrants
        auslander fluchtlinge juden schwule frauen extranjeros inmigrantes mujeres gitanos moros etrangers immigres arabes juifs femmes""",
    "you": """you your yours youre du dich dir dein deine deinen ihr euch tu usted vosotros tus toi vous votre""",
    "self": """i my me myself ich mein mich yo mi je mon moi""",
}
#: Letters of other scripts, digits and signs, and the letters that they stand for.
SIMILAR = str.maketrans(
    "авекмнорстухіјѕԁԛԝαβεικνορτυχ0134578@$!€",
    "abekmhopctyxijsdqwabeiknoptyxoieastbasie",
)
_SPACED = r"(?<![\w])(?:[^\W\d_][ .*\-_]){3,}[^\W\d_](?![\w])"
_TOKEN = re.compile(rf"(?P<code>`[^`\n]*`|<\w+>)|(?P<spaced>{_SPACED})|(?P<word>[^\W_][\w*@$!'’​-‏⁠­﻿]*)")
_END = re.compile(r"(?<=[.!?])\s+|\n+")
_INVISIBLE = re.compile(r"[​-‏⁠­﻿̀-ͯ]")
_RUNS = re.compile(r"(.)\1+")
_CAMEL = re.compile(r"[a-z][A-Z]")
_PIECE = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^A-Z]+")


def plain_word(word: str) -> str:
    """A word without disguise."""
    word = _INVISIBLE.sub("", unicodedata.normalize("NFKD", word)).lower()
    if not word.isdigit():
        word = word.translate(SIMILAR)
    return _RUNS.sub(r"\1", re.sub(r"[^\w]|_", "", word))


CLASS = {plain_word(w): k for k, words in enumerate(WORDS.values(), 1) for w in words.split()}
_STRONG = {1, 2, 3}
_NAMES = list(WORDS)


def _hash(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode("utf-8", "surrogatepass"))


def is_identifier(token: str, kind: str) -> bool:
    return kind == "code" or (kind == "word" and ("_" in token or _CAMEL.search(token) is not None))


class Words:
    """Features of tokens by their spelling, remembered up to a bound."""

    UNI = 5

    def __init__(self) -> None:
        self.of: dict[tuple[str, str], int] = {}
        self.hash: list[int] = []
        self.uni: list[list[int]] = []
        self.klass: list[int] = []

    def __call__(self, token: str, kind: str) -> int:
        if is_identifier(token, kind):  # all alike: their words follow
            token, kind = "<id>", ""
        k = self.of.get((token, kind))
        if k is None:
            k = self.of[token, kind] = len(self.hash)
            if kind == "":
                word = token
            elif token.isdigit():
                word = "<num>"
            else:
                word = plain_word(token) or "<none>"
            klass = CLASS.get(word, 0) or CLASS.get(word.removesuffix("s"), 0)
            letters = word[0] + "".join(sorted(word[1:]))
            bones = re.sub(r"[aeiou]", "", word)
            self.hash.append(_hash(word))
            self.klass.append(klass)
            disguised = kind == "spaced" or (kind == "word" and word.isalpha() and len(token) > 3 and _RUNS.sub(r"\1", token.lower()) != _RUNS.sub(r"\1", unicodedata.normalize("NFC", token).lower().translate(SIMILAR)))
            self.uni.append([_hash("w", word), _hash("l", letters), _hash("b", bones if len(bones) > 2 else word), _hash("p", word[:5]), _hash("c", str(klass), str(disguised))])
        return k

    def forget(self) -> None:
        if len(self.hash) > 500_000:
            self.__init__()


def identifier_words(token: str, at: int) -> Iterator[tuple[str, tuple[int, int]]]:
    """The words of an identifier or of inline code with their offsets: those between other signs, and the parts of one whose case
    changes."""
    for m in _PIECE.finditer(token):
        piece = m.group()
        if not piece.isdigit():
            yield piece.lower(), (at + m.start(), at + m.end())
        if _CAMEL.search(piece):
            for x in _HUMP.finditer(piece):
                if len(x.group()) > 2:
                    yield x.group().lower(), (at + m.start() + x.start(), at + m.start() + x.end())


def sentences(text: str, words: Words) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """Token numbers and their offsets of each sentence."""
    at = 0
    for m in [*_END.finditer(text), None]:
        stop = m.start() if m else len(text)
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        for x in _TOKEN.finditer(text, at, stop):
            kind, token = x.lastgroup, x.group()
            ids.append(words(token, kind))
            spans.append(x.span())
            if is_identifier(token, kind):  # <id>, then its words
                for w, span in identifier_words(token, x.start()):
                    ids.append(words(w, "word"))
                    spans.append(span)
        if ids:
            yield ids, spans
        at = m.end() if m else stop


class Batch:
    """Features of many sentences at once: one row of hashed features for each token."""

    def __init__(self, found: list[list[int]], words: Words):
        sizes = np.array([len(s) for s in found])
        self.sizes, self.begin = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        k = np.fromiter((x for s in found for x in s), np.int64, int(sizes.sum()))
        own, k = np.unique(k, return_inverse=True)
        own = own.tolist()
        h = np.array([words.hash[w] for w in own], np.uint64)[k]
        klass = np.array([words.klass[w] for w in own], np.int64)[k]
        uni = np.array([words.uni[w] for w in own], np.uint64).reshape(-1, Words.UNI)[k]
        owner = np.repeat(np.arange(len(found)), sizes)
        has = np.zeros((len(found), len(_NAMES) + 1), bool)
        has[owner, klass] = True
        self.hit = has[:, 1:4].any(1)
        sets = (has[:, 1:] << np.arange(len(_NAMES))).sum(1).astype(np.uint64)
        before = np.where(np.append(True, owner[1:] != owner[:-1]), np.uint64(7), np.append(np.uint64(7), h[:-1]))
        after = np.where(np.append(owner[1:] != owner[:-1], True), np.uint64(9), np.append(h[1:], np.uint64(9)))
        mix = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        self.features = np.column_stack([uni, mix(before, h), mix(h, after + np.uint64(1)), mix(before + np.uint64(3), after), mix(sets[owner] + np.uint64(5), klass.astype(np.uint64)), mix(sets[owner] + np.uint64(11), np.uint64(13) + h * np.uint64(0))]) % np.uint64(SIZE)
        self.features = self.features.astype(np.int32)
        self.owner = owner
        self.pair = self.features[:, Words.UNI + 1]

    def evidence(self, counts: np.ndarray) -> np.ndarray:
        """For each sentence, how much oftener than others its pairs of words stand in documents labelled abusive; counts:
        documents without and with the label that have a pair."""
        base = np.log((counts[1].sum() + 1) / (counts[0].sum() + 1))
        q = (counts[1] + 2 * np.exp(base) / (1 + np.exp(base))) / (counts.sum(0) + 2)
        odds = np.log(q / (1 - q)) - base
        return np.bincount(self.owner, odds[self.pair], len(self.sizes)) / self.sizes

    def _chunks(self) -> Iterator[np.ndarray]:
        """Sentences of like length, side by side in chunks of a bounded area."""
        order = np.argsort(self.sizes, kind="stable")
        at = 0
        while at < len(order):
            sizes = self.sizes[order[at:]]
            n = max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), AREA)))
            yield order[at : at + n]
            at += n

    def marginals(self, weights: np.ndarray, steps: np.ndarray, expected: np.ndarray | None = None, use: np.ndarray | None = None) -> np.ndarray:
        """Probability of the tag of each token, by forward-backward over all sentences side by side. steps: scores of the
        transitions from and to the tag, [[out-out, out-in], [in-out, in-in]]. expected, if given, gains the expected number of
        each transition, each sentence weighed by use."""
        odds = np.exp(np.clip(weights[self.features].sum(1), -40, 40))
        (oo, oi), (io, ii) = np.exp(steps)
        out = np.empty(len(odds))
        for part in self._chunks():
            sizes, begin = self.sizes[part], self.begin[part]
            longest = int(sizes.max(initial=0))
            alive = np.arange(longest)[:, None] < sizes[None, :]
            at = np.where(alive, begin[None, :] + np.arange(longest)[:, None], 0)
            e = np.where(alive, odds[at], 1.0)
            forward, back = np.ones((longest, len(part))), np.ones((longest, len(part)))
            # only the ratio of the two states' sums is carried, so nothing overflows
            forward[0] = e[0]
            for t in range(1, longest):
                forward[t] = e[t] * (oi + forward[t - 1] * ii) / (oo + forward[t - 1] * io)
            for t in range(longest - 2, -1, -1):
                x = e[t + 1] * back[t + 1]
                back[t] = np.where(alive[t + 1], (io + ii * x) / (oo + oi * x), 1.0)
            both = forward * back
            out[at[alive]] = (both / (1 + both))[alive]
            if expected is not None:
                f, x = forward[:-1], (e * back)[1:]
                pairs = np.array([[np.full_like(f, oo), oi * x], [io * f, ii * f * x]])
                expected += (pairs / pairs.sum((0, 1)) * alive[1:] * use[part]).sum((2, 3))
        return out

    def sentence_scores(self, p: np.ndarray) -> np.ndarray:
        """Mean of the marginals over each sentence's tokens, the upper half of them counted: single tokens don't decide."""
        order = np.lexsort((-p, self.owner))
        rank = np.arange(len(p)) - self.begin[self.owner]
        upper = rank < (self.sizes[self.owner] + 1) // 2
        total = np.bincount(self.owner[upper], p[order][upper], len(self.sizes))
        return total / np.maximum(1, (self.sizes + 1) // 2)

    def stretch_scores(self, p: np.ndarray) -> np.ndarray:
        """Score of each sentence, or of its strongest window of a few tokens if that is greater: what follows doesn't dilute it."""
        total = np.append(0.0, np.cumsum(p))
        start = np.arange(len(p) - STRETCH + 1)
        start = start[start + STRETCH <= (self.begin + self.sizes)[self.owner[: len(start)]]]
        best = self.sentence_scores(p)
        np.maximum.at(best, self.owner[start], (total[start + STRETCH] - total[start]) / STRETCH)
        return best


#: Scores of transitions that training begins with and is drawn to: sentences are mostly of one kind throughout.
STEPS = np.array([[1.0, -1.5], [-1.5, 1.0]])
#: How strongly, in transitions.
HELD_TO = 200.0


def _read(texts: list[str]) -> tuple[Batch, np.ndarray]:
    """All sentences of some documents, and the document of each."""
    words = Words()
    found, doc = [], []
    for n, t in enumerate(texts):
        for ids, _ in sentences(t, words):
            found.append(ids)
            doc.append(n)
    return Batch(found, words), np.array(doc, np.int64)


def _count(texts: list[str], labels: list[int]) -> np.ndarray:
    """Documents without and with the label that have each pair of words (hashed)."""
    batch, doc = _read(texts)
    out = np.zeros((2, SIZE), np.float32)
    seen = np.unique(doc[batch.owner] * SIZE + batch.pair)
    np.add.at(out, (np.array(labels)[seen // SIZE], seen % SIZE), 1)
    return out


def _train(texts: list[str], labels: list[int], model: np.ndarray, turn: int, counts: np.ndarray) -> np.ndarray:
    """Weights and transition scores after some passes over the sentences of labelled documents (AdaGrad on the likelihood of the
    field).

    Which sentences of a document labelled abusive are meant: those that the list of words hits (first turn) or the last
    weights tag, unless others have them too; where that gives none, those whose pairs of words are typical of such
    documents. Sentences that may or may not be meant are left out."""
    batch, doc = _read(texts)
    abusive = np.array(labels)[doc] == 1
    evidence = batch.evidence(counts)
    weights, steps = model[:SIZE].copy(), model[SIZE:].reshape(2, 2).copy()
    if turn == 0:
        meant = abusive & batch.hit & (evidence > 0)
    else:
        score = batch.sentence_scores(batch.marginals(weights, steps))
        meant = abusive & (score >= 0.5) & (evidence > 0)
    explained = np.zeros(len(texts), bool)
    explained[doc[meant]] = True
    meant |= abusive & ~explained[doc] & (evidence > 1.5)
    used = ~abusive | meant | (evidence < 0)
    tag = meant[batch.owner].astype(float)
    power, step_power = np.full(SIZE, 1e-2), np.full((2, 2), 1e-2)
    flat = batch.features.ravel()
    width = batch.features.shape[1]
    each = np.where(meant, 4.0, 1.0) * used
    heavier = each[batch.owner]
    within = np.maximum(batch.sizes - 1, 0) * each  # transitions of a sentence all go from one tag to the same
    seen = np.array([[within[~meant].sum(), 0.0], [0.0, within[meant].sum()]])
    for _ in range(PASSES):
        expected = np.zeros((2, 2))
        p = batch.marginals(weights, steps, expected, each)
        slope = np.bincount(flat, np.repeat((p - tag) * heavier, width), SIZE) + 0.02 * weights
        power += slope * slope
        weights -= 0.35 * slope / np.sqrt(power)
        slope = expected - seen + HELD_TO * (steps - STEPS)
        step_power += slope * slope
        steps -= 0.1 * slope / np.sqrt(step_power)
    return np.concatenate([weights, steps.ravel()])


def fit(labelled: DataFrame, most: int = MOST_LABELLED, turns: int = TURNS) -> np.ndarray:
    """labelled (id, text, abusive 0 or 1) -> the model: weights, then transition scores. About `most` documents are used at most,
    those with the least hash of their id; the parts are trained side by side, only their models (1 MB each, at most PARTS) come
    to the driver."""
    labelled = labelled.filter("text <> '' and abusive is not null and id is not null")
    n = labelled.count()
    if n > most:
        labelled = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    parts = max(1, min(PARTS, min(n, most) // PART))
    spread = staged(labelled.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "text", "abusive"), "labelled").repartition(parts, "part")
    model, counts = np.concatenate([np.zeros(SIZE), STEPS.ravel()]).astype(np.float32), np.zeros((2, SIZE), np.float32)
    context = labelled.sparkSession.sparkContext

    for turn in range(-1, turns if n else -1):
        given = context.broadcast((model, counts))  # 3 MB

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, given=given) -> Iterator[pa.RecordBatch]:
            texts: dict[int, list[str]] = {}
            labels: dict[int, list[int]] = {}
            for b in batches:
                for part, text, label in zip(*(b.column(k).to_pylist() for k in range(3))):
                    texts.setdefault(part, []).append(text)
                    labels.setdefault(part, []).append(label)
            m, c = given.value
            out = [_count(texts[k], labels[k]) if turn < 0 else _train(texts[k], labels[k], m.astype(np.float64), turn, c) for k in texts]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes() for x in out], pa.binary())], ["w"])

        made = [np.frombuffer(r[0], np.float32) for r in spread.mapInArrow(run, "w binary").collect()]
        if turn < 0:
            counts = np.sum(made, axis=0).reshape(2, SIZE)
        else:
            model = np.mean(made, axis=0)
        given.unpersist()
    return model


def score_documents(df: DataFrame, key: str, text: str, model: np.ndarray, also: str | None = None) -> DataFrame:
    """(key, score, spans array<struct<start,end>>), and another column if named, of every row: the score of the worst sentence or stretch, and the offsets of
    stretches of tokens more likely offending than not. A null or empty text scores 0 without spans. Texts are scored whole,
    rows keep their partitions; other columns aren't carried, so none can clash."""
    kind = df.schema[key].dataType.simpleString()
    given = df.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # SIZE numbers and four, 1 MB
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        weights, steps = given.value[:SIZE], given.value[SIZE:].reshape(2, 2).astype(float)
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                part = whole.slice(at, 400)
                words.forget()
                found, where, doc = [], [], []
                for n, t in enumerate(part.column(1).to_pylist()):
                    for ids, spans in sentences(t or "", words):
                        found.append(ids)
                        where.append(spans)
                        doc.append(n)
                best = np.zeros(part.num_rows)
                offending: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for lo in range(0, len(found), 4000):
                    batch = Batch(found[lo : lo + 4000], words)
                    p = batch.marginals(weights, steps)
                    score = batch.stretch_scores(p)
                    own = np.array(doc[lo : lo + 4000])
                    np.maximum.at(best, own, score)
                    for s in np.flatnonzero(score >= 0.5):
                        spans = where[lo + s]
                        begin = batch.begin[s]
                        high = np.flatnonzero(p[begin : begin + batch.sizes[s]] >= 0.5)
                        for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1) if len(high) else []:
                            offending[own[s]].append({"start": spans[run[0]][0], "end": spans[run[-1]][1]})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(best), pa.array(offending, spans_type)], ["k", "also", "score", "spans"])

    other = F.col(also) if also else F.lit(None).cast("string")
    carried = df.schema[also].dataType.simpleString() if also else "string"
    made = df.select(F.col(key).alias("k"), F.col(text).alias("t"), other.alias("also")).mapInArrow(run, f"k {kind}, also {carried}, score double, spans array<struct<start:int,end:int>>")
    return made.select(F.col("k").alias(key), *([F.col("also").alias(also)] if also else []), "score", "spans")


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, abusive): documents with a label, 1 if at least half of their reviewers say so. Null labels don't count."""
    voted = labels.filter("abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("vote"))
    return documents.join(voted, "doc_id").select(F.col("doc_id").alias("id"), "text", (F.col("vote") >= 0.5).cast("int").alias("abusive"))
