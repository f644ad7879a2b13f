"""Nulls, ties, repeats, clashing columns and empty tables of the training-data operators, and brute-force comparisons."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraglight.llm import neardup, spans, terms
from fraglight.llm import queries as llm
from fraglight.llm.components import components
from fraglight.llm.ledger import Ledger, canonical_key, formatting_ledger
from fraglight.llm.linkage import Linker, learned, link_history, place
from fraglight.llm.mixing import mixed
from fraglight.llm.neardup import jaccard, near_duplicate_groups
from fraglight.llm.spans import bands_for, distances, shared_clusters, shared_spans, stretches
from fraglight.llm.terms import BurstTrie, marked_terms
from fraglight.llm.tokens import TOKENIZERS, decode_column, encode_column, vocabulary
from fraglight.sources.tables import staged
from fraglight.llm.toxicity import SIZE, THRESHOLD, Batch, STEPS, Words, _hash, fit, plain_word, score_documents, sentences

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
needs_vocabulary = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabularies")


@needs_data
@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_equals_sql(compare, name):
    ours, theirs = compare(llm.QUERIES[name], llm.SQL[name])
    assert ours == theirs


# components


def find_roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame([*edges, (5, None), (None, None), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == find_roots([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1


def brute_spans(records, span):
    seen = {}
    for k, t in records.items():
        for i in range(len(t) - span + 1):
            seen.setdefault(t[i : i + span], set()).add(k)
    out = set()
    for k, t in records.items():
        marks = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                marks[i : i + span] = [True] * span
        for m in re.finditer("1+", "".join("01"[x] for x in marks)):
            out.add((k, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shared_spans(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 3 else "abcdefghij é漢\U0001f600"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [text(rng.randrange(20, 90)) for _ in range(6)] + ["-" * 50]
    records = {k: "".join(rng.choice(pool) if rng.random() < 0.6 else text(rng.randrange(1, 30)) for _ in range(rng.randrange(0, 7))) for k in range(60)}
    rows = [(k, t, "x") for k, t in records.items()]
    rows += rows[:5] + [(None, text(90), "x"), (99, None, "x"), (98, "", "x")]
    df = spark.createDataFrame(rows, "rec bigint, text string, band string")
    got = [tuple(r) for r in shared_spans(df, span=24, shingle=8, bands=1 + seed % 2).select("rec", "s", "e").collect()]
    assert sorted(got) == sorted(brute_spans(records, 24))
    clusters = {r.rec: r.cluster for r in shared_clusters(df, span=24, shingle=8).collect()}
    edges = []
    holders = {}
    for k, t in records.items():
        for i in range(len(t) - 23):
            edges.append((holders.setdefault(t[i : i + 24], k), k))
    joined = find_roots([e for e in edges if e[0] != e[1]])
    assert clusters == {k: joined[k] for k in {g[0] for g in got}}


def test_shared_spans_of_many_contexts(spark):
    """More contexts of one band than are compared with each other, and a hot exact copy."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared = word(20)
    records = {k: word(30) + shared[: 12 + k % 9] + word(30) for k in range(90)} | {200 + k: "same text " * 9 for k in range(150)}
    df = spark.createDataFrame(list(records.items()), "rec bigint, text string")
    assert sorted(map(tuple, shared_spans(df, span=16, shingle=6).select("rec", "s", "e").collect())) == sorted(brute_spans(records, 16))


@pytest.mark.parametrize("compared", [spans.COMPARED, 0])
def test_contexts_of_several_records_each_are_linked(spark, monkeypatch, compared):
    monkeypatch.setattr(spans, "COMPARED", compared)
    rng = random.Random(11)
    some = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passages = [some(26) for _ in range(20)]
    # two copies of each of three texts that have one passage, little longer than a span, in common
    texts = [some(40) + p + some(40) for p in passages for _ in range(3)]
    records = {10 * i + k: t for i, t in enumerate(texts) for k in range(2)}
    df = spark.createDataFrame(list(records.items()), "rec bigint, text string")
    assert sorted(map(tuple, shared_spans(df, span=24, shingle=8).select("rec", "s", "e").collect())) == sorted(brute_spans(records, 24))
    clusters = {r.rec: r.cluster for r in shared_clusters(df, span=24, shingle=8).collect()}
    assert clusters == {k: k // 30 * 30 for k in records}


def test_bands_have_the_recall_they_are_tuned_to():
    """Windows with a few characters replaced: the share of pairs that meet in a band, against the tuned one."""
    assert bands_for() == 1 and bands_for(0.99, 0.5) == 7 and bands_for(0.9, 0.5, rows=2) == 9
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(40)]
        b = a[:]
        b[rng.choice([0, 5, 20, 39])] = "x"
        pairs.append(("".join(a), "".join(b)))
    alike = [len(x & y) / len(x | y) for x, y in (({t[i : i + 8] for i in range(33)} for t in p) for p in pairs)]
    bands = bands_for(0.95, min(alike))
    keys = [[stretches(list(side), 40, 8, band)[4] for side in zip(*pairs)] for band in range(bands)]
    met = np.any([x == y for x, y in keys], axis=0).mean()
    assert met >= 0.95 and np.mean(keys[0][0] == keys[0][1]) < met


def test_distances():
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in ("xxabcdef", "abcdxf"))
    assert distances(a, b, -2, 3).tolist() == [4, 4, 0, 0, 1, 1] and distances(b, a, 2, 3).tolist() == [0, 0, 1, 1]
    assert distances(a[:2], b, 0, 3).tolist() == []


def test_long_records_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 50)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    parts = [word(40) for _ in range(8)]
    records = {k: "".join(rng.choice(parts) + word(3) for _ in range(12)) for k in range(4)}
    df = spark.createDataFrame(list(records.items()), "rec bigint, text string")
    assert sorted(map(tuple, shared_spans(df, span=24, shingle=8).select("rec", "s", "e").collect())) == sorted(brute_spans(records, 24))


def test_shared_spans_of_nothing(spark):
    assert shared_spans(spark.createDataFrame([], "rec bigint, text string")).count() == 0
    assert shared_clusters(spark.createDataFrame([(1, "short")], "rec bigint, text string")).count() == 0


# 2


def test_ledger(spark):
    rows = [
        (5, "Fn  A(b)", ["x;", "Y"], 3), (2, "fn a b", ["y", "X", "x"], 1), (9, "FN_A_B", None, 2), (9, "FN_A_B", None, 9), (4, "fnab", [], 4), (7, "fnab", [None, "--"], None),
        (1, "  --", ["y"], 1), (3, None, ["y"], 1), (None, "fnab", None, 1), (6, "ÉTÉ ٣", None, 5), (8, "été٣", [""], 6), (10, "ete٣", None, 7),
    ]
    df = spark.createDataFrame([(*r, "clash", b"clash") for r in rows], "fragment_id bigint, fragment string, dependencies array<string>, at int, id string, key binary")
    df = df.withColumn("at", F.timestamp_seconds("at"))
    for batches in (1, 3):
        ledger = formatting_ledger(df, "fragment_id", "fragment", "dependencies", "at", batches=batches, rows=2)
        assert sorted(map(tuple, ledger.copies().collect())) == [(2, 5), (4, 7), (4, 9), (6, 8)]
        assert sorted(map(tuple, ledger.counts().select("first_id", "copies").collect())) == [(2, 2), (4, 3), (6, 2), (10, 1)]
    empty = formatting_ledger(df.limit(0), "fragment_id", "fragment", "dependencies", "at")
    assert empty.copies().count() == 0 == empty.counts().count()


def test_ledger_takes_batches_in_any_order(spark):
    keyed = lambda ids: spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn("key", canonical_key(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")), F.lit(None)))
    ledger = Ledger(spark, rows=2)
    for ids in ([7, 8, 9], [1, 2, 7], [], [4, 1]):
        ledger.add(keyed(ids))
    assert sorted(map(tuple, ledger.counts().select("first_id", "copies").collect())) == [(1, 3), (2, 2), (9, 1)]


def test_ledger_opens_again_and_writes_what_changes(spark, tmp_path):
    keyed = lambda a, b: spark.range(a, b).select("id", canonical_key(F.concat(F.lit("t"), (F.col("id") % 700).cast("string")), F.lit(None)).alias("key"))
    path = f"file://{tmp_path}/ledger"
    Ledger(spark, path, rows=100).add(keyed(0, 5000))
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    before = size()
    again = Ledger(spark, path, rows=100)
    assert again.counts().count() == 700
    again.add(keyed(5000, 5010))
    assert size() - before < 0.1 * before
    for k in range(3):
        Ledger(spark, path, rows=100).add(keyed(4900, 6000 + k))
    last = Ledger(spark, path)
    assert sorted(r.copies for r in last.counts().collect()) == sorted(Counter(k % 700 for k in range(6002)).values())
    assert last.copies().count() == 6002 - 700


# 3


@pytest.mark.parametrize("hot", [0, 400])
def test_near_duplicates(spark, hot):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = {}
    for g in range(40):
        base = word(rng.randrange(110, 300))
        for _ in range(rng.randrange(1, 4)):
            k = len(texts)
            at = rng.randrange(len(base))
            texts[k] = rng.choice([base.upper(), base[:at] + " -- " + word(rng.randrange(0, 5)) + base[at:], base[:at] + base[at + 6 :], base[::1]])
    base = word(200)
    for _ in range(hot):
        at = rng.randrange(200)
        texts[len(texts)] = base[:at] + word(3) + base[at:]
    rows = [(k, "t" if k % 2 else "u", t, "clash", 1) for k, t in texts.items()]
    df = spark.createDataFrame(rows + rows[:9] + [(None, "t", texts[0], "", 1), (900, None, texts[0], "", 1), (901, "t", None, "", 1), (902, "t", "short", "", 1), (903, "t", "", "", 1)], "id bigint, part string, body string, text string, c int")
    got = {tuple(r) for r in near_duplicate_groups(df, "id", "body", kind="part").collect()}
    want = set()
    for kind in "tu":
        sets = {}
        for k, p, t, _, _ in rows:
            plain = re.sub(r"[\W_]", "", t).lower()
            if p == kind and len(plain) >= 100:
                sets[k] = {plain[i : i + 5] for i in range(len(plain) - 4)}
        ids = sorted(sets)
        pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
        want |= {(kind, r, k) for k, r in find_roots(pairs).items() if r != k}
    assert got == want and want


def test_common_passages_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """Texts of one boilerplate, at a similarity of about 0.54 with each other, share most buckets; few pairs are looked at."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    shared = word(280)
    counts = {}

    def counted(df, name="stage"):
        out = staged(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    texts = [shared + word(120) for _ in range(300)]
    texts += [texts[0][:-3] + "xyz", texts[5][:-4] + "wxyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    assert sorted(tuple(r)[1:] for r in near_duplicate_groups(df, "id", "text").collect()) == [(0, 300), (5, 301)]
    assert counts["rest"] < 4 * len(texts) and counts["compared"] < 2 * 20 * len(texts)


def test_rare_pairs_have_all_that_are_similar(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdef") for _ in range(60)) for _ in range(4)]
    texts = [rng.choice(base)[: rng.randrange(30, 60)] + "".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 25))) for _ in range(120)]
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "node bigint, root bigint, text string")
    got = {tuple(r) for r in neardup.rare_pairs(df, 0.7, 5).collect()}
    pairs = [(a, b) for a in range(120) for b in range(a + 1, 120)]
    alike = {p for p, j in zip(pairs, jaccard([(texts[a], texts[b]) for a, b in pairs], 5)) if j >= 0.7}
    assert alike and alike <= got


def test_formatting_is_taken_off_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(neardup, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, name))
    df = spark.range(6).withColumn("text", F.concat(F.repeat(F.lit("some text, "), 14), (F.col("id") / 2).cast("int").cast("string")))
    assert near_duplicate_groups(df, "id", "text").count() >= 3
    assert sum("regexp_replace" in p for p in plans) == 1


def test_near_duplicates_of_nothing(spark):
    assert near_duplicate_groups(spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", min_size=1, max_size=30), st.text("abcé", min_size=1, max_size=30)), min_size=1, max_size=5))
def test_jaccard(pairs):
    def shingles(t):
        t = t.ljust(5, "\0")
        return {t[i : i + 5] for i in range(len(t) - 4)}

    want = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert np.allclose(jaccard(pairs, 5), want)


# 4


def test_places(spark):
    spelled = ["compiler/rustc_a/src/b.rs:10:2", "./compiler//rustc_a/src/b.rs:10", r"D:\ws\q\compiler\rustc_a\src\b.rs:10:9", "/rustc/0123abc/compiler/rustc_a/src/b.rs(10,2)", " COMPILER/RUSTC_A/SRC/B.RS#L10, "]
    df = spark.createDataFrame([(s,) for s in [*spelled, "src/main.rs:3", "", None, "compiler/a.rs:" + "9" * 40]], "l string")
    got = [tuple(r)[:2] for r in df.select(*place(F.col("l"))).collect()]
    assert got == [("compiler/rustc_a/src/b.rs", 10)] * 5 + [(None, None)] * 3 + [("compiler/a.rs", None)]


def history(rng):
    name = lambda: f"compiler/{rng.choice('ab')}/x.rs:{rng.randrange(1, 60)}:{rng.randrange(9)}"
    seen = [("c" + str(rng.randrange(2)), name(), None) for _ in range(4)] + [("c0", None, 1), (None, name(), 1)]
    rows = [("c" + str(rng.randrange(2)), i, [rng.choice([name(), None, "nowhere"]) for _ in range(rng.randrange(4))] if rng.random() < 0.9 else None, rng.choice([i, rng.randrange(40), None])) for i in range(40)]
    return seen, rows + rows[:3] + [(None, 1, [name()], 1), ("c1", None, [name()], 1)]


def known_before(seen, rows):
    at = {}
    for c, loc, _ in seen:
        if c and loc:
            at.setdefault((c, loc.split(":")[0]), []).append(((-1, -1), int(loc.split(":")[1])))
    entries = {(c, i, p): loc for c, i, ls, _ in rows if c and i is not None for p, loc in enumerate(ls or []) if loc and ".rs" in loc}
    for (c, i, p), loc in entries.items():
        at.setdefault((c, loc.split(":")[0]), []).append(((i, p), int(loc.split(":")[1])))
    return sorted((c, i, p) for (c, i, p), loc in entries.items() if any(o < (i, p) and abs(n - int(loc.split(":")[1])) <= 3 for o, n in at[c, loc.split(":")[0]]))


@pytest.mark.parametrize("batches", [1, 4])
def test_linkage_with_late_rows(spark, batches):
    seen, rows = history(random.Random(8))
    s = spark.createDataFrame(seen, "campaign_id string, location string, first_iter bigint")
    i = spark.createDataFrame([(*r, "clash", 1) for r in rows], "campaign_id string, iter bigint, new_locations array<string>, at int, file string, line int").withColumn("logged_at", F.timestamp_seconds("at"))
    linker, all_ = link_history(s, i, batches=batches, clusters=True)
    got = sorted((r.campaign, r.iter, r.pos) for r in linker.repeated(all_).collect())
    assert got == known_before(seen, rows)
    lines = {tuple(r) for r in linker.known().select("campaign", "file", "line").collect()}
    near = [((c, f, m), (c, f, n)) for c, f, m in lines for d, g, n in lines if (c, f) == (d, g) and 0 < n - m <= 3]
    roots = find_roots(near)
    want = Counter(Counter({x: roots.get(x, x) for x in lines}.values()).values())
    linked = Counter(r["count"] for r in linker.clusters().groupBy("root").count().collect())
    assert {k: v for k, v in linked.items() if k > 1} == {k: v for k, v in want.items() if k > 1}


def test_linkage_keeps_links_to_blocks_not_read(spark):
    rows = lambda *r: spark.createDataFrame([("c", "compiler/a.rs", line, None, it, 0) for line, it in r], "campaign string, file string, line bigint, col bigint, iter bigint, pos bigint")
    linker = Linker(spark, rows=1)
    history = [(line, 9) for line in range(100, 2000, 40)] + [(16, 1), (15, 5)]
    linker.add(rows(*history))
    assert [r.iter for r in linker.repeated(rows((15, 5))).collect()] == [5]
    linker.add(rows((2, 7)))
    assert [r.iter for r in linker.repeated(rows((15, 5))).collect()] == [5]
    assert linker.known().count() == len(history) + 1


def test_learned_weights_decide(spark, monkeypatch):
    """Without the score all blocked pairs would be links; with it those of the definition, whatever the columns."""
    rng = random.Random(2)
    seen, rows = history(rng)
    s = spark.createDataFrame(seen, "campaign_id string, location string, first_iter bigint")
    i = spark.createDataFrame([r[:3] + (None,) for r in rows], "campaign_id string, iter bigint, new_locations array<string>, logged_at timestamp")
    linker, all_ = link_history(s, i)
    assert sorted((r.campaign, r.iter, r.pos) for r in linker.repeated(all_).collect()) == known_before(seen, rows)
    bias, gap, column = linker.weights
    assert all((bias + gap * g + column * c > 0) == (g <= 3) for g, c, _ in linker.kept.notes["patterns"]) and gap < 0
    monkeypatch.setattr(Linker, "score", lambda self: F.lit(1.0))
    linker, all_ = link_history(s, i)
    assert linker.repeated(all_).count() > len(known_before(seen, rows))


def test_learned():
    assert learned([]) and learned([(0, True, True, 5)])
    for patterns in ([(0, True, True, 900), (3, False, True, 1), (4, True, False, 1), (15, False, False, 9)], [(1, False, True, 10**9), (3, True, True, 2), (4, False, False, 10**6), (4, True, False, 1)]):
        bias, gap, column = learned(patterns)
        assert all((bias + gap * g + column * c > 0) == label for g, c, label, _ in patterns)


def test_history_opens_again_and_touches_few_clusters(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([("c", "compiler/a.rs", line, None, it, 0) for line, it in r], "campaign string, file string, line bigint, col bigint, iter bigint, pos bigint")
    path = f"file://{tmp_path}/places"
    Linker(spark, path=path, clusters=True, rows=40).add(rows(*[(line, 1) for line in range(0, 9000, 6)]))
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    before = size()
    again = Linker(spark, path=path, clusters=True, rows=40)
    assert again.weights != [0.0, 0.0, 0.0]
    again.add(rows((3, 7), (9, 7), (600, 8)))
    assert size() - before < 0.1 * before
    assert {r.line for r in again.repeated(rows((3, 7), (9, 7), (600, 8), (12, 1))).collect()} == {3, 9, 600}
    roots = Counter(r.root for r in Linker(spark, path=path, clusters=True).clusters().collect())
    assert sorted(roots.values())[-2:] == [1, 5] and len(roots) == 1498
    assert Linker(spark, path=path).known().count() == 1502


def test_linkage_of_nothing(spark):
    s = spark.createDataFrame([], "campaign_id string, location string, first_iter bigint")
    i = spark.createDataFrame([], "campaign_id string, iter bigint, new_locations array<string>, logged_at timestamp")
    linker, all_ = link_history(s, i)
    assert linker.repeated(all_).count() == 0


# 7


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé", max_size=9), max_size=400))
def test_burst_trie(terms):
    trie = BurstTrie()
    for t in terms:
        trie.add(t, 2, 1)
    got = Counter()
    for route, ends, leaf in trie.subtrees():
        for suffix, (occurrences, records) in (leaf or {}).items():
            assert not ends or suffix == ""
            assert occurrences == 2 * records
            got[route + suffix] += records
    assert got == Counter(terms)


def test_subtrees_of_different_depth_become_one(spark):
    """Tries that burst at different places: a route is a leaf here and an inner node there, and terms end at both."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows, want = [], Counter()
    for size in (3, 90, 2500):
        trie = BurstTrie()
        for _ in range(size):
            term = "x" + word(rng.randrange(0, 14))
            trie.add(term, 3, 1)
            want[term] += 1
        rows += [("f", route, ends, list(leaf) if leaf else None, [c[0] for c in leaf.values()] if leaf else None, [c[1] for c in leaf.values()] if leaf else None) for route, ends, leaf in trie.subtrees()]
    df = spark.createDataFrame(rows, terms._COLUMNS)
    got = terms.merged_subtrees(df).collect()
    assert len(got) == len(want) and {r.term: r.records for r in got} == want and all(r.occurrences == 3 * r.records for r in got)
    leaves = {r[1] for r in rows if r[3] and not r[2]}
    assert leaves & {r[1] for r in rows if r[3] is None}


def test_marked_terms(spark):
    rows = [("f", k, ["all", "all", None] + [f"t{k % 150}"] * (k % 150 < 100)) for k in range(300)] + [("f", 1, ["all"]), ("f", 900, None), ("f", 901, [None]), ("f", 902, []), ("f", 903, [""]), (None, 1, ["x"]), ("f", None, ["x"]), ("g", 1, ["é"])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "field string, id bigint, terms array<string>, records int, term string")
    got = {(r.field, r.term): (r.occurrences, r.records, r.of_records, r.mark) for r in marked_terms(df).collect()}
    assert got["f", "all"][1:] == (300, 301, "common") and got["f", ""] == (1, 1, 301, "rare") and got["g", "é"] == (1, 1, 1, "rare")
    assert got["f", "t5"] == (2, 2, 301, "rare") and len(got) == 103
    assert marked_terms(df.limit(0)).count() == 0


# 8


@needs_vocabulary
def test_tokens_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeiorst  \n\t019é漢\U0001f600'<|>") for _ in range(rng.randrange(300))) for _ in range(400)]
    texts += ["<|endoftext|>", " " * 999, "a" * 20_000, "x\u00a0\u2003 y", "don't we'LL", None, ""]
    df = spark.createDataFrame([(k, t, [1], "clash") for k, t in enumerate(texts)] + [(None, "b", [2], "clash")], "doc_id bigint, text string, ids array<int>, k string")
    got = {r.doc_id: list(r.ids) for r in encode_column(df, "doc_id", "text").collect()}
    want = {k: e.ids for k, e in enumerate(public.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert got == want | {None: public.encode("b").ids}
    back = decode_column(encode_column(df, "doc_id", "text"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)} | {None: "b"}
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_round_trip(text):
    words = vocabulary(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert words.decode(words.encode(text)) == text


# 9


@needs_vocabulary
def test_mixing(spark):
    rng = random.Random(2)
    docs = [(k, f"s{k % 3}" if k % 10 else None, " ".join(rng.choice([f"alpha{k % 3}", "beta", "gamma"]) for _ in range(rng.randrange(1, 60)))) for k in range(600)]
    docs += [(9001, "s0", None), (9002, "s0", ""), (None, "s0", "text"), (9003, "s9", "text")]
    targets = [("m", "s0", 3.0, 2), ("m", "s0", 3.0, 2), ("m", "s1", 1.0, None), ("m", "s2", 0.0, 5), ("m", "gone", 2.0, 5), ("n", "s2", None, 1), ("n", "s1", 0.5, 3), (None, "s1", 1.0, 1), ("n", None, 1.0, 1)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, source string, text string, mix_name string, domain int")
    goals = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = mixed(df, goals)
    got = {(r.mix_name, r.source): r for r in shares.collect()}
    assert set(got) == {("m", "s0"), ("m", "s1"), ("m", "s2"), ("m", "gone"), ("n", "s2"), ("n", "s1")}
    assert abs(got["m", "s0"].actual_share - 0.75) < 0.01 and abs(got["m", "s1"].actual_share - 0.25) < 0.01
    assert got["m", "s2"].tokens == got["m", "gone"].tokens == got["n", "s2"].tokens == 0 and got["n", "s1"].actual_share == 1.0
    rows = chosen.collect()
    caps = {("m", "s0"): 2, ("m", "s1"): 1, ("n", "s1"): 3}
    assert all(1 <= r.repeats <= caps[r.mix_name, r.source] for r in rows)
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    empty = mixed(df, goals.limit(0))
    assert empty[0].count() == 0 == empty[1].count()
    assert mixed(df.limit(0), goals)[1].agg(F.sum("tokens")).first()[0] == 0


# 10


def test_disguises():
    assert {plain_word(w) for w in ("idiot", "IDIOT", "1d1ot", "іdiоt", "idi\u200bot", "iddiiot", "i.d.i.o.t")} == {"idiot"}


def test_identifiers_and_code_are_read():
    words = Words()
    idiot = words("idiot", "word")
    for text in ("you_idiot", "iDiOt", "`x = idiot;`", "callIdiotNow", "`You_Idiot`"):
        ids, spans = next(sentences(text, words))
        assert words.hash[idiot] in [words.hash[k] for k in ids]
        assert words.hash[ids[0]] == _hash("<id>") and {text[a:b].lower() for k, (a, b) in zip(ids, spans) if words.hash[k] == words.hash[idiot]} == {"idiot"}
    assert len(next(sentences("plain words here", words))[0]) == 3


def test_marginals_equal_enumeration():
    words = Words()
    found = [ids for ids, _ in sentences("you are a moron. fine code here!\nok", words)]
    batch = Batch(found, words)
    weights = np.random.default_rng(1).normal(size=1 << 18)
    emit = weights[batch.features].sum(1)
    moved, share = np.zeros((2, 2)), np.array([1.0, 0.5, 2.0])
    got = batch.marginals(weights, STEPS, moved, share)
    want = np.zeros((2, 2))
    for s, n in enumerate(batch.sizes):
        e = emit[batch.begin[s] : batch.begin[s] + n]
        total, tagged, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for mask in range(1 << n):
            y = [(mask >> k) & 1 for k in range(n)]
            p = np.exp(sum(e[k] for k in range(n) if y[k]) + sum(STEPS[y[k - 1], y[k]] for k in range(1, n)))
            total += p
            tagged += p * np.array(y)
            for k in range(1, n):
                pairs[y[k - 1], y[k]] += p
        want += pairs / total * share[s]
        assert np.allclose(got[batch.begin[s] : batch.begin[s] + n], tagged / total)
    assert np.allclose(moved, want)


def test_long_sentences_are_one_chain():
    words = Words()
    found = [ids for ids, _ in sentences("word " * 3000 + "\nshort one", words)]
    assert [len(f) for f in found] == [3000, 2]
    weights = np.random.default_rng(1).normal(size=1 << 18)
    both, alone = Batch(found, words), Batch(found[1:], words)
    assert np.allclose(both.marginals(weights, STEPS)[3000:], alone.marginals(weights, STEPS))


def test_kinds_of_one_spelling_are_kept_apart():
    words = Words()
    assert words("abcd", "word") != words("abcd", "code") and words("abcd", "word") == words("abcd", "word")


def test_harmless_text_after_an_insult_does_not_dilute_it(spark):
    words = Words()
    insult, rest = "shut up you stupid moron now", "then we look at how the parser keeps the next token in its list of tokens and writes"
    known = {_hash("w", plain_word(w)) % SIZE for w in insult.split()}
    weights = np.full(SIZE, 0.0, np.float32)
    weights[[_hash("w", plain_word(w)) % SIZE for w in rest.split()]] = -6
    weights[list(known)] = 6
    text = f"{rest} {insult} {rest} {insult} {rest}"
    batch = Batch([ids for ids, _ in sentences(text, words)], words)
    assert batch.sentence_scores(batch.marginals(weights, STEPS)).max() < THRESHOLD
    got = score_documents(spark.createDataFrame([(1, text), (2, rest), (3, "fine")], "id bigint, text string"), "id", "text", np.append(weights, STEPS)).orderBy("id").collect()
    assert got[0].score >= THRESHOLD > max(got[1].score, got[2].score)
    assert [text[x.start : x.end] for x in got[0].spans] == [insult] * 2


def test_scores_on_held_out_documents(spark):
    rng = random.Random(4)
    clean = ["the parser drops a token", "kill the child process", "my own patch was crap", "the filter masks the word idiot in logs", "i feel like an idiot today"]
    bad = ["shut up you stupid idiot", "you are a worthless moron", "nobody wants you here, scum", "i will strangle you"]

    def doc(abusive):
        parts = [rng.choice(clean) for _ in range(rng.randrange(1, 5))] + [rng.choice(bad)] * abusive
        rng.shuffle(parts)
        return ". ".join(parts)

    docs = [(k, doc(k % 3 == 0), int(k % 3 == 0) if rng.random() > 0.04 else int(k % 3 != 0)) for k in range(400)]
    df = spark.createDataFrame(docs + [(5000, None, 1), (5001, "", 0), (5002, "text", None)], "id bigint, text string, abusive int")
    weights = fit(df)
    tests = [(k, doc(k % 2 == 0), 1.0, "clash") for k in range(200)] + [(901, None, 1.0, ""), (902, "", 1.0, ""), (903, "x " * 50_000, 1.0, ""), (None, "fine", 1.0, "")]
    scored = score_documents(spark.createDataFrame(tests, "id bigint, text string, score double, spans string"), "id", "text", weights).collect()
    by = {r.id: r for r in scored}
    right = sum((by[k].score >= 0.6) == (k % 2 == 0) for k in range(200))
    assert right >= 190 and len(scored) == 204
    assert by[901].score == by[902].score == 0 and by[901].spans == []
    texts = {t[0]: t[1] for t in tests}
    hit = next(r for r in scored if r.id is not None and r.id < 200 and r.id % 2 == 0 and r.spans)
    assert any(b.split()[-1] in texts[hit.id][hit.spans[0].start : hit.spans[0].end] for b in bad)
    assert score_documents(df.limit(0), "id", "text", fit(df.limit(0))).count() == 0
