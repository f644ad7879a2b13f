import itertools

import pytest
from pyspark.sql import functions as F

from fraglight.functions.families import FAMILIES
from fraglight.operators import splicing as sp
from fraglight.operators.mutate import PROFILES, Config
from fraglight.operators.nodes import structures, syntax_nodes

TEXTS = {1: "fn f(x: u8) -> Foo { let y = 1; g(y, \"a\"); }\nstruct Foo;", 2: "fn é(é: i32) { b('c'); }", 3: "", 4: "static A: u8 = 1;"}
SNIPPETS = [
    (1, "a.rs", "identifier", "val", [1, 2], [("val", "identifier"), ("val", None)], "source"),
    (2, "b.rs", "integer_literal", "x + 12", [2], [("x", "identifier")], "source"),
    (3, "c.rs", "function_item", "fn h() {}", None, None, "fragment"),
    (4, None, "primitive_type", "str", [], [], "source"),
    (5, "d.rs", None, "nokind", None, None, "fragment"),
    (6, "e.rs", "block", None, None, None, "source"),
    (7, "f.rs", "attribute_item", "#[inline]", [3], [], "source"),
    (8, "g.rs", "identifier", "other", None, None, "fragment"),
]
SNIPPET = "snippet_id bigint, filename string, kind string, fragment string, deps array<bigint>, placeholders array<struct<ph:string,kind:string>>, source string"


@pytest.fixture(scope="module")
def given(spark):
    files = spark.createDataFrame([(k, t, f"seed{k}.rs") for k, t in TEXTS.items()], "file_id bigint, text string, seed string")
    nodes = structures(syntax_nodes(files, "file_id", "text")).cache()
    snippets = spark.createDataFrame(SNIPPETS, SNIPPET)
    deps = spark.createDataFrame([(1, "use b;"), (2, "use a;\n"), (3, None)], "dep_id bigint, dep string")
    return files, nodes, snippets, deps


def families(kind):
    own = [f for f, kinds in FAMILIES.items() if kind in kinds]
    return own or [kind if kind is not None else ""]


@pytest.mark.parametrize("draws", [6, 1])
def test_slots_equal_draws_one_by_one(spark, given, monkeypatch, draws):
    """By number first; attempts that lack slots after so many draws go on by the least hash."""
    monkeypatch.setattr(sp, "DRAWS", draws)
    files, nodes, *_ = given
    tries = sp.attempts(files, "file_id", Config(per_seed=15))
    got: dict = {}
    for r in sp.drawn_slots(nodes, tries, "file_id").orderBy("n").collect():
        got.setdefault(r.attempt, []).append((r.s, r.e, r.kind))
    own: dict = {}
    for r in nodes.filter("s < e").orderBy("node_id").collect():
        own.setdefault(r.file_id, []).append((r.s, r.e, r.kind))
    sizes = spark.createDataFrame([(k, len(v)) for k, v in own.items()], "file_id bigint, nodes bigint")
    numbers = F.array(*(F.pmod(sp.pick(F.col("attempt"), F.lit(str(k)), F.lit("slot")), F.col("nodes")) for k in range(draws * sp.SLOTS)))
    rows = tries.join(sizes, "file_id").select("file_id", "attempt", numbers.alias("numbers"), F.pmod(sp.pick(F.col("attempt"), F.lit("times")), F.lit(7)).alias("d")).collect()
    hashed: dict = {}
    for r in tries.join(nodes, "file_id").filter("s < e").select("attempt", F.xxhash64("attempt", "node_id").bitwiseAND((1 << 63 - sp.NODE_BITS) - 1).alias("h"), "s", "e", "kind").collect():
        hashed.setdefault(r.attempt, []).append((r.h, (r.s, r.e, r.kind)))
    want = {}
    for r in rows:
        times, taken = 1 if r.d < 3 else 2 if r.d < 6 else 3, []
        for m in [own[r.file_id][n] for n in r.numbers] + [m for _, m in sorted(hashed[r.attempt])]:
            if len(taken) < times and all(m[1] <= s or e <= m[0] for s, e, _ in taken):
                taken.append(m)
        want[r.attempt] = taken
    assert got == want and {len(v) for v in got.values()} == {1, 2, 3}


def test_passes(spark, given):
    files, nodes, *_ = given
    tries = sp.attempts(files.filter("file_id = 1"), "file_id", Config(per_seed=40))
    got = [r["count"] for r in sp.drawn_slots(nodes, tries, "file_id", Config(passes=(2, 3))).groupBy("attempt").count().collect()]
    assert set(got) <= {1, 2, 3} and {2, 3} <= set(got)  # one only where that covers everything


@pytest.mark.parametrize("both", [True, False])
def test_snippets_fit_their_slots(spark, given, both):
    files, nodes, snippets, _ = given
    config = Config(both=both, per_seed=60)
    pool = sp.snippet_pool(snippets.filter("fragment is not null"), "source", "kind", "snippet_id")
    slots = sp.drawn_slots(nodes, sp.attempts(files, "file_id", config), "file_id")
    drawn = sp.drawn_snippets(slots, pool, config).collect()
    kinds = {s[0]: (s[2], s[6]) for s in SNIPPETS}
    assert len(drawn) == len({(r.attempt, r.n) for r in drawn})
    assert all(r.bucket in families(kinds[r.snippet_id][0]) and kinds[r.snippet_id][1] == r.domain for r in drawn)
    assert {r.domain for r in drawn} == ({"source", "fragment"} if both else {"source"})
    strange = sum(r.bucket not in families(r.kind) for r in drawn)
    assert 0 < strange < 0.2 * len(drawn)  # a tenth takes any bucket


def test_placeholder_values_come_from_nodes_that_fit(spark, given):
    files, nodes, *_ = given
    rows = [(f"1#{k}", 0, 1, [("p", "identifier"), ("q", None), ("r", "primitive_type"), ("t", "no_such_kind")]) for k in range(80)]
    drawn = spark.createDataFrame(rows, "attempt string, n int, file_id bigint, placeholders array<struct<ph:string,kind:string>>")
    got = [x for r in sp.placeholder_values(drawn, nodes, files, "file_id", "text").collect() for x in zip(r.names, r.values)]
    texts = {(TEXTS[1].encode()[r.s : r.e].decode(), r.kind) for r in nodes.filter("file_id = 1").collect()}
    fits = {n: {t for t, k in texts if set(families(k)) & set(families(kind))} for n, kind in (("p", "identifier"), ("r", "primitive_type"))}
    assert {n for n, _ in got} == {"p", "r"} and all(v in fits[n] for n, v in got)
    assert {v for n, v in got if n == "p"} == fits["p"] and 20 < sum(n == "p" for n, _ in got) < 60


def test_mutants_are_their_edits(spark, given):
    files, nodes, snippets, deps = given
    config = Config(placeholders=False, per_seed=20)
    tries = sp.attempts(files, "file_id", config)
    made = {r.attempt: r for r in sp.spliced(nodes, files, tries, snippets, deps, config, "file_id", "text").collect()}
    usable = snippets.filter("fragment is not null")
    slots: dict = {}
    for r in sp.drawn_snippets(sp.drawn_slots(nodes, tries, "file_id"), sp.snippet_pool(usable, "source", "kind", "snippet_id"), config).orderBy("n").collect():
        slots.setdefault(r.attempt, []).append(r)
    assert made and set(made) <= set(slots)
    by_id, texts = {s[0]: s for s in SNIPPETS}, {1: "use b;\n", 2: "use a;\n"}
    for attempt, rs in slots.items():
        front = "".join(sorted({texts[d] for r in rs for d in by_id[r.snippet_id][4] or [] if d in texts}))
        possible = set()
        for kept in itertools.product((True, False), repeat=len(rs)):
            raw = TEXTS[rs[0].file_id].encode()
            for r, keep in sorted(zip(rs, kept), key=lambda x: -x[0].s):
                raw = raw[: r.s] + (by_id[r.snippet_id][3] if keep else "").encode() + raw[r.e :]
            possible.add(front + raw.decode() if raw else None)
        assert (made[attempt].mutant if attempt in made else None) in possible
        if attempt in made:
            assert made[attempt].others == [by_id[r.snippet_id][1] for r in rs if by_id[r.snippet_id][1]]


def test_all_ways(spark, given):
    files, nodes, snippets, deps = given
    got = sp.mutants(nodes, files, snippets, deps, Config(splice=30, per_seed=25), "file_id", "text", "seed").collect()
    assert {r.way for r in got} == {"splice", "type", "value", "attribute"} and len(got) == len({r.attempt for r in got})
    assert all(f"\n\n// seed{r.file_id}.rs\n" in r.content for r in got) and 3 not in {r.file_id for r in got}
    again = sp.mutants(nodes, files, snippets, deps, Config(splice=30, per_seed=25), "file_id", "text", "seed").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_texts_are_not_sent_to_the_driver(spark, given):
    """However small their files are: packed texts take many times that in memory."""
    files, nodes, snippets, deps = given
    made = sp.mutants(nodes, files, snippets, deps, PROFILES["baseline"], "file_id", "text", "seed")
    assert made.count() > 20 and "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("profile", ["source-only-no-other-no-misc", "half-dep-prob"])
def test_nothing_to_splice(spark, given, profile):
    files, nodes, snippets, deps = given
    assert sp.mutants(nodes, files.limit(0), snippets, deps, PROFILES[profile], "file_id", "text", "seed").count() == 0
    assert sp.spliced(nodes, files, sp.attempts(files, "file_id", Config()), snippets.limit(0), deps, PROFILES[profile], "file_id", "text").count() == 0
