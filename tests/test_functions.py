import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraglight.functions import families as fam
from fraglight.functions import termination as term
from fraglight.functions import text as tx
from fraglight.operators import bundles, diagnostics, spans
from fraglight.operators.execute import executed
from fraglight.operators.ranking import indexed
from fraglight.sources import files as fs


def one(spark, column, schema="x int", rows=((1,),)):
    return spark.createDataFrame(list(rows), schema).select(column.alias("v")).first()[0]


def lit(v):
    return F.lit(v)


def test_families(spark):
    assert len(fam.ROWS) == 142 and len({k for k, _, _ in fam.ROWS}) == 101
    assert one(spark, fam.families_of(lit("array_type"))) == ["Type"]
    assert {"Literal", "Expr", "Pattern"} <= set(one(spark, fam.families_of(lit("integer_literal"))))
    assert one(spark, fam.buckets_of(lit("array_expression"))) == ["Expr"]
    assert one(spark, fam.buckets_of(lit(None).cast("string"))) == [""]
    assert one(spark, fam.buckets_of(lit("no_such_kind"))) == ["no_such_kind"]
    assert one(spark, fam.families_with_parent(lit("identifier"), lit("array_type"))) == []
    assert one(spark, fam.compatible(lit("array_expression"), lit("call_expression")))
    assert not one(spark, fam.compatible(lit("array_type"), lit("array_expression")))
    assert fam.kind_family(spark).count() == 142


@pytest.mark.parametrize("a,b,want", [((0, 5), (3, 8), (3, 5)), ((0, 3), (5, 8), None), ((0, 5), (5, 8), None)])
def test_intersection(spark, a, b, want):
    got = one(spark, spans.intersection(*map(lit, (*a, *b))))
    assert (tuple(got) if got else None) == want
    assert one(spark, spans.overlaps(*map(lit, (*a, *b)))) == (want is not None)


def test_containment(spark):
    assert one(spark, spans.contains(*map(lit, (0, 5, 2, 4))))
    assert not one(spark, spans.contains(*map(lit, (1, 5, 0, 6))))


def test_overlap_join_counts_pairs_once_across_bins(spark):
    a = spark.createDataFrame([("f", 0, 100), ("f", 50, 60), ("f", 5, 5)], "k string, s bigint, e bigint")
    b = spark.createDataFrame([("f", 10, 90), ("f", 60, 70), ("g", 0, 9)], "k string, s2 bigint, e2 bigint")
    got = sorted(map(tuple, spans.overlap_join(a, b, ["k"], width=8).select("s", "e", "s2", "e2").collect()))
    assert got == [(0, 100, 10, 90), (0, 100, 60, 70), (50, 60, 10, 90)]


def test_splices(spark):
    def run(text, edits):
        e = F.array(*(F.struct(lit(s).cast("bigint").alias("s"), lit(x).cast("bigint").alias("e"), lit(t).alias("t")) for s, x, t in edits))
        return one(spark, tx.splice(lit(text), e))

    assert run("hello world", [(6, 11, "rust")]) == "hello rust"
    assert run("aaa bbb ccc", [(8, 11, "YYY"), (0, 3, "XXX")]) == "XXX bbb YYY"
    assert run("aaa bbb ccc", [(0, 5, "X"), (3, 7, "no"), (8, 11, "Z")]) == "Xbb Z"
    assert run("aé z", [(1, 3, "e")]) == "ae z"
    assert run("abc", [(2, 9, "x")]) == "abc"


def brute(haystack, needle):
    """Spans by comparing at every place."""
    kept = [(i, c) for i, c in enumerate(haystack) if not (c.isspace() or c == ",")]
    want = [c for c in needle if not (c.isspace() or c == ",")]
    out, at = [], 0
    while want and at + len(want) <= len(kept):
        if [c for _, c in kept[at : at + len(want)]] == want:
            size = lambda k: len(haystack[:k].encode())
            out.append((size(kept[at][0]), size(kept[at + len(want) - 1][0] + 1)))
            at += len(want)
        else:
            at += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab ,\né", max_size=40), st.text("ab ,", max_size=4))
def test_stripped_search(haystack, needle):
    assert tx.find_stripped(haystack, needle, bound=0) == brute(haystack, needle)
    assert tx.find_stripped(haystack, needle) == brute(haystack, needle)[:9]


def test_stripped_search_cases(spark):
    assert tx.find_stripped("let v = vec![1,\n  2];", "vec![1, 2]") == [(8, 20)]
    assert tx.find_stripped("abc", " \n") == []
    assert tx.find_stripped("x x x", "x", start=1) == [(2, 3), (4, 5)]
    texts = spark.createDataFrame([(1, "a b a b", 0), (2, None, 0), (3, "é ab", 0)], "t int, h string, s int")
    needles = spark.createDataFrame([("x", "ab"), ("y", None), ("z", " ,"), ("w", "é")], "n string, part string")
    pairs = texts.select("t").crossJoin(needles.select("n"))
    want = [(1, "x", 0, 3, 0), (1, "x", 4, 7, 1), (3, "w", 0, 2, 0), (3, "x", 3, 5, 0)]
    assert sorted(map(tuple, tx.located(pairs, texts, "t", "h", needles, "n", "part").collect())) == want
    assert tx.located(pairs.limit(0), texts, "t", "h", needles, "n", "part").count() == 0


def test_comments_and_paths(spark):
    assert one(spark, tx.without_comments(lit("a // b\nc /* d\ne */ f /* g"))) == "a \nc  f "
    assert one(spark, tx.compiler_location(lit("/x/compiler/a.rs:1"))) == "compiler/a.rs:1"
    assert one(spark, tx.compiler_location(lit("library/a.rs:1"))) is None
    assert one(spark, tx.json_name(lit("a/b.c/d.rs"))) == "a/b.c/d.json"
    assert one(spark, tx.dependency_prefix(F.array(lit("b"), lit("a\n"), lit("b")))) == "a\nb\n"
    assert one(spark, tx.provenance(lit("s"), F.array(lit("d")))) == "\n\n// s\n// d\n"
    text = one(spark, tx.prompt(lit("SRC"), "FRONT ", "END"))
    assert text.index("FRONT") < text.index("SRC") < text.index("END")


def crashes(spark, text):
    return [tuple(x) for x in one(spark, diagnostics.crashes(lit(text)))]


def test_crashes(spark):
    assert crashes(spark, "thread 'rustc' (12) panicked at compiler/a.rs:1:2: boom") == [("compiler/a.rs:1:2", "boom")]
    assert crashes(spark, "thread 'rustc' panicked at compiler/a.rs:1:2:\r\n  boom \n") == [("compiler/a.rs:1:2", "boom")]
    assert crashes(spark, "error: internal compiler error: compiler/a.rs:1:2: bad\nnote: delayed at compiler/b.rs:3 - x") == [("compiler/a.rs:1:2", "bad"), ("compiler/b.rs:3", " - x")]
    assert crashes(spark, "thread 'rustc' panicked at a:\n\n") == []
    head = "thread 'rustc' panicked at a.rs:1:1:"
    assert crashes(spark, f"{head}\n{head}\nreason") == [("a.rs:1:1", head)]
    assert crashes(spark, "error[E1]: no") == [] and one(spark, diagnostics.crashes(lit(None).cast("string"))) == []


def test_first_sightings(spark):
    df = spark.createDataFrame([("b", 2, "y"), ("a", 1, "x"), ("a", 3, "z")], "location string, n int, reason string")
    got = sorted(map(tuple, diagnostics.first_sightings(df, ["location"], ["n"]).select("location", "reason").collect()))
    assert got == [("a", "x"), ("b", "y")]


def test_termination(spark):
    assert one(spark, term.label(lit("Signal"), lit(9))) == "SIGKILL (9)"
    assert one(spark, term.label(lit("Signal"), lit(77))) == "SIG? (77)"
    assert one(spark, term.label(lit("WallTimeout"), lit(None).cast("int"))) == "WALL_TIMEOUT"
    assert one(spark, term.reclassified(lit("Signal"), lit(6), lit("Memory allocation of 9 bytes failed"))) == "MemoryExceeded"
    assert one(spark, term.reclassified(lit("Signal"), lit(11), lit("out of memory"))) == "Signal"


def test_commands_and_log(spark):
    args = bundles.command("rustc", F.array(lit("--emit=mir")), lit("fn x() {}"), lit("a.rs"), extra=["-Z"])
    assert one(spark, args) == ["prlimit", "--as=1073741824", "--cpu=10", "rustc", "--emit=mir", "--crate-type=lib", "a.rs", "-Z"]
    block = bundles.iteration_block(lit(3), lit(None).cast("bigint"), lit(0), lit(0), F.array(lit("a")))
    assert one(spark, block) == "[3] SKIPPED (mutator failure)\n"


def test_indexed_is_a_dense_order(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id * 7 % 1000 AS x", "if(id % 3 = 0, 'hot', cast(id % 5 AS string)) AS g")
    rows = indexed(df, ["x"], ["g"], "n").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.x):
        by.setdefault(r.g, []).append(r.n)
    assert all(v == list(range(len(v))) for v in by.values()) and len(rows) == 1000


def test_execution(spark):
    df = spark.createDataFrame(
        [("ok", ["sh", "-c", "cat {file} >&2; exit 3"], "text"), ("slow", ["sh", "-c", "echo begun >&2; sleep 30"], None), ("killed", ["sh", "-c", "kill -9 $$"], ""), ("none", ["/no/such/program"], "")],
        "n string, args array<string>, source string",
    )
    got = {r.n: (r.kind, r.exit_status, r.signal, r.stderr) for r in executed(df, "args", "source", seconds=2).collect()}
    assert got["ok"] == ("Normal", 3, None, "text")
    assert got["slow"] == ("WallTimeout", None, None, "begun\n")
    assert got["killed"][:3] == ("Signal", None, 9) and got["none"][0] == "SpawnFailed"


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.rs").write_text("fn main() {}")
    (tmp_path / "a" / "y.rs").write_bytes(b"bad \xff")
    (tmp_path / "a" / "z.RS").write_text("no")
    (tmp_path / "iteration_3.txt").write_text("")
    (tmp_path / "iteration_12.txt").write_text("")
    (tmp_path / "flags").write_text("# c\n\n -Zx \n--y\n")
    (tmp_path / "wrong").write_text("-a/b\n")
    got = {r.rel: (r.text, r.valid) for r in fs.source_files(spark, str(tmp_path / "a")).collect()}
    assert got == {"b/x.rs": ("fn main() {}", True), "y.rs": ("bad \ufffd", False)}
    assert fs.next_iteration(spark, str(tmp_path)) == 13
    assert fs.next_iteration(spark, str(tmp_path / "a")) == 0
    assert fs.options(spark, str(tmp_path / "flags")) == ["-Zx", "--y"]
    with pytest.raises(ValueError):
        fs.options(spark, str(tmp_path / "wrong"))
    assert fs.gathered(spark, str(tmp_path / "a" / "y.rs"), str(tmp_path / "a")).count() == 3


def test_stream_goes_on(spark, tmp_path):
    from fraglight.streaming.dedup import first_seen

    folder, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    stream = lambda: spark.readStream.schema("k string").parquet(folder)
    spark.createDataFrame([("a",), ("b",), ("a",)], "k string").write.parquet(folder)
    assert sorted(r.k for r in first_seen(stream(), ["k"], state, out).collect()) == ["a", "b"]
    spark.createDataFrame([("b",), ("c",)], "k string").write.mode("append").parquet(folder)
    assert sorted(r.k for r in first_seen(stream(), ["k"], state, out).collect()) == ["a", "b", "c"]
