from pyspark.sql import functions as F

from fraglight.operators.campaign import Campaign
from fraglight.operators.mutate import TYPES, fill, filled, type_mutants
from fraglight.operators.nodes import annotated, parse, syntax_nodes


def test_parse():
    kinds = [k for *_, k in parse('fn main() { let x = 1; let s = "a}b"; } // c\nstruct A;')]
    assert kinds.count("let_declaration") == 2 and "function_item" in kinds and "integer_literal" in kinds and "struct_item" in kinds
    text = "fn a() { b(1); }\nfn c() {}"
    spans = {(text[s:e], k) for _, _, s, e, k in parse(text)}
    assert ("fn a() { b(1); }", "function_item") in spans and ("fn c() {}", "function_item") in spans
    assert parse("")[0][4] == "source_file" and len(parse("}}}((")) == 3


def test_annotation(spark):
    source = "use std::fmt;\nfn é() { let x: Foo = Foo::new(1); }"
    files = spark.createDataFrame([(1, source), (2, None)], "file_id bigint, text string")
    rows = [(1, "use  std::fmt;"), (2, "absent"), (3, "Foo"), (4, "fn é() { /* c */ let x: Foo = Foo::new(1); }")]
    fragments = spark.createDataFrame(rows, "n int, fragment string")
    pairs = fragments.select(F.lit(1).cast("bigint").alias("file_id"), "n")
    got = {r.n: r.node_kind for r in annotated(pairs, syntax_nodes(files, "file_id", "text"), files, "file_id", "text", fragments, "n", "fragment").collect()}
    assert got == {1: "use_declaration", 2: None, 3: "type_identifier", 4: "function_item"}


def test_annotation_without_comments(spark, tmp_path):
    from fraglight.plans.queries import annotate_kinds

    files = [(1, "s", "fn main() { let x: Foo = new(1); }\nfn other() {}"), (2, "s", "struct A { /* of a */ long_name: u8, // b\n other_name: u16 }"), (3, "t", "fn far() {}")]
    snippets = [
        (1, "s", "/* a comment that no file has */ let x: Foo = new(1);"), (2, "s", "struct A { long_name: u8, other_name: u16 }"), (3, "s", "// other words\nlong_name: u8, other_name: u16"),
        (4, "s", "absent from all files"), (5, "u", "fn far() {}"), (6, None, "fn far() {}"), (7, "t", "fn far() {}"), (8, "s", "//x\nA"), (9, "s", None),
    ]
    spark.createDataFrame(files, "file_id bigint, seed_file string, file_text string").write.parquet(f"{tmp_path}/mutant_files.parquet")
    spark.createDataFrame([(*r, ["d"]) for r in snippets], "snippet_id bigint, filename string, fragment string, deps array<string>").write.parquet(f"{tmp_path}/snippets.parquet")
    got = sorted((r.snippet_id, r.file_id, r.node_kind) for r in annotate_kinds(spark, str(tmp_path)).collect())
    assert got == [(1, 1, "let_declaration"), (2, 2, "struct_item"), (3, 2, "identifier"), (4, None, None), (5, None, None), (6, None, None), (7, 3, "function_item"), (8, 2, "type_identifier")]


def test_placeholders(spark):
    assert fill("let (mut x, mut y) = foo;", [("x", "a"), ("y", "b")]) == "let (mut a, mut b) = foo;"
    assert fill("let x: Box<i32> = Box::new(x);", [("x", "val")]).count("Boval") == 0
    assert fill("a a a", [("a", "b")]) == "b b a"
    df = spark.createDataFrame([("x + y", ["x", "y"], ["1", None]), (None, ["x"], ["1"]), ("x", None, None)], "f string, n array<string>, v array<string>")
    assert [r.filled for r in filled(df, "f", "n", "v").collect()] == ["1 + y", None, "x"]


def test_type_mutants(spark):
    files = spark.createDataFrame([(1, "fn f(x: u8) {}"), (2, "fn g() {}")], "file_id bigint, text string")
    got = type_mutants(syntax_nodes(files, "file_id", "text"), files, "file_id", "text").collect()
    assert [r.file_id for r in got] == [1] and got[0].mutant in {f"fn f(x: {t}) {{}}" for t in TYPES}


def test_campaign_goes_on(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    ice = "error: internal compiler error: compiler/{}.rs:1:1: x"
    runs = lambda *names: spark.createDataFrame([(f"f{n}", ice.format(n)) for n in names] + [("ok", None)], "file string, stderr string")
    assert Campaign(spark, folder).step(runs("a", "b")) == 0
    assert Campaign(spark, folder).step(runs("b", "c")) == 1
    # a batch that was cut off after its places were written
    spark.createDataFrame([("compiler/d.rs:1:1", 2, "fd")], "location string, first_iter bigint, file string").write.mode("append").parquet(f"{folder}/seen")
    again = Campaign(spark, folder)
    again.run(lambda n: runs("d"), lambda df: df.select("file", F.col("stderr")), 1)
    got = [tuple(r) for r in again.log().orderBy("iter").collect()]
    assert got == [(0, 3, 2, 2, 2), (1, 3, 2, 1, 3), (2, 2, 1, 1, 4)]
    assert again.seen().count() == 4


def test_candidates_hold_every_match(spark):
    import random

    from fraglight.operators.locate import candidates

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcé ,\n") for _ in range(n))
    texts = [(k, k % 3, word(rng.randrange(0, 200))) for k in range(40)] + [(100, 1, None), (101, None, "abc")]
    needles = [(k, k % 3, t[a : a + n]) for k in range(200) for t in [texts[rng.randrange(40)][2]] for a in [rng.randrange(0, len(t) + 1)] for n in [rng.randrange(0, 60)]]
    needles += [(900, 1, None), (901, None, "a"), (902, 1, " ,")]
    t = spark.createDataFrame(texts, "t int, seed int, body string")
    n = spark.createDataFrame(needles, "n int, seed int, part string")
    got = {tuple(r) for r in candidates(t, n, "seed", "t", "body", "n", "part").collect()}
    plain = lambda x: x.replace(" ", "").replace(",", "").replace("\n", "")
    want = {(a, b) for a, g, x in texts for b, h, y in needles if x is not None and y is not None and g == h and g is not None and plain(y) and plain(y) in plain(x)}
    assert want <= got and want


def test_campaign_has_a_budget_and_refuses_other_folders(spark, tmp_path):
    import pytest

    runs = spark.createDataFrame([("f", "error: internal compiler error: compiler/a.rs:1:1: x"), ("g", None)], "file string, stderr string")
    campaign = Campaign(spark, f"file://{tmp_path}/c")
    campaign.header("full", 2.0, ["plain", "opt"])
    ticks, dropped = iter([0, 0, 1, 3]), []
    done = campaign.run(lambda n: runs, lambda df: df, budget=2.0, clock=lambda: next(ticks), cleanup=lambda df: dropped.append([r.file for r in df.collect()]))
    assert done == 2 and dropped == [["g"]] * 2 and campaign.log().count() == 2
    assert [(r.mutator, r.budget_secs, r.variants) for r in campaign.runs().collect()] == [("full", 2.0, "plain, opt")]
    assert Campaign(spark, f"file://{tmp_path}/c").next_iteration() == 2
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file.txt").write_text("x")
    with pytest.raises(ValueError):
        Campaign(spark, f"file://{tmp_path}/other")


def test_sinks(spark, tmp_path):
    from fraglight.sources.files import folders, new_folders
    from fraglight.sources.sinks import drop_each, renamed, write_each

    df = spark.createDataFrame([("a/b.rs", "é"), ("a/b.rs", "a"), ("c.rs", ""), ("../x.rs", "no"), (None, "no"), ("d.rs", None)], "rel string, text string")
    before = folders(spark, f"file://{tmp_path}/out")
    got = write_each(df.withColumn("name", renamed("rel", ".txt")), "name", "text", f"file://{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == [("a/b.txt", 2), ("c.txt", 0)]
    assert (tmp_path / "out/a/b.txt").read_text() == "é" and not (tmp_path / "x.txt").exists()
    assert new_folders(before, folders(spark, f"file://{tmp_path}/out")) == ["a"]
    gone = drop_each(spark.createDataFrame([("a/b.txt",), ("a",), ("none",)], "name string"), "name", f"file://{tmp_path}/out").collect()
    assert sorted(map(tuple, gone)) == [("a", False), ("a/b.txt", True), ("none", False)]


def test_strict_answers(spark):
    from fraglight.operators.answers import strict_answers

    good = '{"intro-structures": ["use a;"], "fragments": [{"fragment": "f", "criteria": "1", "dependencies": [], "placeholders": [{"placeholder": "p", "node_kind": null}], "more": 1}], "x": 2}'
    bad = [good.replace('"criteria": "1"', '"criteria": 1'), good.replace('"dependencies": []', '"dependencies": [1]'), good.replace('["use a;"]', "null"), good.replace('{"placeholder": "p", "node_kind": null}', '"p"'), '{"fragments": []}', "[]"]
    rows = [good, f"```json\n{good}\n```", *bad, "prose", None, "", good.replace('"x": 2', '"fragments": []')]
    got = strict_answers(spark.createDataFrame([(n, b) for n, b in enumerate(rows)], "n int, b string"), "b").orderBy("n").collect()
    assert [r.status for r in got] == ["plain", "fenced", *["schema"] * 6, "error", "missing", "error", "error"]
    assert got[1].document.fragments[0].placeholders[0].placeholder == "p" and got[1].document.intro == ["use a;"] and got[2].document is None


def test_placeholders_are_looked_for_from_their_fragment_on(spark):
    from fraglight.operators.answers import placeholder_kinds

    source = "fn x() { let n = 1; }\nfn y() { g(x); }"
    files = spark.createDataFrame([(1, source)], "file_id bigint, text string")
    found = spark.createDataFrame([(1, 7, source.index("fn y"))], "file_id bigint, n bigint, s bigint")
    fragments = spark.createDataFrame([(7, ["x", "y", "absent", None, "1"])], "n bigint, names array<string>")
    got = placeholder_kinds(found, syntax_nodes(files, "file_id", "text"), files, "file_id", "text", fragments, "n", "names").orderBy("p").collect()
    assert [(r.placeholder, r.node_kind) for r in got] == [("x", "identifier"), ("y", "identifier"), ("absent", None), (None, None), ("1", None)]


def test_documents_hold_what_stands_in_a_file(spark, tmp_path):
    import json

    from fraglight.plans.records import annotated_documents

    spark.createDataFrame([(1, "s", "fn f() { let v: Foo = 1; }"), (2, "s", "x")], "file_id bigint, seed_file string, file_text string").write.parquet(f"{tmp_path}/mutant_files.parquet")
    snippets = [(1, "s", "let v: Foo = 1;", [("v", "k"), ("zz", None)], [1]), (2, "s", "absent", None, None)]
    spark.createDataFrame(snippets, "snippet_id bigint, filename string, fragment string, placeholders array<struct<ph:string,kind:string>>, deps array<bigint>").write.parquet(f"{tmp_path}/snippets.parquet")
    got = {r.file_id: json.loads(r.json) for r in annotated_documents(spark, str(tmp_path)).collect()}
    named = [{"placeholder": "v", "node_kind": "identifier"}, {"placeholder": "zz", "node_kind": None}]
    assert got == {1: {"fragments": [{"snippet_id": 1, "fragment": "let v: Foo = 1;", "node_kind": "let_declaration", "placeholders": named}]}}
