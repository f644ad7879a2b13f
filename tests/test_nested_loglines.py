import json
import random
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fraglight.operators import loglines
from fraglight.operators.loglines import log_entries, moment
from fraglight.operators.nested import Index, nested_children

SCHEMA = "output_id bigint, body string, child string, k string"


def children(spark, *bodies):
    df = spark.createDataFrame([(n, b, "clash", "clash") for n, b in enumerate(bodies)], SCHEMA)
    return sorted((r.output_id, r.child, r.frag_no, r.item_no, r.text) for r in nested_children(df, "output_id", "body").collect())


def test_shapes(spark):
    body = {"Intro_Structures": "use a;", "fragments": [None, {"fragment": "f{\"\\", "dependencies": ["d", None, "e"], "placeholders": {"placeholder": "p", "node_kind": None}}]}
    want = [("dependency", 1, 0, "d"), ("dependency", 1, 2, "e"), ("fragment", 1, -1, "f{\"\\"), ("intro", -1, 0, "use a;"), ("placeholder", 1, 0, "p")]
    texts = [json.dumps(body), f"```json\n{json.dumps(body, indent=2)}\n```", json.dumps({"output": body})]
    assert children(spark, *texts) == sorted((n, *w) for n in range(3) for w in want)


def test_nothing(spark):
    assert children(spark, None, "", "null", "[]", "{}", '{"fragments": null}', '{"fragments": [', "prose", '{"fragments": [{"fragment": "x"}]', "```json\n```", '{"a": 1}', "[" * 200_000 + "]" * 200_000) == []
    assert nested_children(spark.createDataFrame([], SCHEMA), "output_id", "body").count() == 0


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, '{"intro-structures": ["a"]}')] * 3 + [(None, '{"intro-structures": ["b"]}')], "output_id bigint, body string")
    assert nested_children(df, "output_id", "body").count() == 1


def test_long_body(spark):
    many = [{"fragment": "x" * 1000, "placeholders": ["p"] * 50} for _ in range(3000)]
    assert len(children(spark, json.dumps({"fragments": many}))) == 3000 * 51


values = st.recursive(st.none() | st.integers() | st.text('a"\\{}[]:, é', max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("k\"\\:", max_size=3), x, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(values, min_size=1, max_size=4), st.sampled_from([None, 2]))
def test_index_finds_every_value(bodies, indent):
    index = Index([json.dumps(b, indent=indent, ensure_ascii=indent is None).encode() for b in bodies])
    assert index.complete.all()

    def read(k):
        if index.kind(k) == 91:
            return [read(m) for m in index.within.get(index.start[k], [])]
        if index.kind(k) == 123:
            return {json.loads(b'"' + index.bytes[index.key[m] : index.key_end[m]] + b'"'): read(m) for m in index.within.get(index.start[k], [])}
        return json.loads(index.text(k))

    assert [read(index.top[k]) for k in range(len(bodies))] == bodies


def complete(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text('{}[],:"\\nu10 -e.', max_size=12), values.map(json.dumps).flatmap(lambda t: st.integers(0, len(t)).map(lambda k: t[:k] + t[k + 1 :]))), min_size=1, max_size=4))
def test_index_knows_complete_json(texts):
    raw = [t.encode() for t in texts]
    assert Index(raw, 3).complete.tolist() == [complete(t) for t in texts]


def test_deep_bodies(spark):
    deep = '{"fragments": [{"fragment": "f", "extra": ' + '{"a": [' * 50_000 + "1" + "]}" * 50_000 + '}], "intro-structures": ["u"]}'
    assert children(spark, deep) == [(0, "fragment", 0, -1, "f"), (0, "intro", -1, 0, "u")]
    assert children(spark, deep[:-1], deep.replace("]}", "}]", 1)) == []


LOG = "\r\n".join([
    "noise before", "[2025-03-16 03:45:43] [icemaker] [debug] stale piece", "  detail", "Mar  6 03:45:47 runner linkwrap[1863]: warning: slow batch",
    "thread 'rustc' (7) panicked at compiler/a.rs:1:2:", "error: looks like an entry", "stack backtrace:", "   0: x", "error[E0355]: mismatched", "12 | error: code", "",
    "2025-04-18 23:55:49,703-05:00 [WARN] rustc_x::intern - retry", "1745982281624 W rustc_x::collect: stale", 'ts=2025-06-03T11:39:58Z level=warn target=rustc_y::project msg="x"',
    "W0524 12:30:42.963028 671 gagu.cc:372] late", "LLVM ERROR: out of memory", "memory allocation of 24 bytes failed", "note: delayed at compiler/b.rs:9 - x",
    '{"timestamp": "2025-02-27T12:35:31.978Z", "level": "ERROR", "fields": {"message": "m", "n": 64}, "target": "rustc_z::v"}',
    "[2025-03-16 03:45:44] [genie] [warn] other thing", "1745982281625 E rustc_x::walk: stale",
])
WANT = [
    (1, "debug", "icemaker", "2025-03-16 03:45:43"), (3, "warn", "linkwrap", "2024-03-06 03:45:47"), (4, "panic", "compiler/a.rs:1:2", ""), (8, "error", "rustc", ""),
    (11, "warn", "rustc_x::intern", "2025-04-19 04:55:49"), (12, "warn", "rustc_x::collect", "2025-04-30 03:04:41"), (13, "warn", "rustc_y::project", "2025-06-03 11:39:58"),
    (14, "warn", "gagu.cc", "2024-05-24 12:30:42"), (15, "error", "LLVM", ""), (16, "error", "rustc", ""), (17, "note", "compiler/b.rs:9", ""), (18, "error", "rustc_z::v", "2025-02-27 12:35:31"),
    (19, "warn", "genie", "2025-03-16 03:45:44"), (20, "error", "rustc_x::walk", "2025-04-30 03:04:41"),
]


def entries(spark, rows):
    df = spark.createDataFrame(rows, "run_id bigint, stderr string, at timestamp, level string, template string, id int")
    return sorted((r.run_id, r.line_no, r.level, r.component, r.logged_at) for r in log_entries(df, "run_id", "stderr", "at").collect())


def test_entries(spark):
    from datetime import datetime

    rows = [(1, LOG, datetime(2024, 7, 1), "clash", "clash", 1)] * 2 + [(2, None, None, "", "", 1), (3, "", None, "", "", 1), (None, LOG, None, "", "", 1), (4, "\n \n", None, "", "", 1)]
    assert entries(spark, rows) == [(1, *w) for w in WANT]
    got = {r[1]: r[4] for r in entries(spark, [(5, LOG, None, "", "", 1)])}
    assert got[3] == "" and got[1] != ""
    assert entries(spark, []) == []


def test_late_level_and_target(spark):
    many = " ".join(f"k{n}=v{n}" for n in range(60))
    listed = ", ".join(f'"k{n}": "v{n}"' for n in range(60))
    lines = [f"ts=2025-06-03T11:39:58Z {many} level=warn target=rustc_y::project msg=x", '{"timestamp": "2025-02-27T12:35:31.978Z", ' + listed + ', "level": "ERROR", "target": "rustc_z::v"}', f"ts=2025-06-03T11:39:58Z info: {many} target=rustc_w"]
    got = entries(spark, [(1, "\n".join(lines), None, "", "", 1)])
    assert got == [(1, 0, "warn", "rustc_y::project", "2025-06-03 11:39:58"), (1, 1, "error", "rustc_z::v", "2025-02-27 12:35:31"), (1, 2, "info", "rustc_w", "2025-06-03 11:39:58")]


def mined(lines, templates):
    """(level, component) of lines by templates of their own."""
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["\n".join(lines)]), pa.array([2025])], ["a", "b", "c"])
    found = next(loglines._mine(iter([rows]))).to_pylist()
    merged = next(loglines._merge(iter([pa.RecordBatch.from_pylist([x for x in ({"t": r["template"], "s": r["stats"]} for r in found) if x["s"]])]))).to_pylist()
    known = [x for x in merged if x["stats"]]
    roles = next(loglines._classified(iter([pa.RecordBatch.from_pylist([{"t": x["merged"], "s": x["stats"]} for x in known])]))).to_pylist()
    templates += [x["merged"] for x in known]
    layouts = {r["layout"] for r in roles if r["n"] > 1}
    return {r["merged"] for r in roles if not r["needs"] or r["layout"] in layouts}


def test_fields_come_through_mining(monkeypatch):
    """Without the miner a line is its own template: nothing recurs, and words in brackets or letters play no part."""
    lines = [f"[2025-03-16 03:45:{n:02}] [{p}] [{v}] late piece_{'abc'[n % 3]} in round {n}" for n, (p, v) in enumerate(zip(["icemaker", "genie"] * 4, ["debug", "warn", "error", "info"] * 2))]
    templates = []
    assert mined(lines, templates) == set(templates) == {"[ 0-0-0 0:0:0 ] [ <*> ] [ <*> ] late <*> in round 0"}

    def alone(self, seq, types, n=1, strong=None):
        self.all.append(loglines.Template([*seq, str(len(self.all))], [*types, Counter()], n))
        return len(self.all) - 1

    monkeypatch.setattr(loglines.Templates, "add", alone)
    assert mined(lines, templates) == set()


def test_many_templates_of_one_layout(spark):
    """Hundreds of messages that share nothing but their layout, and more templates than a task of the merge takes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgkmnprstvz") + rng.choice("aeiou") for _ in range(4))
    lines = [f"2025-03-16T03:45:43Z INFO rustc_{word()}::{word()}: " + " ".join(word() for _ in range(n % 9 + 1)) for n in range(300)]
    got = entries(spark, [(n, line, None, "", "", 1) for n, line in enumerate(lines)])
    assert [g[:3] for g in got] == [(n, 0, "info") for n in range(300)]
    stats = spark.createDataFrame([(f"{word()} {word()} {word()}", loglines._written(1, [Counter(word=1)] * 3)) for _ in range(50)], "template string, stats string")
    merged = loglines.merged_templates(stats, held=10)
    assert merged.select("template").distinct().count() == 50


def test_common_places():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        pairs = loglines.common_places(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs)) and len({j for _, j in pairs}) == len(pairs)
    long = [f"k{n % 97}" for n in range(20_000)]
    assert len(loglines.common_places(["x", *long, "y"], ["z", *long[1:], "w", "y"])) == 20_000


def test_messages_hold_their_details(spark):
    df = spark.createDataFrame([(1, "error: a\n  b\nc", None)], "run_id bigint, stderr string, at timestamp")
    assert log_entries(df, "run_id", "stderr", "at").first().message == "error: a\n  b\nc"


def test_moments():
    assert moment("2025-13-40 00:00:00", 2025) == "" and moment(None, 2025) == "" and moment("0229 01:02:03", 2025) == ""
    assert moment("2025-01-01T00:30:00+01:00", 2025) == "2024-12-31 23:30:00"
