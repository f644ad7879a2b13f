"""Syntax nodes: the table that tree operators read, and a small provider for Rust sources.

The provider knows tokens, brackets and items, not the grammar: kinds below items are those of tokens and brackets. Any
other table of the same columns will do, such as one made by a full parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglight.functions.text import located, without_comments
from fraglight.operators.spans import beginning_inside, covering
from fraglight.sources.tables import staged

# Fixed values.
PRIMITIVES = ["i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char", "str"]
ITEMS = {
    "fn": "function_item", "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item", "impl": "impl_item",
    "mod": "mod_item", "use": "use_declaration", "const": "const_item", "static": "static_item", "type": "type_item", "let": "let_declaration",
    "macro_rules": "macro_definition",
}
BRACKETS = {"{": "block", "(": "arguments", "[": "array_expression"}
#: Kinds that are punctuation, comments or keywords, and blocks: they aren't structures of their own.
SYNTACTIC = [
    "block", "line_comment", "block_comment",
    "(", ")", "{", "}", "[", "]", "\"", "#", "!", "//", "'", ",", ":", ";", "::", "|", "->", "=>", ".", "..", "...", "/*", "*/",
    "fn", "else", "for", "if", "impl", "in", "let", "loop", "match", "mod", "pub", "struct", "trait", "unsafe", "type", "use", "where", "while",
]
_TOKEN = re.compile(
    r"""(?P<line_comment>//[^\n]*)|(?P<block_comment>/\*.*?(?:\*/|\Z))|(?P<raw_string_literal>r(?P<hashes>\#*)".*?"(?P=hashes))|(?P<string_literal>b?"(?:[^"\\]|\\.)*")"""
    r"""|(?P<char_literal>'(?:[^'\\\n]|\\.)')|(?P<lifetime>'\w+)|(?P<float_literal>\d[\d_]*\.\d[\w]*)|(?P<integer_literal>\d\w*)"""
    r"""|(?P<attribute_item>\#!?\[[^\]]*\])|(?P<word>\w+)|(?P<open>[\[({])|(?P<close>[\])}])|(?P<end>;)|(?P<mark>\S)""",
    re.S,
)


def parse(text: str) -> list[tuple[int, int, int, int, str]]:
    """(node, parent, start, end, kind) in characters; the first is the file, its parent -1."""
    nodes: list[list] = [[0, -1, 0, len(text), "source_file"]]
    stack = [0]  # open brackets and items

    def add(s: int, e: int, kind: str) -> int:
        nodes.append([len(nodes), stack[-1], s, e, kind])
        return len(nodes) - 1

    def close_items(at: int) -> None:
        while nodes[stack[-1]][4] in ITEMS.values():
            nodes[stack.pop()][3] = at

    for m in _TOKEN.finditer(text):
        kind, word = m.lastgroup, m.group()
        if kind == "open":
            stack.append(add(m.start(), len(text), BRACKETS[word]))
        elif kind == "close":
            close_items(m.start())
            if len(stack) > 1:
                nodes[stack.pop()][3] = m.end()
            if word == "}" and nodes[stack[-1]][4] in ITEMS.values() and nodes[stack[-1]][4] != "let_declaration":
                nodes[stack.pop()][3] = m.end()
        elif kind == "end":
            if nodes[stack[-1]][4] in ITEMS.values():
                nodes[stack.pop()][3] = m.end()
        elif kind == "word" and word in ITEMS:
            stack.append(add(m.start(), len(text), ITEMS[word]))
        elif kind == "word":
            add(m.start(), m.end(), "primitive_type" if word in PRIMITIVES else "boolean_literal" if word in ("true", "false") else "type_identifier" if word[0].isupper() else "identifier")
        elif kind != "mark":
            add(m.start(), m.end(), kind)
    return [tuple(n) for n in nodes]


def syntax_nodes(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node_id, parent_id, depth, ord, s, e, kind) of all sources; spans are bytes, ord is breadth-first order. Null keys
    and texts give none."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                for r, source in enumerate(part.column(1).to_pylist()):
                    nodes = parse(source)
                    width: range | list[int] = range(len(source) + 1)
                    if not source.isascii():
                        width = [0]
                        for c in source:
                            width.append(width[-1] + len(c.encode("utf-8", "surrogatepass")))
                    depth: list[int] = []
                    for _, parent, *_ in nodes:
                        depth.append(0 if parent < 0 else depth[parent] + 1)
                    order = {n: k for k, n in enumerate(sorted(range(len(nodes)), key=lambda n: (depth[n], n)))}
                    rows += [(r, n, None if p < 0 else p, depth[n], order[n], width[s], width[e], k) for n, p, s, e, k in nodes]
                cols = list(zip(*rows)) or [()] * 8
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                own = part.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(cols[1:], types))], ["k", "node_id", "parent_id", "depth", "ord", "s", "e", "kind"])

    source = files.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    return source.mapInArrow(run, f"k {kind}, node_id bigint, parent_id bigint, depth int, ord bigint, s bigint, e bigint, kind string").withColumnRenamed("k", key)


def structures(nodes: DataFrame) -> DataFrame:
    """Nodes below the root that aren't punctuation, keywords or comments."""
    return nodes.filter(F.col("parent_id").isNotNull() & ~F.col("kind").isin(SYNTACTIC))


def inclusion(nodes: DataFrame, spans: DataFrame, on: str, key: list[str]) -> DataFrame:
    """For each span (s2, e2) of a source: (kind, exact, parent_kind, child_kind) of the deepest node that covers it, its parent,
    and the first child that begins inside the span."""
    cover = covering(nodes, spans, [on]).groupBy(on, *key).agg(
        F.max_by(F.struct("node_id", "parent_id", "kind", (F.expr("s = s2 and e = e2")).alias("exact")), F.struct("depth", (-F.col("node_id")).alias("x"))).alias("_node")
    )
    parents = nodes.select(on, F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    found = cover.select(on, *key, "_node.node_id", "_node.parent_id", "_node.kind", "_node.exact").join(parents, [on, "parent_id"], "left")
    children = beginning_inside(nodes, spans, [on]).groupBy(on, *key, F.col("parent_id").alias("node_id")).agg(F.min_by("kind", F.struct("s", "ord")).alias("child_kind"))
    return found.join(children, [on, *key, "node_id"], "left").select(on, *key, "kind", "exact", "parent_kind", "child_kind")


def decided_kind(kind: str = "kind", exact: str = "exact", parent: str = "parent_kind", child: str = "child_kind") -> F.Column:
    """The kind of a fragment: its own node's if that is exact (of a whole file its first child's), else the first child's, else
    that of the node around it unless that is the file."""
    own = F.when(F.col(exact) & (F.col(kind) == "source_file"), F.col(child)).when(F.col(exact), F.col(kind))
    around = F.when(F.col(kind) != "source_file", F.col(kind)).otherwise(F.when(F.col(parent) != "source_file", F.col(parent)))
    return F.coalesce(own, F.col(child), around)


def annotated(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, on: str, source: str, fragments: DataFrame, key: str, fragment: str) -> DataFrame:
    """(on, key, node_kind, stands) of each pair of a source and a fragment: of its places the first with a type_identifier, else the
    first with a kind. A fragment without a kind there is looked for in the source without comments (its first place counts), then
    without its own comments in either. One that stands nowhere has a null kind, as has one whose places have none."""
    bare = lambda df, column: df.withColumn(column, without_comments(F.col(column)))
    commented = texts.filter(F.col(source).rlike("//|/\\*"))

    def places(some: DataFrame, texts: DataFrame, fragments: DataFrame, rank: int, bound: int = 20) -> DataFrame:
        found = located(some, texts, on, source, fragments, key, fragment, commas=True, bound=bound)
        return found.select(on, key, F.lit(rank).alias("rank"), "match_no", F.col("s").alias("s2"), F.col("e").alias("e2"))

    def best(kinds: DataFrame) -> DataFrame:
        order = F.struct(F.col("node_kind").isNull(), "rank", F.col("node_kind") != "type_identifier", "match_no")
        return kinds.groupBy(on, key).agg(F.min_by(F.struct("rank", "node_kind", "match_no"), order).alias("x")).select(on, key, "x.*")

    def kinds(nodes: DataFrame, spans: DataFrame) -> DataFrame:
        return best(inclusion(nodes, spans, on, [key, "rank", "match_no"]).withColumn("node_kind", decided_kind()).select(on, key, "rank", "match_no", "node_kind"))

    first = staged(kinds(nodes, places(pairs, texts, fragments, 0)), "kinds")
    left = staged(pairs.select(on, key).join(first.filter("node_kind is not null").select(on, key), [on, key], "left_anti"), "left")
    spans = staged(places(left, bare(commented, source), fragments, 1, bound=2).unionByName(places(left, bare(commented, source), bare(fragments, fragment), 3)), "spans")
    sources = bare(texts.join(spans.select(on).distinct(), on, "left_semi"), source)
    again = kinds(nodes, places(left, texts, bare(fragments, fragment), 2)).unionByName(kinds(syntax_nodes(sources, on, source), spans))
    decided = best(first.unionByName(again)).select(on, key, "node_kind", F.lit(True).alias("_found"))
    out = pairs.select(on, key).distinct().join(decided, [on, key], "left")
    return out.select(on, key, "node_kind", F.col("_found").isNotNull().alias("stands"))
