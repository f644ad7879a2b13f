"""Problem 7: how often every distinct value occurs, and in how many records.

Each task counts into a burst trie: terms are routed by prefix into containers, and a container that grows too large
bursts into one for each next character, so prefixes adapt to the terms. The containers of all tasks, each a compact
subtree with its route, are then merged where their routes match: a container whose route has burst in another task is
split by its next character until its route is a leaf everywhere, and the containers of a route, one from each task at
most, become one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglight.sources.tables import staged

#: Terms of a container before it bursts, and of a task's trie before it is handed on and begun anew.
BURST, HELD = 64, 300_000


class BurstTrie:
    """Inner nodes are dicts of nodes by character, leaves are containers: dicts of [occurrences, records] by suffix. The
    key "" of an inner node holds the counters of the term that ends there."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.inner = {id(self.root)}
        self.terms = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at, above, step = self.root, 0, None, ""
        while id(node) in self.inner:
            if at == len(term):
                break
            step = term[at]
            above, at = node, at + 1
            node = node.setdefault(step, {})
        suffix = term[at:] if id(node) not in self.inner else ""
        counters = node.get(suffix)
        if counters is None:
            counters = node[suffix] = [0, 0]
            self.terms += 1
        counters[0] += occurrences
        counters[1] += records
        if len(node) > BURST and id(node) not in self.inner:
            above[step] = self._burst(node)

    def _burst(self, container: dict) -> dict:
        node: dict = {}
        self.inner.add(id(node))
        for suffix, counters in container.items():
            if suffix:
                node.setdefault(suffix[0], {})[suffix[1:]] = counters
            else:
                node[""] = counters
        return node

    def subtrees(self) -> Iterator[tuple[str, bool, dict | None]]:
        """(route, False, container) of all leaves; of inner nodes (route, False, None), and (route, True, container) if a term ends
        there."""
        stack = [("", self.root)]
        while stack:
            route, node = stack.pop()
            if id(node) in self.inner:
                yield route, False, None
                if "" in node:
                    yield route, True, {"": node[""]}
                stack += [(route + c, x) for c, x in node.items() if c]
            else:
                yield route, False, node


_COLUMNS = "field string, route string, ends boolean, suffix array<string>, occ array<bigint>, rec array<bigint>"
_SCHEMA = pa.schema(
    [("field", pa.string()), ("route", pa.string()), ("ends", pa.bool_()), ("suffix", pa.list_(pa.string())), ("occ", pa.list_(pa.int64())), ("rec", pa.list_(pa.int64()))]
)


def _rows(found: Iterator[tuple[str, str, bool, dict | None]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for field, route, ends, leaf in found:
        counters = list(zip(*leaf.values())) if leaf else [None, None]
        rows.append((field, route, ends, list(leaf) if leaf else None, *counters))
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, BurstTrie] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        yield from _rows((field, *x) for field, trie in tries.items() for x in trie.subtrees())
        tries.clear()

    for batch in batches:
        for field, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            trie = tries.setdefault(field, BurstTrie())
            for term, n in Counter(terms).items():
                trie.add(term, n, 1)
        if sum(t.terms for t in tries.values()) > HELD:
            yield from handed_on()
    yield from handed_on()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers by their next character."""

    def each() -> Iterator[tuple[str, str, bool, dict]]:
        for b in batches:
            for field, route, _, suffix, occ, rec in zip(*(c.to_pylist() for c in b.columns)):
                parts: dict[str, dict] = {}
                for x, o, r in zip(suffix, occ, rec):
                    parts.setdefault(x[:1], {})[x[1:]] = (o, r)
                for c, leaf in parts.items():
                    yield field, route + c, not c, leaf

    return _rows(each())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers in the order of their routes -> (field, term, occurrences, records)."""

    def emitted(at: tuple, leaf: dict) -> pa.RecordBatch:
        cols = [[at[0]] * len(leaf), [at[1] + x for x in leaf], *([v[k] for v in leaf.values()] for k in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["field", "term", "occurrences", "records"])

    now, leaf = None, {}
    for b in batches:
        for field, route, ends, suffix, occ, rec in zip(*(c.to_pylist() for c in b.columns)):
            if (field, route, ends) != now:
                if leaf:
                    yield emitted(now, leaf)
                now, leaf = (field, route, ends), {}
            for x, o, r in zip(suffix, occ, rec):
                counters = leaf.setdefault(x, [0, 0])
                counters[0] += o
                counters[1] += r
    if leaf:
        yield emitted(now, leaf)


def merged_subtrees(subtrees: DataFrame) -> DataFrame:
    """Rows of tries -> (field, term, occurrences, records). Each round splits the containers whose route is an inner node elsewhere;
    there are as many as the deepest trie has levels below the shallowest container, at most."""
    subtrees = staged(subtrees, "subtrees")
    inner = subtrees.filter("suffix is null").select("field", "route").distinct()
    leaves = subtrees.filter("suffix is not null")
    final, open_ = [leaves.filter("ends")], leaves.filter("not ends")
    while True:
        final.append(open_.join(inner, ["field", "route"], "left_anti"))
        burst = open_.join(inner, ["field", "route"], "left_semi")
        split = staged(burst.select(*(f.name for f in _SCHEMA)).mapInArrow(_split, _COLUMNS), "split")
        if split.isEmpty():
            break
        final.append(split.filter("ends"))
        open_ = split.filter("not ends")
    names = [f.name for f in _SCHEMA]
    whole = reduce(DataFrame.unionAll, (x.select(*names) for x in final))
    sorted_ = whole.repartition("field", "route").sortWithinPartitions("field", "route", "ends")
    return sorted_.mapInArrow(_merge, "field string, term string, occurrences bigint, records bigint")


def term_counts(records: DataFrame) -> DataFrame:
    """records (field, id, terms array<string>) -> (field, term, occurrences, records, of_records): how often each term
    occurs, in how many records, and how many records have any term of the field.

    Rows of the same field and id are one record: one of them counts. Null terms don't count, nor do null fields or ids;
    the empty string is a term. Terms count as written. Other columns are ignored; no rows give none."""
    kept = records.select("field", "id", F.filter("terms", lambda x: x.isNotNull()).alias("terms")).filter("field is not null and id is not null and size(terms) > 0")
    kept = kept.groupBy("field", "id").agg(F.max("terms").alias("terms"))
    merged = merged_subtrees(kept.select("field", "terms").mapInArrow(_count, _COLUMNS))
    of = kept.groupBy("field").agg(F.count("*").alias("of_records"))  # one row for each field
    return merged.join(of, "field")


def marked_terms(records: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """term_counts with `mark`: rare if the term occurs at most `rare` times in all, else common if it is in more than
    that share of the records with any term of the field, else null."""
    mark = F.when(F.col("occurrences") <= rare, "rare").when(F.col("records") > common * F.col("of_records"), "common")
    return term_counts(records).withColumn("mark", mark)
