"""Problem 5: deeply nested JSON answers into flat child tables with links to their parents.

Structural indexing, vectorised over all texts of a batch: bitmaps of quotes (those not escaped), brackets and delimiters
over the bytes, strings by the parity of quotes, nesting depth by prefix sums of brackets. Tokens are sorted by depth, so
that brackets pair up and every token finds its container, however deep. Which texts are complete JSON is told from the
same index: by the tokens that stand beside each other in a container. Linked rows come out of the spans of values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a worker indexes at once; a longer text comes alone.
BLOCK = 1 << 20
#: Depth at which the children's values end: wrapper, answer, list, fragment, list, placeholder, name. Deeper values are indexed, not read.
DEEPEST = 8
_FENCE = re.compile(r"\A\s*```[\w-]*\s*?\n?(.*?)(?:```\s*)?\Z", re.S)
#: The lists that come out, by their key without case, hyphens and underscores.
CHILDREN = {"introstructures": "intro", "fragments": "fragment", "dependencies": "dependency", "placeholders": "placeholder"}
_SCALAR = re.compile(rb"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|NaN|-?Infinity")
_ESCAPES = re.compile(r"(?:\\u[0-9a-fA-F]{4})+|\\.")
_NAMED = {"\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t"}
OPEN_OBJECT, OPEN_LIST, CLOSE_OBJECT, CLOSE_LIST, COMMA, COLON, STRING, SCALAR = range(1, 9)
_CLASS = np.zeros(256, np.int8)
_CLASS[[123, 91, 125, 93, 44, 58, 34]] = range(1, 8)
_ESCAPED, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True


def unfenced(text: str) -> str:
    m = _FENCE.match(text)
    return (m[1] if m else text).strip("\ufeff \t\r\n")


def unescaped(raw: bytes) -> str:
    """The inside of a JSON string as text; half a surrogate pair comes as a replacement character."""
    text = raw.decode("utf-8", "replace")
    if "\\" not in text:
        return text

    def plain(m: re.Match) -> str:
        x = m.group()
        if x.startswith("\\u"):
            return bytes.fromhex(x.replace("\\u", "")).decode("utf-16-be", "replace")
        return _NAMED.get(x, x[1:])

    return _ESCAPES.sub(plain, text)


def _last(marks: np.ndarray) -> np.ndarray:
    """At each place the last place at or before it that is marked, or -1."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))


class _Bitmaps:
    """Quotes, strings, brackets and depth over the bytes of some texts."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"\n".join(texts) + b"\n"
        self.x = x = np.frombuffer(self.bytes, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])
        self.begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        backslash = x == 92
        run = np.arange(len(x)) - _last(~backslash)  # backslashes up to here
        self.quote = (x == 34) & (np.concatenate([[0], run[:-1]]) % 2 == 0)
        count = np.cumsum(self.quote)
        count -= (count - self.quote)[self.begin][self.owner]
        self.odd = count % 2 == 1
        self.inside = self.odd | self.quote
        self.escape = backslash & (run % 2 == 1) & self.inside
        self.up = ((x == 123) | (x == 91)) & ~self.inside
        self.down = ((x == 125) | (x == 93)) & ~self.inside
        step = self.up.astype(np.int64) - self.down
        depth = np.cumsum(step)
        self.depth = depth - (depth - step)[self.begin][self.owner]

    def balanced(self) -> np.ndarray:
        """Of each text whether its quotes and brackets are closed, none before it is opened, and its strings are well written."""
        last = np.append(self.begin[1:], len(self.x)) - 1
        ok = (self.depth[last] == 0) & ~self.odd[last]
        bad = (self.depth < 0) | (self.odd & (self.x < 32))
        at = np.flatnonzero(self.escape)
        follows = self.x[np.minimum(at + 1, len(self.x) - 1)]
        wrong = ~_ESCAPED[follows]
        for k in range(2, 6):
            wrong |= (follows == 117) & ~_HEX[self.x[np.minimum(at + k, len(self.x) - 1)]]
        bad[at[wrong]] = True
        ok[self.owner[bad]] = False
        return ok


class Index:
    """Spans of all values of some JSON texts. complete tells which of the texts are one complete JSON value."""

    def __init__(self, texts: list[bytes], deepest: int | None = None):
        self.complete = np.zeros(len(texts), bool)
        self.within: dict[int, list[int]] = {}
        self.top: dict[int, int] = {}
        m = _Bitmaps(texts) if texts else None
        if m is not None and not (ok := m.balanced()).all():
            kept = np.flatnonzero(ok)
            m = _Bitmaps([texts[k] for k in kept]) if len(kept) else None
        else:
            kept = np.arange(len(texts))
        if m is None:
            return
        self.bytes = m.bytes
        x, n = m.x, len(m.x)
        white = ((x == 32) | (x == 10) | (x == 13) | (x == 9)) & ~m.inside
        marks = (_CLASS[x] > 0) & (x != 34) & ~m.inside
        scalar = ~m.inside & ~white & ~marks
        first = scalar & ~np.concatenate([[False], scalar[:-1]])
        at = np.flatnonzero(marks | (m.quote & m.odd) | first)
        cls = np.where(scalar[at], SCALAR, _CLASS[x[at]])
        own = m.owner[at]
        opens, closes = m.up[at], m.down[at]
        level = m.depth[at] - opens  # depth of the container
        scale = np.int64(n + 1)
        inner = (level + 1) * scale + at  # brackets by the depth inside them, then by place
        left, right = np.sort(inner[opens]), np.sort(inner[closes])
        holder = np.searchsorted(left, level * scale + at) - 1
        box = np.where(level > 0, left[holder] % scale if len(left) else -1, -1)
        context = np.where(level > 0, x[box], 0)
        new = np.concatenate([[True], own[1:] != own[:-1]])
        before = np.where(new, 0, np.concatenate([[0], cls[:-1]]))
        key = (cls == STRING) & (context == 123) & ((before == OPEN_OBJECT) | (before == COMMA))
        key_before = np.concatenate([[False], key[:-1]]) & ~new
        ended = (before >= CLOSE_OBJECT) & (before != COMMA) & (before != COLON) & ~key_before
        value = (opens | (cls >= STRING)) & ~key
        good = key | (value & np.where(level == 0, before == 0, np.where(context == 91, (before == OPEN_LIST) | (before == COMMA), before == COLON)))
        good |= (cls == COLON) & key_before
        good |= (cls == COMMA) & (level > 0) & ended
        pairs = left[np.searchsorted(right, inner[closes])] % scale if len(right) else np.empty(0, np.int64)
        good[closes] = ((x[pairs] + 2 == x[at[closes]])) & (ended | (before == cls - 2))[closes]
        stop = np.flatnonzero(~scalar)
        ends = stop[np.minimum(np.searchsorted(stop, at), len(stop) - 1)]
        for k in np.flatnonzero((cls == SCALAR) & good).tolist():
            if not _SCALAR.fullmatch(self.bytes, at[k], ends[k]):
                good[k] = False
        self.complete[kept] = True
        self.complete[kept[np.unique(own[~good])]] = False
        filled = np.zeros(len(kept), bool)
        filled[own] = True
        self.complete[kept[~filled]] = False

        if deepest is not None:
            value &= level < deepest
        quotes = np.flatnonzero(m.quote)
        closing = quotes[np.minimum(np.searchsorted(quotes, at) + 1, len(quotes) - 1)] if len(quotes) else np.zeros(len(at), np.int64)
        shut = np.zeros(len(at), np.int64)
        shut[opens] = right[np.searchsorted(left, inner[opens])] % scale if len(right) else 0
        end = np.where(cls == SCALAR, ends, np.where(cls == STRING, closing, shut) + 1)
        order = np.argsort(box, kind="stable")
        commas = np.cumsum(cls[order] == COMMA)
        start_of_box = np.searchsorted(box[order], box[order])
        place = np.empty(len(at), np.int64)
        place[order] = commas - np.where(start_of_box > 0, commas[start_of_box - 1], 0) - (cls[order] == COMMA)
        named = value & (before == COLON)
        back = np.maximum(np.arange(len(at)) - 2, 0)
        pick = np.flatnonzero(value)
        self.start, self.end, self.box, self.place = at[pick].tolist(), end[pick].tolist(), box[pick].tolist(), place[pick].tolist()
        self.key = np.where(named, at[back] + 1, -1)[pick].tolist()
        self.key_end = np.where(named, closing[back], -1)[pick].tolist()
        for k, (holds, text) in enumerate(zip(self.box, own[pick].tolist())):
            if holds >= 0:
                self.within.setdefault(holds, []).append(k)
            else:
                self.top.setdefault(int(kept[text]), k)

    def text(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.end[k]]

    def kind(self, k: int) -> int:
        return self.bytes[self.start[k]]

    def named(self, k: int) -> dict[str, int]:
        """The members of an object by their plain key; the last of repeated keys."""
        if self.kind(k) != 123:
            return {}
        return {unescaped(self.bytes[self.key[m] : self.key_end[m]]).lower().replace("-", "").replace("_", "").replace(" ", ""): m for m in self.within.get(self.start[k], ())}

    def items(self, k: int | None) -> list[tuple[int, int]]:
        """(position, value) of the items that aren't null of a list; a single value is a list of one."""
        if k is None or self.text(k) == b"null":
            return []
        values = self.within.get(self.start[k], []) if self.kind(k) == 91 else [k]
        return [(self.place[v] if self.kind(k) == 91 else 0, v) for v in values if self.text(v) != b"null"]

    def string(self, k: int | None, *names: str) -> str | None:
        """A value as text; of an object the first of the named members."""
        if k is None:
            return None
        if self.kind(k) == 123:
            members = self.named(k)
            return next((self.string(members[m]) for m in names if m in members), None)
        value = self.text(k)
        return None if value == b"null" else unescaped(value[1:-1]) if value[:1] == b'"' else value.decode()


def _rows(texts: list[bytes]) -> Iterator[tuple]:
    """(text number, child, frag_no, item_no, text, node_kind)."""
    index = Index(texts, DEEPEST)
    for n in np.flatnonzero(index.complete).tolist():
        top = index.named(index.top[n])
        if not top.keys() & {"introstructures", "fragments"}:
            inner = [m for m in map(index.named, top.values()) if m.keys() & {"introstructures", "fragments"}]
            if not inner:
                continue
            top = inner[0]
        for i, v in index.items(top.get("introstructures")):
            yield n, "intro", -1, i, index.string(v), None
        for f, v in index.items(top.get("fragments")):
            own = index.named(v)
            yield n, "fragment", f, -1, index.string(v, "fragment"), index.string(own.get("nodekind"))
            for i, w in index.items(own.get("dependencies")):
                yield n, "dependency", f, i, index.string(w, "dependency"), None
            for i, w in index.items(own.get("placeholders")):
                yield n, "placeholder", f, i, index.string(w, "placeholder"), index.string(index.named(w).get("nodekind"))


def nested_children(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, child, frag_no, item_no, text, node_kind): the children of each answer. child is `intro` (frag_no -1),
    `fragment` (item_no -1), `dependency` or `placeholder`; (key, frag_no) is the link of the latter two to their fragment.

    Positions are those in the lists as written: null items give no row but keep theirs. A single value in place of a
    list is a list of one; a missing or null list is empty. Fences, an outer object, case, hyphens and underscores of keys
    make no difference; of a repeated key the last counts. A body that isn't one complete JSON value, a null or empty one
    and a null key give no rows; repeated rows count once. Other columns are ignored, whatever their names."""
    kind = df.schema[key].dataType.simpleString()
    schema = pa.schema([("child", pa.string()), ("frag_no", pa.int64()), ("item_no", pa.int64()), ("text", pa.string()), ("node_kind", pa.string())])

    def out(ids: pa.Array, places: list[int], texts: list[bytes]) -> pa.RecordBatch:
        cols = list(zip(*_rows(texts))) if texts else []
        cols = cols or [()] * 6
        owner = ids.take(pa.array([places[n] for n in cols[0]], pa.int64()))
        return pa.RecordBatch.from_arrays([owner, *(pa.array(c, f.type) for c, f in zip(cols[1:], schema))], ["k", *schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, texts, size = [], [], 0
            for n, text in enumerate(batch.column(1).to_pylist()):
                text = unfenced(text)
                raw = text.encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > BLOCK:
                    yield out(batch.column(0), places, texts)
                    places, texts, size = [], [], 0
                places.append(n)
                texts.append(raw)
                size += len(raw)
            yield out(batch.column(0), places, texts)

    source = df.select(F.col(key).alias("k"), F.col(body).alias("b")).filter("k is not null and b <> ''")
    made = source.mapInArrow(run, f"k {kind}, child string, frag_no bigint, item_no bigint, text string, node_kind string")
    return made.dropDuplicates(["k", "child", "frag_no", "item_no"]).withColumnRenamed("k", key)
