"""Problem 6: log lines of several programs into timestamp, level, component and message.

Lines are cut into tokens without regard to their meaning: runs of characters between white space, brackets, quotes and
other marks, with digits masked. Each task mines templates from its lines by longest common subsequence (LCS): a line
joins the template with which it shares more than half of its tokens; tokens that differ become slots, of one token where
both have as many there, else of any number. The templates of all tasks are merged in the same way, in rounds of tasks of
bounded size. With each place of a template goes a count of the types of its values (times, levels, paths, source files,
numbers, words); constants and slots of the merged templates are classified by these counts, and the classes give the
parts that they play. The fields of a line are then read out of the places of its template.

A plain word (a program in brackets) or a single letter (a level) is only taken for a part where its place recurs: in
a template of at least two lines, or in a layout of typed places that such a template has.

An entry goes on to the line before the next one: continuation lines are indented, are numbered source lines, or follow a
header that ends in its location.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraglight.sources.tables import staged

#: Share of the longer token sequence that a line and a template must have in common, at least.
COMMON = 0.5
#: Templates that a task mines before it begins anew, and that one task merges. Nothing is lost by it: the merge brings them together.
HELD = 4000
#: Share of a place's values that must be of a type for the place to be of that type.
OF_A_TYPE = 0.9
#: Templates up to which their table is broadcast (of some hundred bytes each); beyond, it is joined by shuffle.
BROADCAST = 20_000

#: Spellings of levels.
LEVELS = {
    "panic": "panic", "panicked": "panic", "error": "error", "err": "error", "e": "error", "fatal": "error", "crit": "error", "critical": "error", "f": "error",
    "warn": "warn", "warning": "warn", "wrn": "warn", "w": "warn", "note": "note", "notice": "note", "n": "note", "info": "info", "inf": "info", "information": "info", "i": "info",
    "debug": "debug", "dbg": "debug", "d": "debug", "trace": "trace", "trc": "trace", "t": "trace", "verbose": "trace", "v": "trace",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Keys of structured entries, and the part their value plays.
KEYS = {
    "ts": "time", "time": "time", "timestamp": "time", "@timestamp": "time", "t": "time", "level": "level", "lvl": "level", "severity": "level",
    "target": "target", "module": "target", "logger": "target", "component": "target", "name": "target", "msg": "message", "message": "message",
}
#: Constants before the location of a crash entry, its level, and whether the location ends at a colon.
CRASHES = [
    (("panicked", "at"), "thread", "panic", True),
    (("error", ":", "internal", "compiler", "error", ":"), "error", "error", True),
    (("note", ":", "delayed", "at"), "note", "note", False),
]
ALLOCATION = ("memory", "allocation", "of", "bytes", "failed")

SLOT, WIDE = "<*>", "<**>"
_MARKS = re.escape("[](){}<>\"'`=,;|")
_ATOM = rf"[^\s{_MARKS}:]+"
_TOKEN = re.compile(rf"{_ATOM}(?:(?::+|,(?=\d)){_ATOM})*|[{_MARKS}]|:+")
_DIGITS = re.compile(r"\d+")
_CLOCK = r"\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
_TYPES = [
    ("time", re.compile(rf"\d{{4}}-\d\d-\d\dT{_CLOCK}")),
    ("date", re.compile(r"\d{4}-\d\d-\d\d")),
    ("clock", re.compile(_CLOCK)),
    ("epoch", re.compile(r"\d{13}|\d{10}")),
    ("stamp", re.compile(rf"[{''.join(k.upper() for k in LEVELS if len(k) == 1)}]\d{{4}}")),  # a level and a day
    ("number", re.compile(r"(?:0x)?\d[\w.,]*")),
    ("source", re.compile(r"[\w.-]+\.[a-z]{1,3}:\d+(?::\d+)?")),
    ("path", re.compile(r"\S*[/\\]\S*\.[a-z]{1,3}(?::\d+){1,2}")),
    ("module", re.compile(r"\w+(?:::\w+)+")),
    ("word", re.compile(r"\w[\w.-]*")),
]
#: Types of values that tell layouts apart: a place holds values of one of them only, and no wide slot holds any.
STRONG = {"level", "letter", "time", "date", "clock", "epoch", "month", "stamp", "source", "path", "module"}
_NUMBERED, _HEADER = re.compile(r"\d+ *\|"), re.compile(r":\d+:$")


def lines_of(text: str) -> list[str]:
    return [x.removesuffix("\r") for x in text.split("\n")]


def type_of(token: str) -> str:
    """The type of a value by itself."""
    low = token.lower()
    if low in LEVELS:
        return "level" if len(token) > 1 else "letter"
    if low in MONTHS and token[0].isupper():
        return "month"
    return next((name for name, pattern in _TYPES if pattern.fullmatch(token)), "mark" if len(token) == 1 or not token.strip(":") else "text")


class Line:
    """Tokens of a line with their places in it."""

    def __init__(self, line: str):
        found = list(_TOKEN.finditer(line))
        self.line = line
        self.raw = [m.group() for m in found]
        self.spans = [m.span() for m in found]
        self.seq = _DIGITS.sub("0", " ".join(self.raw)).split(" ") if found else []  # digits masked


def common_places(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as places in both. Rows of the table of lengths are bits of integers; a table that would
    be too large is halved."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head] and a[head] not in (SLOT, WIDE):
        head += 1
    out = [(k, k) for k in range(head)]
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail] and a[-1 - tail] not in (SLOT, WIDE):
        tail += 1
    ends = [(head + len(a) - k, head + len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return out + ends
    if len(a) * len(b) > 1 << 28 and len(a) > 1:
        cut = len(a) // 2
        left = _lengths(a[:cut], b)
        right = _lengths(a[cut:][::-1], b[::-1])[::-1]
        at = int((left + right).argmax())
        first, second = common_places(a[:cut], b[:at]), common_places(a[cut:], b[at:])
        middle = first + [(i + cut, j + at) for i, j in second]
    else:
        middle = []
        rows = list(_rows(a, b))
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    middle.append((i, j))
        middle.reverse()
    return out + [(i + head, j + head) for i, j in middle] + ends


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each prefix of a the bits of b where the length of the common subsequence doesn't grow."""
    where: dict[str, int] = {}
    for j, token in enumerate(b):
        if token not in (SLOT, WIDE):
            where[token] = where.get(token, 0) | 1 << j
    every = state = (1 << len(b)) - 1
    for token in a:
        hit = state & where.get(token, 0)
        state = ((state + hit) | (state - hit)) & every
        yield state


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a with each prefix of b."""
    state = 0
    for state in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits)])


def _strong(types: Counter) -> str | None:
    return next((k for k in types if k in STRONG), None)


def as_text(seq: list[str]) -> str:
    return "".join([" \x02" if t == WIDE else " " + t for t in seq])


class Template:
    """Constants and slots of a cluster of lines, and for each place how often which type of value stands there."""

    def __init__(self, seq: list[str], types: list[Counter], n: int):
        self.seq, self.types, self.n = seq, types, n
        self.strong = [_strong(c) for c in types]
        self.constants = Counter(t for t in self.seq if t not in (SLOT, WIDE))
        self.needed = self.constants.keys()
        self.telling = Counter(k for k in self.strong if k)
        self.alike = sum(self.constants.values()) + sum(1 for k, t in zip(self.strong, self.seq) if k and t == SLOT)  # places that all lines share
        self.pieces: list[tuple[int, int, re.Pattern]] = []  # (first place, places, pattern) between wide slots
        at = 0
        for k in range(len(self.seq) + 1):
            if k == len(self.seq) or self.seq[k] == WIDE:
                pattern = "".join(" [^ \x02]+" if t == SLOT else " " + re.escape(t) for t in self.seq[at:k])
                anchors = (r"\A" if at == 0 else "") + pattern + ("(?= |$)" if k < len(self.seq) else r"\Z")
                self.pieces.append((at, k - at, re.compile(anchors)))
                at = k + 1

    def places(self, seq: list[str], joined: str | None = None) -> list[tuple[int, int]] | None:
        """First and end token of each place of the template in a sequence, or None if it isn't an instance."""
        joined = joined or as_text(seq)
        if len(self.pieces) == 1:
            return [(k, k + 1) for k in range(len(seq))] if self.pieces[0][2].match(joined) else None
        starts, at = {}, 0
        for k, t in enumerate(seq):
            starts[at] = k
            at += 2 if t == WIDE else len(t) + 1
        starts[at] = len(seq)
        out: list[tuple[int, int]] = []
        pos = 0
        for first, count, pattern in self.pieces:
            if count == 0 and first:  # nothing between two wide slots, or after the last
                begin = len(seq) if first == len(self.seq) else starts[pos]
                end = begin
            elif m := pattern.search(joined, pos) if first else pattern.match(joined):
                begin = starts[m.start()]
                end, pos = begin + count, m.end()
            else:
                return None
            if first:
                out.append((out[-1][1] if out else 0, begin))
            out += [(k, k + 1) for k in range(begin, end)]
        return out

    def suits(self, places: list[tuple[int, int]], strong: list[str | None]) -> bool:
        """Whether values of telling types stand where the template has the same."""
        return all((mine == strong[s]) if token != WIDE else not any(strong[s:e]) for mine, token, (s, e) in zip(self.strong, self.seq, places) if token in (SLOT, WIDE))

    def count(self, places: list[tuple[int, int]], types: list[Counter], n: int) -> None:
        self.n += n
        for mine, (s, e), token in zip(self.types, places, self.seq):
            if token != WIDE:
                for kind, k in types[s].items():
                    mine[kind] += k

    def widened(self, seq: list[str], types: list[Counter], strong: list[str | None], n: int, pairs: list[tuple[int, int]]) -> Template | None:
        """The common template of this one and another sequence; None where values of telling types would be mixed or lost."""
        out: list[str] = []
        kinds: list[Counter] = []
        i = j = 0
        for x, y in [*pairs, (len(self.seq), len(seq))]:
            if x - i == y - j and WIDE not in self.seq[i:x] and WIDE not in seq[j:y]:
                if self.strong[i:x] != strong[j:y]:
                    return None
                out += [SLOT] * (x - i)
                kinds += [self.types[i + k] + types[j + k] for k in range(x - i)]
            elif x > i or y > j:
                if any(self.strong[i:x]) or any(strong[j:y]):
                    return None
                out.append(WIDE)
                kinds.append(Counter())
            if x < len(self.seq):
                out.append(self.seq[x])
                kinds.append(self.types[x] + types[y])
            i, j = x + 1, y + 1
        return Template(out, kinds, self.n + n)


class Templates:
    """Templates mined so far, by their first place."""

    def __init__(self) -> None:
        self.all: list[Template] = []
        self.first: dict[str, list[int]] = {}

    def add(self, seq: list[str], types: list[Counter], n: int = 1, strong: list[str | None] | None = None) -> int:
        """Number of the template that the sequence is an instance of from now on. Types are counted by the caller, unless the
        template is new or widened."""
        have = set(seq)
        strong = strong or [_strong(c) for c in types]
        joined = as_text(seq)
        for k in self.first.get(seq[0], []) + self.first.get(SLOT, []) + self.first.get(WIDE, []):
            t = self.all[k]
            if t.needed <= have and (places := t.places(seq, joined)) is not None and t.suits(places, strong):
                t.count(places, types, n)
                return k
        mine, telling = Counter(t for t in seq if t not in (SLOT, WIDE)), Counter(k for k in strong if k)
        best, which = None, -1
        for k, t in enumerate(self.all):
            need = max(COMMON * max(len(t.seq), len(seq)), best.alike if best else 0)
            if t.alike <= need:
                continue
            most = sum(min(c, telling[x]) for x, c in t.telling.items() if x in telling)
            if most + sum(min(t.constants[x], mine[x]) for x in t.needed & have) <= need:
                continue
            wider = t.widened(seq, types, strong, n, common_places(t.seq, seq))
            if wider and wider.alike > need:
                best, which = wider, k
        if best is None:
            self.first.setdefault(seq[0], []).append(len(self.all))
            self.all.append(Template(list(seq), [Counter(c) for c in types], n))
            return len(self.all) - 1
        old = self.all[which].seq[0]
        if old != best.seq[0]:
            self.first[old].remove(which)
            self.first.setdefault(best.seq[0], []).append(which)
        self.all[which] = best
        return which


def _kind(types: Counter) -> str:
    total = sum(types.values())
    best = max(types.items(), key=lambda x: (x[1], x[0]), default=("text", 0))
    return best[0] if total and best[1] >= OF_A_TYPE * total else "text"


def parts(seq: list[str], types: list[Counter]) -> dict:
    """What the places of a template are: {"level": place or constant, "component": place or constant, "kind", "time": places,
    "needs": whether a plain word or letter plays a part}; empty if its lines begin no entry."""
    kinds = ["wide" if t == WIDE else _kind(c) for t, c in zip(seq, types)]
    seq, n = [*seq], len(seq)
    for constants, first, level, colon in CRASHES:
        for at in range(n - len(constants) + 1):
            if tuple(seq[at : at + len(constants)]) == constants and seq[0] == first:
                begin = at + len(constants)
                end = next((k for k in range(begin, n) if seq[k] == ":"), n) if colon else begin + 1
                if begin < n:
                    return {"level": "=" + level, "component": [begin, end], "kind": "location", "time": []}
    if tuple(t for t in seq if t not in (SLOT, WIDE, "0"))[:5] == ALLOCATION:
        return {"level": "=error", "component": "=rustc", "kind": "", "time": []}

    level = component = None
    kind, times, needs, structured = "", [], False, False
    after = lambda k, *tokens: tuple(seq[k + 1 : k + 1 + len(tokens)]) == tokens
    k = -1
    while (k := k + 1) < n:
        token, is_a = seq[k], kinds[k]
        part = KEYS.get(token.lower()) if token not in (SLOT, WIDE) else None
        if part and k + 1 < n and (after(k, "=") or after(k, '"', ":")):
            value = k + 1
            while value < n and seq[value] in ('"', "=", ":", "'"):
                value += 1
            structured = True
            if value < n and part == "time" and not times:
                times = [value, value + 1] if kinds[value] == "date" and value + 1 < n and kinds[value + 1] == "clock" else [value]
            elif value < n and part == "level" and level is None:
                level = value
            elif value < n and part == "target" and component is None:
                component, kind = value, "target"
            k = max(k, value - 1) if part == "message" else max(k, value)
        elif is_a == "mark":
            if token in (SLOT, "'", "`", ";", "<", ">") and not structured:
                break
        elif is_a in ("time", "date", "clock", "epoch") and not structured:
            if not times or (times[-1] == k - 1 and is_a == "clock"):
                times.append(k)
        elif is_a == "month" and not times and kinds[k + 1 : k + 3] == ["number", "clock"]:
            times = [k, k + 1, k + 2]
            k += 2
        elif is_a == "stamp" and level is None and k == 0:
            level, times = k, [k]
        elif is_a in ("level", "letter") and level is None and (is_a == "level" or times):
            level = k
            needs |= is_a == "letter"
            if not structured and (after(k, ":") or (after(k, "[") and seq[k + 3 : k + 5] == ["]", ":"])):
                break  # what follows a colon is the message
        elif is_a in ("module", "source") and component is None and not structured:
            component, kind = k, is_a
            if level is not None:
                break
        elif structured or is_a == "number":
            continue
        elif is_a == "word" and after(k, "[") and kinds[k + 2 : k + 3] == ["number"] and seq[k + 3 : k + 4] == ["]"] and component is None:
            component, kind = k, "program"
            k += 3
        elif is_a == "word" and k and seq[k - 1] == "[" and after(k, "]") and component is None:
            component, kind, needs = k, "name", True
        elif is_a == "word" and k == 0 and kinds[1:2] == ["level"] and after(1, ":"):
            component, kind = k, "name"
        elif is_a == "word" and times and level is None and component is None:
            continue  # the host
        else:
            break
    if level is None or (component is None and level != 0):
        return {}
    layout = " ".join(t if kinds[i] == "mark" else kinds[i] for i, t in enumerate(seq[: max([level, *times, component or 0]) + 1]))
    return {"level": level, "component": "=rustc" if component is None else component, "kind": kind, "time": times, "needs": needs, "layout": layout}


def moment(text: str | None, year: int | None) -> str:
    """yyyy-MM-dd HH:mm:ss in UTC, or empty."""
    if not text:
        return ""
    try:
        if re.fullmatch(r"\d{13}|\d{10}", text):
            at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(text[:10]))
        elif m := re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,]\d+)?(Z|[+-]\d\d:?\d\d)?", text):
            at = datetime.fromisoformat(f"{m[1]} {m[2]}" + ("+00:00" if (m[3] or "Z") == "Z" else m[3]))
        elif m := re.fullmatch(r"(\w{3}) +(\d\d?) (\d\d):(\d\d):(\d\d)(?:[.,]\d+)?", text):
            at = datetime(year, MONTHS.index(m[1].lower()) + 1, int(m[2]), int(m[3]), int(m[4]), int(m[5]), tzinfo=timezone.utc)
        elif m := re.fullmatch(r"(\d\d)(\d\d) (\d\d):(\d\d):(\d\d)(?:\.\d+)?", text):
            at = datetime(year, int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), tzinfo=timezone.utc)
        else:
            return ""
    except (ValueError, TypeError, OverflowError):
        return ""
    return at.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def fields(line: Line, template: Template, roles: dict, year: int | None) -> tuple[str, str, str] | None:
    """(level, component, logged_at) of a line by the parts of its template's places; None if its values don't play them."""
    places = template.places(line.seq)
    if places is None:
        return None

    def text(first: int, end: int) -> str:
        s, e = places[first][0], places[end][0] if end < len(places) else len(line.raw)
        return line.line[line.spans[s][0] : line.spans[e - 1][1]] if e > s else ""

    of = lambda k: line.raw[places[k][0]]
    level, component, kind = roles["level"], roles["component"], roles["kind"]
    if not isinstance(level, str):
        level = "=" + LEVELS.get(of(level).lower(), LEVELS.get(of(level)[0].lower(), "") if type_of(of(level)) == "stamp" else "")
    if not isinstance(component, str):
        component = "=" + (text(*component) if kind == "location" else of(component))
        if kind == "source":
            component = re.sub(r":\d+(:\d+)?$", "", component)
    when = [of(k) for k in roles["time"]]
    if when and type_of(when[0]) == "stamp":
        when[0] = when[0][1:]
    return None if level == "=" or component == "=" else (level[1:], component[1:], moment(" ".join(when), year))


def opening_lines(text: str) -> Iterator[tuple[int, str, str]]:
    """(number, line, the line with its continuation) of the lines that aren't continuation by their form."""
    number, chunk, header = -1, [], False
    for n, line in enumerate(lines_of(text)):
        if not line.strip() or line[0].isspace() or header or _NUMBERED.match(line):
            header = False
            if number >= 0:
                chunk.append(line)
            continue
        if number >= 0:
            yield number, chunk[0], "\n".join(chunk)
        number, chunk, header = n, [line], _HEADER.search(line) is not None
    if number >= 0:
        yield number, chunk[0], "\n".join(chunk)


_LINES = "id bigint, line_no bigint, year int, line string, chunk string, template string, stats string"
_LINE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]


def _written(n: int, types: list[Counter]) -> str:
    return json.dumps([n, types])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opening lines with the template that a task has for them at the end of a batch; the first line of each template in a
    batch carries its counts."""
    mined = Templates()
    known: dict[str, tuple[Counter, str | None]] = {}
    for batch in batches:
        if len(mined.all) > HELD:
            mined = Templates()
        for t in mined.all:  # counts are those of a batch
            t.n, t.types = 0, [Counter() for _ in t.seq]
        rows, own = [], []
        for rid, text, year in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for n, line, chunk in opening_lines(text):
                x = Line(line)
                types = []
                for raw in x.raw:
                    if (one := known.get(raw)) is None:
                        one = Counter({type_of(raw): 1})
                        one = known[raw] = one, _strong(one)
                    types.append(one)
                own.append(mined.add(x.seq, [c for c, _ in types], strong=[k for _, k in types]))
                rows.append((rid, n, year, line, chunk))
            if len(known) > 200_000:
                known.clear()
        names = {k: " ".join(mined.all[k].seq) for k in set(own)}
        first = {k: n for n, k in reversed(list(enumerate(own)))}
        stats = [_written(mined.all[k].n, mined.all[k].types) if first[k] == n else None for n, k in enumerate(own)]
        cols = [*(list(zip(*rows)) or [()] * 5), [names[k] for k in own], stats]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _LINE_TYPES)], ["id", "line_no", "year", "line", "chunk", "template", "stats"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(template, stats) of a partition -> (template, merged, stats): stats of the merged template in one of its rows."""
    given = sorted((t, s) for b in batches for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    rows = sorted(((json.loads(s), t) for t, s in given), key=lambda x: -x[0][0])
    merged = Templates()
    at = [merged.add(t.split(" "), [Counter(c) for c in types], n) for (n, types), t in rows]
    first = {k: n for n, k in reversed(list(enumerate(at)))}
    out = [(t, " ".join(merged.all[k].seq), _written(merged.all[k].n, merged.all[k].types) if first[k] == n else None) for n, (k, (_, t)) in enumerate(zip(at, rows))]
    cols = list(zip(*out)) or [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["template", "merged", "stats"])


def merged_templates(mined: DataFrame, held: int = HELD) -> DataFrame:
    """mined (template, stats) -> (template, merged, stats): the templates of all tasks brought together in rounds, each
    in tasks of about `held` templates at most, until they are those of one task or grow no fewer."""
    now = staged(mined.repartition(1 if (n := mined.count()) <= held else math.ceil(n / held), F.xxhash64("template", "stats")).mapInArrow(_merge, "template string, merged string, stats string"), "templates")
    names = now.select("template", "merged").distinct()
    while True:
        left = now.filter("stats is not null").select(F.col("merged").alias("template"), "stats")
        before, n = n, left.count()
        if before <= held or n > 0.9 * before:
            return names.join(left.withColumnRenamed("template", "merged"), "merged").select("template", "merged", "stats")
        now = staged(left.repartition(math.ceil(n / held), F.xxhash64("template", F.lit(n))).mapInArrow(_merge, "template string, merged string, stats string"), "templates")
        step = now.select(F.col("template").alias("merged"), F.col("merged").alias("next")).distinct()
        names = staged(names.join(step, "merged").select("template", F.col("next").alias("merged")).distinct(), "names")


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for merged, stats in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, types = json.loads(stats)
            roles = parts(merged.split(" "), [Counter(c) for c in types])
            if roles:
                out.append((merged, json.dumps(roles), roles.get("layout", ""), roles.get("needs", False), n))
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["merged", "roles", "layout", "needs", "n"])


def parsed_lines(df: DataFrame, key: str, text: str, when: str) -> tuple[DataFrame, DataFrame]:
    """(lines, templates) of log texts: the opening lines, and (template, merged, roles) of the templates that begin an entry."""
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.year(when).cast("int").alias("year")).filter("id is not null and text <> ''")
    lines = staged(source.mapInArrow(_mine, _LINES), "lines")
    merged = staged(merged_templates(lines.filter("stats is not null").select("template", "stats")), "merged")
    versions = merged.groupBy("merged").agg(F.max("stats").alias("stats"))  # a template merged alike in several tasks
    roles = versions.mapInArrow(_classified, "merged string, roles string, layout string, needs boolean, n bigint")
    recurring = roles.filter("n > 1").select("layout").distinct().withColumn("recurs", F.lit(True))
    kept = roles.join(recurring, "layout", "left").filter("not needs or recurs")
    return lines, staged(merged.select("template", "merged").distinct().join(kept.select("merged", "roles"), "merged"), "roles")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[Template, dict]] = {}
    for b in batches:
        out = []
        for rid, n, year, line, chunk, merged, roles in zip(*(b.column(k).to_pylist() for k in range(7))):
            got = None
            if merged is not None:
                if merged not in held:
                    if len(held) > HELD:
                        held.clear()
                    seq = merged.split(" ")
                    held[merged] = Template(seq, [Counter()] * len(seq), 0), json.loads(roles)
                got = fields(Line(line), *held[merged], year)
            out.append((rid, n, *(got or (None, None, None)), chunk))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "line_no", "level", "component", "logged_at", "chunk"])


def log_entries(df: DataFrame, key: str, text: str, when: str) -> DataFrame:
    """(key, line_no, level, component, logged_at, message): one row for each entry of each text.

    line_no is the 0-based number of the entry's first line. Lines before the first entry belong to none. Rows with a null
    key or text, and empty texts, give nothing; a repeated row gives its entries once. A null `when` leaves entries
    without a year in their time without a time. Other columns are ignored, whatever their names; an empty table gives
    an empty one. Texts are read whole."""
    lines, templates = parsed_lines(df, key, text, when)
    if templates.count() <= BROADCAST:
        templates = F.broadcast(templates)
    joined = lines.join(templates, "template", "left").select("id", "line_no", "year", "line", "chunk", "merged", "roles")
    read = joined.mapInArrow(_read, "id bigint, line_no bigint, level string, component string, logged_at string, chunk string")
    each = read.repartition("id").dropDuplicates(["id", "line_no"])
    order = Window.partitionBy("id").orderBy("line_no")
    counted = each.withColumn("entry", F.count("level").over(order)).filter("entry > 0")
    entry = counted.groupBy("id", "entry").agg(
        F.min("line_no").alias("line_no"), F.max("level").alias("level"), F.max("component").alias("component"), F.max("logged_at").alias("logged_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "chunk"))), lambda x: x.chunk), "\n").alias("message"),
    )
    return entry.select(F.col("id").alias(key), "line_no", "level", "component", "logged_at", "message")
