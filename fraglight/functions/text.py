"""Text expressions on the JVM side, and the byte-span search that needs a position map."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches that a search with this bound returns: one fewer than the bound; 0 is no bound.
LOCATED_BOUND = 10
#: Texts with one of these aren't crashes of the compiler itself.
FALSE_POSITIVES = [
    "panicked at", "RUST_BACKTRACE=", "(core dumped)", "mir!", "#![no_core]", "#[rustc_symbol_name]", "break rust",
    "#[rustc_variance]", "qemu: uncaught target signal", "core_intrinsics", "platform_intrinsics", "::SIGSEGV", "SIGSEGV::",
    "span_delayed_bug_from_inside_query", "rustc_layout_scalar_valid_range_end", "rustc_attrs", "staged_api", "lang_items",
    "#[rustc_intrinsic]",
]
#: A seed with one of these is left out.
SEED_WORDS = ["no_core", "lang_items", "mir!(", "break rust"]
#: A seed whose path contains one of these is left out (endless, slow or large to compile).
SEED_PATHS = [
    "icemaker",
    "tests/ui/closures/issue-72408-nested-closures-exponential.rs",
    "tests/ui/issues/issue-74564-if-expr-stack-overflow.rs",
    "library/stdarch/crates/core_arch/src/mod.rs",
    "tests/ui/issues/issue-50811.rs",
    "tests/ui/issues/issue-29466.rs",
    "src/tools/miri/tests/run-pass/float.rs",
    "tests/ui/numbers-arithmetic/saturating-float-casts-wasm.rs",
    "tests/ui/numbers-arithmetic/saturating-float-casts-impl.rs",
    "tests/ui/numbers-arithmetic/saturating-float-casts.rs",
    "tests/ui/wrapping-int-combinations.rs",
    "fixed/23600.rs",
    "23600.rs",
    "fixed/71699.rs",
    "71699.rs",
    "library/stdarch/crates/core_arch/src/x86/avx512bw.rs",
    "library/stdarch/crates/core_arch/src/x86/mod.rs",
    "library/stdarch/crates/core_arch/src/lib.rs",
    "tests/run-make-fulldeps/issue-47551/eh_frame-terminator.rs",
    "tests/ui/recursion/issue-38591-non-regular-dropck-recursion.rs",
    "tests/ui/dropck/dropck_no_diverge_on_nonregular_2.rs",
    "tests/ui/dropck/dropck_no_diverge_on_nonregular_1.rs",
    "library/core/src/lib.rs",
    "library/stdarch/crates/core_arch/src/mod.rs",
    "compiler/rustc_middle/src/lib.rs",
    "library/stdarch/crates/core_arch/src/x86/avx512f.rs",
    "tests/ui/structs-enums/struct-rec/issue-84611.rs",
    "tests/ui/structs-enums/struct-rec/issue-74224.rs",
    "tests/ui/dropck/dropck_no_diverge_on_nonregular_3.rs",
    "library/portable-simd/crates/core_simd/src/lib.rs",
    "tests/ui-fulldeps/myriad-closures.rs",
    "src/tools/miri/tests/pass/float.rs",
    "library/stdarch/crates/core_arch/src/arm_shared/neon/generated.rs",
    "library/stdarch/crates/core_arch/src/aarch64/mod.rs",
    "library/stdarch/crates/core_arch/src/aarch64/neon/generated.rs",
    "library/stdarch/crates/core_arch/src/aarch64/neon/mod.rs",
    "src/tools/cargo/tests/testsuite/main.rs",
    "src/tools/clippy/clippy_lints/src/lib.rs",
    "library/stdarch/crates/stdarch-gen/src/main.rs",
    "src/tools/rust-analyzer/crates/proc-macro-srv/src/abis/abi_1_58/proc_macro/mod.rs",
    "src/tools/rust-analyzer/crates/proc-macro-srv/src/abis/abi_1_63/proc_macro/mod.rs",
    "tests/ui/issues/issue-22638.rs",
    "tests/ui/issues/issue-72933-match-stack-overflow.rs",
    "tests/ui/recursion/issue-86784.rs",
    "tests/ui/associated-types/issue-67684.rs",
]


def stripped(text: Column, commas: bool = True) -> Column:
    """Without Unicode white space, and without commas."""
    return F.regexp_replace(text, r"(?U)[\s,]" if commas else r"(?U)\s", "")


def without_comments(code: Column) -> Column:
    """Without // comments (their line end stays) and /* */ comments, which don't nest; string literals aren't spared."""
    return F.regexp_replace(code, r"//[^\n]*|/\*(?s:.*?)(\*/|\z)", "")


def compiler_location(location: Column) -> Column:
    """From the first `compiler` on; null without one."""
    at = F.locate("compiler", location)
    return F.when(at > 0, F.substr(location, at))


def json_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".json"))


def preview(text: Column, most: int = 80) -> Column:
    """The first characters on one line."""
    short = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return F.replace(short, F.lit("\n"), F.lit("\\n"))


def prompt(source: Column, front: str, end: str) -> Column:
    return F.concat(F.lit(front), source, F.lit("\n"), F.lit(end))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, r"(?U)\s", "") == "")


def holds_main(fragment: Column) -> Column:
    """Whether a fragment is left out: it has `main` anywhere, also within a word."""
    return F.contains(fragment, F.lit("main"))


def without_main(dependencies: Column) -> Column:
    """Dependencies that don't define a main function."""
    return F.filter(dependencies, lambda d: d.isNotNull() & ~F.contains(d, F.lit("fn main")))


def utc_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def seed_ignored(text: Column, path: Column, exceptions: list[str] = SEED_PATHS, lines: int = 400, width: int = 1000) -> Column:
    """Whether a seed is left out: too many or too wide lines, special words, or a path that contains an exception."""
    each = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    known = F.contains(text, F.lit("failure-status: 101")) & F.contains(text, F.lit("known-bug"))
    return (F.size(each) > lines) | contains_any(text, SEED_WORDS) | known | F.exists(each, lambda x: F.length(x) > width) | contains_any(path, exceptions)


def dependency_prefix(deps: Column) -> Column:
    """All dependencies, each ended by a line end; sorted, each once."""
    kept = F.array_sort(F.array_distinct(F.filter(deps, lambda d: d.isNotNull())))
    return F.array_join(F.transform(kept, lambda d: F.when(F.endswith(d, F.lit("\n")), d).otherwise(F.concat(d, F.lit("\n")))), "")


def provenance(seed: Column, others: Column) -> Column:
    """A trailer of comments that names the seed and the other files."""
    return F.concat(F.lit("\n\n// "), seed, F.array_join(F.transform(others, lambda o: F.concat(F.lit("\n// "), o)), ""), F.lit("\n"))


#: Fixed value: Unicode white space, as a character class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = np.zeros(0x3001, bool)
_WHITE[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BLANK, _BLANK_COMMA = re.compile(f"[{WHITE}]"), re.compile(f"[{WHITE},]")


class Stripped:
    """A text without white space (and commas), with the place in bytes of each character that is left."""

    def __init__(self, text: str, commas: bool = True):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = _WHITE[np.minimum(chars, 0x3000)] & (chars <= 0x3000)
        if commas:
            blank |= chars == 44
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        kept = np.flatnonzero(~blank)
        self.end = np.cumsum(width)[kept]
        self.begin = self.end - width[kept]
        self.text = chars[kept].tobytes().decode("utf-32-le", "surrogatepass")

    def find(self, want: str, bound: int, start: int = 0) -> list[tuple[int, int]]:
        """Byte spans of non-overlapping matches of a stripped needle from byte `start` on."""
        out: list[tuple[int, int]] = []
        at = self.text.find(want, int(np.searchsorted(self.begin, start))) if want else -1
        while at >= 0 and (bound == 0 or len(out) < bound - 1):
            out.append((int(self.begin[at]), int(self.end[at + len(want) - 1])))
            at = self.text.find(want, at + len(want))
        return out


def find_stripped(haystack: str, needle: str, commas: bool = True, bound: int = LOCATED_BOUND, start: int = 0) -> list[tuple[int, int]]:
    """Byte spans of non-overlapping matches that white space (and commas) don't matter for, from byte `start` on."""
    return Stripped(haystack, commas).find((_BLANK_COMMA if commas else _BLANK).sub("", needle), bound, start)


#: Needles of one text that a worker gets at once.
NEEDLES = 512


def located(pairs: DataFrame, texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str, needle: str, commas: bool = True, bound: int = LOCATED_BOUND, start: str | None = None) -> DataFrame:
    """(text_id, needle_id, s, e, match_no): the byte spans of the needle in the text for each pair of ids, from the pair's `start` on if
    such a column is named. A text is stripped once for its needles, which come in lists of bounded size. Ids are unique in
    texts and in needles; null and blank texts match nothing."""
    blank = _BLANK_COMMA if commas else _BLANK
    kinds = {text_id: texts.schema[text_id].dataType.simpleString(), needle_id: needles.schema[needle_id].dataType.simpleString()}
    wanted = pairs.select(text_id, needle_id, (F.col(start) if start else F.lit(0)).cast("bigint").alias("_s")).join(needles.select(needle_id, F.col(needle).alias("_n")).filter("_n is not null"), needle_id)
    counts = pairs.groupBy(text_id).agg((F.count("*") / NEEDLES + 1).cast("int").alias("_lists"))
    listed = wanted.join(counts, text_id).groupBy(text_id, F.pmod(F.xxhash64(needle_id), F.col("_lists")).alias("_list")).agg(F.collect_list(F.struct(F.col(needle_id).alias("k"), F.col("_n").alias("n"), F.col("_s").alias("s"))).alias("_needles"))
    joined = listed.join(texts.select(text_id, F.col(text).alias("_h")).filter("_h is not null"), text_id).select(text_id, "_h", "_needles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ids = lists.flatten().field("k")
            words, starts = (lists.flatten().field(x).to_pylist() for x in ("n", "s"))
            offsets = lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            found = []
            for r, h in enumerate(b.column(1).to_pylist()):
                plain = Stripped(h, commas)
                for k in range(offsets[r], offsets[r + 1]):
                    found += [(r, k, s, e, n) for n, (s, e) in enumerate(plain.find(blank.sub("", words[k]), bound, starts[k]))]
            rows, own, s, e, n = list(zip(*found)) or [()] * 5
            cols = [b.column(0).take(pa.array(rows, pa.int64())), ids.take(pa.array(own, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (s, e, n))], [text_id, needle_id, "s", "e", "match_no"])

    return joined.mapInArrow(run, f"`{text_id}` {kinds[text_id]}, `{needle_id}` {kinds[needle_id]}, s bigint, e bigint, match_no bigint")


def splice(text: Column, edits: Column, most: int = 0) -> Column:
    """text with edits array<struct<s:bigint,e:bigint,t:string>> (byte spans) put in: sorted by start, an edit that overlaps an
    earlier one is dropped, as is one out of bounds."""
    raw = text.cast("binary")  # its bytes as they are, not encoded again for each edit
    size = F.octet_length(text).cast("bigint")
    valid = F.array_sort(F.filter(edits, lambda x: (x.s >= 0) & (x.s <= x.e) & (x.e <= size)))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        piece = F.decode(F.substring(raw, (state.at + 1).cast("int"), (x.s - state.at).cast("int")), "UTF-8")
        return F.when((x.s >= state.at), F.struct(x.e.alias("at"), F.concat(state.out, piece, x.t).alias("out"))).otherwise(state)

    def finish(state: Column) -> Column:
        return F.concat(state.out, F.decode(F.substring(raw, (state.at + 1).cast("int"), size.cast("int")), "UTF-8"))

    return F.aggregate(valid, zero, step, finish)
