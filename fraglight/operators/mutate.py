"""Deterministic mutants: picks are hashes of what is picked for, so a run can be repeated in any engine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from fraglight.functions.families import families_of
from fraglight.functions.text import FALSE_POSITIVES, contains_any, find_stripped, provenance, splice
from fraglight.operators.ranking import pick

# What a primitive type and a value are replaced by.
TYPES = ["i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "()", "char", "str", "(_)"]
VALUES = ["0", "1", "-1", "1.0", "'a'", '"A"', "()", "_", "(_)", "true", "false", "0xffff_ffff_ffff_ffff"]
#: Places of a placeholder that are looked at in a fragment, before those inside words are left out.
PLACES = 2


@dataclass(frozen=True)
class Config:
    """Shares in percent: of mutants by splicing, else of types, values and attributes; of mutants that get the dependencies of
    their snippets; of slots that take a snippet of any bucket; of snippets that are left empty. Snippets come from both domains
    (sources and fragments), or from sources only. Passes are numbers of slots, each of which has as many attempts."""

    splice: int = 96
    types: int = 60
    values: int = 10
    attributes: int = 30
    placeholders: bool = True
    dependencies: int = 100
    chaotic: int = 10
    deleted: int = 10
    both: bool = True
    passes: tuple[int, ...] = ()
    per_seed: int = 10


#: Profiles that leave features out; their names are fixed values, but for full, baseline and edits_only.
PROFILES = {
    "full": Config(),
    "source-only": Config(both=False),
    "source-only-no-other": Config(both=False, placeholders=False, dependencies=0),
    "source-only-no-other-no-misc": Config(both=False, placeholders=False, dependencies=0, splice=100),
    "no-dep-plc-misc": Config(placeholders=False, dependencies=0, splice=100),
    "half-dep-prob": Config(dependencies=50),
    "baseline": Config(both=False, placeholders=False, dependencies=0, splice=100, chaotic=30, passes=tuple(range(2, 10))),
    "edits_only": Config(splice=0),
}


def branch(config: Config, *key: Column) -> Column:
    """The way a mutant is made."""
    first, second = F.pmod(pick(*key, F.lit("way")), F.lit(100)), F.pmod(pick(*key, F.lit("edit")), F.lit(100))
    edit = F.when(second < config.types, "type").when(second < config.types + config.values, "value").otherwise("attribute")
    return F.when(first < config.splice, "splice").otherwise(edit)


def picked_slot(slots: DataFrame, key: str, salt: str) -> DataFrame:
    """One slot (s, e) of each source, the least by hash; an aggregate, so no source's slots are gathered."""
    h = F.struct(pick(F.col(key).cast("string"), F.col("s").cast("string"), F.lit(salt)).alias("h"), "s", "e")
    return slots.groupBy(key).agg(F.min(h).alias("m")).select(key, "m.s", "m.e")


def replaced(slots: DataFrame, files: DataFrame, key: str, text: str, choices: list[str], salt: str) -> DataFrame:
    """(key, mutant): one slot of each source replaced by one of the choices."""
    listed = F.array(*map(F.lit, choices))
    which = F.pmod(pick(F.col(key).cast("string"), F.lit(salt), F.lit("choice")), F.lit(len(choices)))
    chosen = picked_slot(slots, key, salt).withColumn("t", F.get(listed, which.cast("int")))
    return chosen.join(files.select(key, text), key).select(key, splice(F.col(text), F.array(F.struct("s", "e", "t"))).alias("mutant"))


def type_mutants(nodes: DataFrame, files: DataFrame, key: str, text: str) -> DataFrame:
    return replaced(nodes.filter("kind = 'primitive_type'"), files, key, text, TYPES, "type")


def value_mutants(nodes: DataFrame, files: DataFrame, key: str, text: str) -> DataFrame:
    slots = nodes.filter(F.array_contains(families_of(F.col("kind")), "Expr") & (F.col("kind") != "identifier"))
    return replaced(slots, files, key, text, VALUES, "value")


def attribute_mutants(nodes: DataFrame, files: DataFrame, key: str, text: str, attributes: DataFrame) -> DataFrame:
    """An attribute on a line of its own before one declaration; attributes (n, attribute) are numbered from 0."""
    size = attributes.agg(F.count("*").alias("size"))
    slots = nodes.filter(F.array_contains(families_of(F.col("kind")), "DeclStmt"))
    chosen = picked_slot(slots, key, "attribute").crossJoin(F.broadcast(size)).filter("size > 0")  # one row
    chosen = chosen.withColumn("n", F.pmod(pick(F.col(key).cast("string"), F.lit("attribute"), F.lit("choice")), F.col("size")))
    edit = F.array(F.struct("s", F.col("s").alias("e"), F.concat("attribute", F.lit("\n")).alias("t")))
    return chosen.join(attributes, "n").join(files.select(key, text), key).select(key, splice(F.col(text), edit).alias("mutant"))


def fill(fragment: str, pairs: list[tuple[str, str]]) -> str:
    """A fragment with placeholders replaced in turn, at most PLACES of each, none inside a word; later ones see earlier ones."""
    for name, new in pairs:
        spans = find_stripped(fragment, name, bound=PLACES + 1)
        raw = fragment.encode()
        for s, e in reversed(spans):
            before, after = raw[:s].decode()[-1:], raw[e:].decode()[:1]
            if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
                raw = raw[:s] + new.encode() + raw[e:]
        fragment = raw.decode()
    return fragment


def filled(df: DataFrame, fragment: str, names: str, values: str, out: str = "filled") -> DataFrame:
    """df with the fragment's placeholders (array<string>) replaced by the values at the same places; null values replace nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(fragment).to_pylist(), b.column(names).to_pylist(), b.column(values).to_pylist())
            made = [None if f is None else fill(f, [(n, v) for n, v in zip(ns or [], vs or []) if n and v is not None]) for f, ns, vs in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, out])


    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, StringType()))


def identified(mutants: DataFrame, text: str, seed: Column, others: Column) -> DataFrame:
    """Mutants without words that feign a crash, with their trailer (content) and an id of it; equal ones have equal ids."""
    kept = mutants.filter(F.col(text).isNotNull() & ~contains_any(F.col(text), FALSE_POSITIVES)).withColumn("content", F.concat(text, provenance(seed, others)))
    return kept.withColumn("id", F.sha2("content", 256))


def finished(mutants: DataFrame, text: str, seed: Column, others: Column) -> DataFrame:
    """Those, equal ones once."""
    return identified(mutants, text, seed, others).dropDuplicates(["id"])
