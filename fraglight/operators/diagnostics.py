"""Crash records out of diagnostics, deduplicated by first sighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraglight.functions.text import compiler_location

# The lines that tell of a crash.
_PANIC = r"(?d)^thread 'rustc'(?: \(([0-9]+)\))? panicked at (.*?): (.*)$"
_ERROR = r"(?d)^error: internal compiler error: (.*?): (.*)$"
_NOTE = r"(?d)^note: delayed at (.*:\d+)(.*)$"
_HEADER = r"(?d)^thread 'rustc'(?: \(([0-9]+)\))? panicked at (.*?):$"
_ICE = "array<struct<location:string,reason:string>>"


def _crash(location: Column, reason: Column) -> Column:
    return F.struct(location.alias("location"), reason.alias("reason"))


def crashes(stderr: Column) -> Column:
    """array<struct<location,reason>> of a diagnostic text, each once: those on one line first, then panics whose reason is
    on the line after. A null text has none. A line that is a panic's reason doesn't open another one."""
    lines = F.split(stderr, "\r?\n")

    def one(line: Column) -> Column:
        get = lambda p, k: F.regexp_extract(line, p, k)
        return (
            F.when(F.rlike(line, F.lit(_PANIC)), _crash(get(_PANIC, 2), get(_PANIC, 3)))
            .when(F.rlike(line, F.lit(_ERROR)), _crash(get(_ERROR, 1), get(_ERROR, 2)))
            .when(F.rlike(line, F.lit(_NOTE)), _crash(get(_NOTE, 1), get(_NOTE, 2)))
        )

    single = F.filter(F.transform(lines, one), lambda x: x.isNotNull())
    start = F.struct(F.lit("").alias("open"), F.array().cast(_ICE).alias("out"))

    def step(state: Column, line: Column) -> Column:
        closed = F.when(F.trim(line) == "", state.out).otherwise(F.array_append(state.out, _crash(state.open, F.trim(line))))
        opens = F.when(F.rlike(line, F.lit(_HEADER)), F.regexp_extract(line, _HEADER, 2)).otherwise("")
        return F.when(state.open != "", F.struct(F.lit("").alias("open"), closed.alias("out"))).otherwise(F.struct(opens.alias("open"), state.out.alias("out")))

    double = F.aggregate(lines, start, step, lambda s: s.out)
    return F.coalesce(F.array_distinct(F.concat(single, double)), F.array().cast(_ICE))


def compiler_only(ices: Column) -> Column:
    """Crashes with a place in the compiler, their location from there on."""
    moved = F.transform(ices, lambda x: _crash(compiler_location(x.location), x.reason))
    return F.coalesce(F.filter(moved, lambda x: x.location.isNotNull()), F.array().cast(_ICE))


def first_sightings(crashes_: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row for each value of `by`, whole. An aggregate, so a hot value is reduced before it is shuffled."""
    rest = [c for c in crashes_.columns if c not in by and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("first")
    return crashes_.groupBy(*by).agg(first).select(*by, "first.*")


def progress(crashes_: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (campaign_id, iter, file), crashes_ (campaign_id, iter, file, location) -> for each iteration with runs: runs,
    files with a crash, locations that are new to the campaign, and the running total of these."""
    firsts = crashes_.groupBy("campaign_id", "location").agg(F.min("iter").alias("iter"))
    new = firsts.groupBy("campaign_id", "iter").agg(F.count("*").alias("new_locations"))
    hit = crashes_.groupBy("campaign_id", "iter").agg(F.count_distinct("file").alias("ice_files"))
    every = runs.groupBy("campaign_id", "iter").agg(F.count("*").alias("runs"))
    order = Window.partitionBy("campaign_id").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    joined = every.join(hit, ["campaign_id", "iter"], "left").join(new, ["campaign_id", "iter"], "left").fillna(0, ["ice_files", "new_locations"])
    return joined.withColumn("cumulative", F.sum("new_locations").over(order))
