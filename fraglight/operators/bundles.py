"""Commands, reports and logs built from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraglight.functions.termination import hint, label


def needs_library(source: Column) -> Column:
    return ~F.contains(F.coalesce(source, F.lit("")), F.lit("fn main"))


def command(compiler: str, flags: Column, source: Column, file: Column, memory_mb: int = 1024, seconds: int = 10, extra: list[str] | None = None) -> Column:
    """array<string>: limits, compiler, flags, --crate-type=lib where there is no main, the file, extra arguments."""
    limits = F.array(*map(F.lit, ("prlimit", f"--as={memory_mb * 1024 * 1024}", f"--cpu={seconds}", compiler)))
    library = F.when(needs_library(source), F.array(F.lit("--crate-type=lib"))).otherwise(F.array().cast("array<string>"))
    tail = F.array(*map(F.lit, extra)) if extra else F.array().cast("array<string>")
    return F.concat(limits, flags, library, F.array(file), tail)


def variants_of(files: DataFrame, variants: list[tuple[str, list[str]]]) -> DataFrame:
    """Every file with every variant (label, flags), a handful."""
    each = F.array(*(F.struct(F.lit(n).alias("label"), F.array(*map(F.lit, flags)).cast("array<string>").alias("flags")) for n, flags in variants))
    return files.select("*", F.explode(each).alias("v")).select("*", "v.label", "v.flags").drop("v")


def ending_summary(ended: DataFrame, by: str) -> DataFrame:
    """(by, summary) of runs (kind, signal, oom): a text of their counts, signals in order. Counts are made before anything is
    gathered, so what a summary is made of is a row for each kind and signal."""
    kind = F.col("kind")
    counts = ended.groupBy(by, "kind", "signal").agg(F.count("*").alias("n"), F.count_if("oom").alias("oom"))
    of = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0))
    signals = F.array_sort(F.collect_list(F.when(kind == "Signal", F.struct("signal", label(kind, F.col("signal")).alias("label"), "n"))))
    totals = counts.groupBy(by).agg(
        F.sum("n").alias("total"), of("Normal").alias("normal"), of("WallTimeout").alias("wall"), of("MemoryExceeded").alias("memory"), of("Signal").alias("killed"),
        of("SpawnFailed").alias("spawn"), of("Unknown").alias("unknown"), F.sum("oom").alias("oom"), signals.alias("signals"),
    )
    line = lambda name, n: F.concat(F.rpad(F.lit(f"  {name}:"), 22, " "), F.col(n).cast("string"), F.lit("\n"))
    some = lambda name, n: F.when(F.col(n) > 0, line(name, n)).otherwise("")
    each = F.array_join(F.transform("signals", lambda s: F.concat(F.lit("    "), s.label, F.lit(": "), s.n.cast("string"), F.lit("\n"))), "")
    always = [line("Total runs", "total"), line("Completed normally", "normal"), line("Wall-clock timeout", "wall"), line("Memory exceeded", "memory"), line("Killed by signal", "killed")]
    text = F.concat(*always, each, some("Spawn failed", "spawn"), some("Unknown", "unknown"), some("Stderr hints OOM", "oom"))
    return totals.select(by, text.alias("summary"))


def ending_line() -> Column:
    """Of a run (file, variant_label, kind, signal, peak_rss_mb, is_ice, oom): how it ended, in a line. Unknown names are `?`."""
    kind, signal = F.col("kind"), F.col("signal")
    known = lambda c: F.coalesce(F.col(c), F.lit("?"))
    hinted = F.when(hint(kind, signal) != "", F.concat(F.lit(" — "), hint(kind, signal))).otherwise("")
    memory = F.coalesce(F.concat(F.lit(" peak_rss="), F.col("peak_rss_mb").cast("string"), F.lit("MB")), F.lit(""))
    tags = F.concat(F.when(F.col("is_ice"), " ICE").otherwise(""), F.when(F.col("oom"), " (stderr suggests OOM)").otherwise(""))
    return F.concat(known("file"), F.lit(" ["), known("variant_label"), F.lit("] ["), F.coalesce(label(kind, signal), F.lit("?")), F.lit("]"), hinted, memory, tags)


def iteration_block(iter_: Column, mutants: Column, ice_files: Column, cumulative: Column, new: Column) -> Column:
    """The log text of an iteration; one without mutants was skipped."""
    head = F.format_string("[%d] mutants=%d ices=%d cumulative_locations=%d\n", iter_, mutants, F.coalesce(ice_files, F.lit(0)), F.coalesce(cumulative, F.lit(0)))
    lines = F.transform(F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("NEW_LOCATION: "), x, F.lit("\n")))
    return F.when(mutants.isNull(), F.format_string("[%d] SKIPPED (mutator failure)\n", iter_)).otherwise(F.concat(head, F.array_join(lines, "")))
