"""How runs ended: labels, hints and signal names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SIGNALS = {1: "SIGHUP", 2: "SIGINT", 3: "SIGQUIT", 4: "SIGILL", 6: "SIGABRT", 8: "SIGFPE", 9: "SIGKILL", 11: "SIGSEGV", 13: "SIGPIPE", 14: "SIGALRM", 15: "SIGTERM", 24: "SIGXCPU", 25: "SIGXFSZ"}
LABELS = {"Normal": "normal", "WallTimeout": "WALL_TIMEOUT", "MemoryExceeded": "MEMORY_EXCEEDED", "SpawnFailed": "SPAWN_FAILED", "Unknown": "UNKNOWN"}
HINTS = {"WallTimeout": "compilation exceeded wall-clock timeout", "MemoryExceeded": "RSS exceeded configured --memory limit", "SpawnFailed": "could not start the compiler process"}
SIGNAL_HINTS = {24: "CPU time limit exceeded (RLIMIT_CPU)", 9: "killed — possibly OOM (RLIMIT_AS) or external kill", 6: "aborted — possibly OOM or assertion failure", 11: "segmentation fault"}
OUT_OF_MEMORY = ["memory allocation of", "out of memory", "alloc::oom", "cannot allocate memory"]


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v)))[key]


def signal_name(signal: Column) -> Column:
    return F.coalesce(_lookup(SIGNALS, signal), F.lit("SIG?"))


def label(kind: Column, signal: Column) -> Column:
    named = F.concat(signal_name(signal), F.lit(" ("), signal.cast("string"), F.lit(")"))
    return F.when(kind == "Signal", named).otherwise(_lookup(LABELS, kind))


def hint(kind: Column, signal: Column) -> Column:
    return F.when(kind == "Signal", F.coalesce(_lookup(SIGNAL_HINTS, signal), F.lit(""))).otherwise(F.coalesce(_lookup(HINTS, kind), F.lit("")))


def hints_oom(stderr: Column) -> Column:
    return F.coalesce(F.lower(stderr).rlike("|".join(OUT_OF_MEMORY)), F.lit(False))


def reclassified(kind: Column, signal: Column, stderr: Column) -> Column:
    """An abort or kill whose stderr tells of memory exceeded it."""
    return F.when((kind == "Signal") & signal.isin(6, 9) & hints_oom(stderr), "MemoryExceeded").otherwise(kind)
