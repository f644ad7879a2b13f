"""Runs of an external program over files, in Spark tasks."""

from __future__ import annotations

import os
import signal
import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructType


def run_once(args: list[str], source: str, seconds: float) -> tuple[str, int | None, int | None, str]:
    """(kind, exit status, signal, stderr) of one command, in a folder of its own in which `{file}` holds the source. The
    program's whole group is killed when its time is over; what it wrote until then counts."""
    with tempfile.TemporaryDirectory() as folder:
        file = os.path.join(folder, "input.rs")
        with open(file, "w", encoding="utf-8") as f:
            f.write(source)
        try:
            p = subprocess.Popen([a.replace("{file}", file) for a in args], cwd=folder, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, env=os.environ | {"RUSTC_ICE": "0"}, start_new_session=True)
        except OSError as e:
            return "SpawnFailed", None, None, str(e)
        try:
            err = p.communicate(timeout=seconds)[1]
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            return "WallTimeout", None, None, p.communicate()[1].decode("utf-8", "replace")
        text = err.decode("utf-8", "replace")
        return ("Signal", None, -p.returncode, text) if p.returncode < 0 else ("Normal", p.returncode, None, text)


def executed(runs: DataFrame, args: str, source: str, seconds: float = 10.0) -> DataFrame:
    """runs with termination, exit_status and stderr; `args` array<string> is the command, `source` the text. A null source is
    an empty file."""
    schema = StructType([*runs.schema.fields]).add("kind", StringType()).add("exit_status", IntegerType()).add("signal", IntegerType()).add("stderr", StringType())
    names = runs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [run_once(a, s or "", seconds) for a, s in zip(b.column(args).to_pylist(), b.column(source).to_pylist())]
            kind, status, sig, err = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind, pa.string()), pa.array(status, pa.int32()), pa.array(sig, pa.int32()), pa.array(err, pa.string())], [*names, "kind", "exit_status", "signal", "stderr"])

    return runs.mapInArrow(run, schema)
