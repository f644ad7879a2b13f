"""A campaign of micro-batches with persistent state: the places seen, and a log row for each iteration.

A batch's new places are written before its log row; a batch counts as done once the log has it. One that was cut off in
between is done again: its places are told by their iteration, so they aren't taken for known ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglight.functions.text import utc_stamp
from fraglight.operators.diagnostics import compiler_only, crashes
from fraglight.sources.tables import path_names

HEADER = "started string, mutator string, budget_secs double, variants string"
SEEN, LOG = "location string, first_iter bigint, file string", "iter bigint, mutants bigint, ice_files bigint, new_unique bigint, cumulative bigint"


class Campaign:
    """A folder that is empty begins a campaign, one that has its log goes on with it, and one with anything else is refused."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        held = path_names(spark, folder)
        if held and not {"log", "seen", "runs"} & set(held):
            raise ValueError(f"{folder} isn't empty and holds no campaign")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not path_names(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def next_iteration(self) -> int:
        return self.log().agg(F.coalesce(F.max("iter") + 1, F.lit(0))).first()[0]

    def seen(self) -> DataFrame:
        """Places of the iterations that are done."""
        return self._read("seen", SEEN).filter(F.col("first_iter") < self.next_iteration()).dropDuplicates(["location"])

    def step(self, runs: DataFrame) -> int:
        """Takes in the runs (file, stderr) of the next iteration; gives its number."""
        number = self.next_iteration()
        found = runs.select("file", F.explode(compiler_only(crashes(F.col("stderr")))).alias("ice")).select("file", "ice.location")
        firsts = found.groupBy("location").agg(F.min("file").alias("file"))
        known = self.seen()
        new = firsts.join(known.select("location"), "location", "left_anti").select("location", F.lit(number).cast("bigint").alias("first_iter"), "file")
        new.write.mode("append").parquet(f"{self.folder}/seen")
        own = self._read("seen", SEEN).filter(F.col("first_iter") == number).select("location").distinct().count()
        before = known.count()
        totals = runs.agg(F.count_distinct("file")).first()[0], found.agg(F.count_distinct("file")).first()[0]
        self.spark.createDataFrame([(number, *totals, own, before + own)], LOG).write.mode("append").parquet(f"{self.folder}/log")
        return number

    def header(self, mutator: str, budget: float | None, variants: list[str]) -> None:
        """A row for this start of the campaign: when, by which mutator, for how long, and what is compiled."""
        row = self.spark.createDataFrame([(mutator, budget, ", ".join(variants))], "mutator string, budget_secs double, variants string")
        row.select(utc_stamp(F.current_timestamp()).alias("started"), "mutator", "budget_secs", "variants").coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def runs(self) -> DataFrame:
        return self._read("runs", HEADER)

    def run(
        self, mutator: Callable[[int], DataFrame], oracle: Callable[[DataFrame], DataFrame], iterations: int | None = None,
        budget: float | None = None, clock: Callable[[], float] = time.monotonic, cleanup: Callable[[DataFrame], None] | None = None,
    ) -> int:
        """Mutates, executes and takes in, until so many iterations are done or the budget of seconds is spent, which is looked at between
        iterations only; goes on where an earlier run ended. cleanup gets the runs of an iteration that crashed nothing. Gives
        the number of iterations."""
        began, done = clock(), 0
        while (iterations is None or done < iterations) and (budget is None or clock() - began < budget):
            if iterations is None and budget is None:
                raise ValueError("iterations or a budget is needed")
            ran = oracle(mutator(self.next_iteration()))
            self.step(ran)
            if cleanup:
                cleanup(ran.filter(F.size(compiler_only(crashes(F.col("stderr")))) == 0))
            done += 1
        return done
