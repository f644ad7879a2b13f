import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from fraglight.sources.tables import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over a data folder, and gives both results as sorted rows by column name."""
    import glob
    import os

    import duckdb

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v

    def run(query, sql, folder="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        df = query(spark, folder)
        cols = sorted(df.columns)
        ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        place = [rel.columns.index(c) for c in cols]
        theirs = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
        return ours, theirs

    return run
