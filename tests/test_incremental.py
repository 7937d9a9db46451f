"""Fingerprints of an incremental scan against those of the whole report, a restart in between."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import findings as O
from codequarry.streaming import incremental

DDL = "scan_id long, ordinal long, type string, location string, line int, note string"


@pytest.fixture
def state(spark):
    before = spark.conf.get(incremental.STATE_STORE)
    incremental.state_store(spark)
    yield
    spark.conf.set(incremental.STATE_STORE, before)


def report(n: int, seed: int):
    """Findings in report order; half of them share one key, some have no line, ids are beyond the precision of doubles."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.5
        line = None if rng.random() < 0.1 else 7 if hot else rng.randrange(5)
        rows.append((2**60 + rng.randrange(2) if rng.random() < 0.9 else None, i, "xss" if hot else rng.choice(["xss", "idor"]), "app/F.php" if hot else f"./app/F{rng.randrange(3)}.php", line, rng.choice(["a", None])))
    return rows


def stream_once(spark, folder, checkpoint, out):
    source = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)
    query = incremental.to_parquet(incremental.fingerprints(source, ("scan_id",)), out, checkpoint)
    query.awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_whole_report(spark, state, tmp_path, seed):
    rows = report(120, seed)
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    cuts = [0, 1, 50, 51, 90, 120]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        some = rows[a:b]
        random.Random(part).shuffle(some)
        spark.createDataFrame(some, DDL).coalesce(1).write.mode("append").parquet(folder)
        if part in (1, 2):  # the query ends here and is started again from its checkpoint
            stream_once(spark, folder, checkpoint, out)
    stream_once(spark, folder, checkpoint, out)
    columns = ["scan_id", "ordinal", "type", "location", "line", "note", "occurrence", "fingerprint"]
    want = O.fingerprint(spark.createDataFrame(rows, DDL), ("scan_id",)).select(*columns)
    got = spark.read.parquet(out).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.withColumn("occurrence", F.col("occurrence").cast("long")).collect()))


def test_an_empty_stream(spark, state, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "in"))
    stream_once(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    assert spark.read.schema("fingerprint string").parquet(str(tmp_path / "out")).count() == 0
