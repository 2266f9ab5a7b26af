"""Runs of a file stream, each given once, also after a restart."""

import datetime

import pytest

from strataline.streaming.acquisition import acquired_runs

ROW = "run string, injection string, at timestamp, when string, acquiring boolean, planned long"
STAMP = "16-Oct-26, 17:%02d:08"


def at(minutes):
    return datetime.datetime(2026, 10, 16, 17, 0) + datetime.timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_each_run_once(rocks, tmp_path):
    def batch(k, rows):
        rocks.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rocks.readStream.schema(ROW).parquet(f"{tmp_path}/in")
        q = acquired_runs(stream, "1 hour", "10 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        return {r["run"]: tuple(r)[1:] for r in rocks.read.parquet(f"{tmp_path}/out").collect()}, rocks.read.parquet(f"{tmp_path}/out").count()

    first = [
        ("a", "1", at(0), STAMP % 1, False, 3), ("a", "2", at(1), None, True, 3), (None, "1", at(1), None, False, 1), ("a", None, at(1), None, True, 3),
        ("b", "1", at(2), STAMP % 5, False, 2), ("c", "1", at(3), "no stamp", False, 1), ("d", "1", at(3), STAMP % 4, False, None),
    ]
    got, n = batch(0, first)
    assert got == {"c": ("complete", 1, 1, 0, None)} and n == 1  # a stamp in another form is none
    got, n = batch(1, [("a", "3", at(6), STAMP % 9, False, 3), ("c", "1", at(6), STAMP % 2, False, 1), ("a", "1", at(6), None, True, 3)])
    assert n == 1  # of a the second is still being filled; c was given
    got, n = batch(2, [("a", "2", at(8), STAMP % 6, False, 3)])
    assert got["a"] == ("complete", 3, 0, 0, datetime.datetime(2026, 10, 16, 17, 1, 8)) and n == 2
    batch(3, [("z", "1", at(200), None, True, 2)])
    got, n = batch(4, [("z", "1", at(201), None, True, 2)])
    assert got["b"] == ("abandoned", 1, 0, 1, datetime.datetime(2026, 10, 16, 17, 5, 8))
    assert got["d"] == ("abandoned", 1, 0, 0, datetime.datetime(2026, 10, 16, 17, 4, 8))
    assert n == 4 and "z" not in got
