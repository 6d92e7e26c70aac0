"""Routed runs that are killed between two writes, and late rows of a windowed stream."""

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import ledger
from lodestar.streaming.incremental import windowed_counts

SCHEMA = "k long, v string"
ROUTES = ["kept", "removed"]


def decide(rows):
    return rows.withColumn("decision", F.when(F.col("v") == "bad", "removed").otherwise("kept"))


def source(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def tables(spark, out):
    return {n: sorted(tuple(r)[:2] for r in ledger.committed(spark, out, n, f"{SCHEMA}, decision string").select("k", "v").collect()) for n in ROUTES}


FILES = [[(1, "a"), (2, "bad"), (2, "bad")], [(2, "bad"), (3, "c")], [(4, "bad"), (1, "a")]]
WANT = {"kept": [(1, "a"), (3, "c")], "removed": [(2, "bad"), (4, "bad")]}


def test_a_run_that_ends(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    source(spark, path, FILES)
    ledger.run_routed(spark, path, spark.createDataFrame([], SCHEMA).schema, out, ["k"], decide, ROUTES)
    assert tables(spark, out) == WANT
    source(spark, path, [[(5, "e"), (4, "bad")]])
    ledger.run_routed(spark, path, spark.createDataFrame([], SCHEMA).schema, out, ["k"], decide, ROUTES)
    assert tables(spark, out) == WANT | {"kept": [*WANT["kept"], (5, "e")]}
    lines = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/ledger").collect()
    assert len(lines) == 4 and sum(r.processed for r in lines) == 5 and sum(r.rows for r in lines) == 9


@pytest.mark.parametrize("at", [0, 1, 2, 3, 4])
def test_a_killed_run_resumes(spark, tmp_path, monkeypatch, at):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    source(spark, path, FILES)
    schema = spark.createDataFrame([], SCHEMA).schema
    plain, calls = ledger._part, []

    def dies(out, name, batch):
        # In the second batch the run dies before its write number `at`.
        if batch == 1:
            calls.append(name)
            if len(calls) == at + 1:
                raise RuntimeError("killed")
        return plain(out, name, batch)

    monkeypatch.setattr(ledger, "_part", dies)
    with pytest.raises(Exception, match="killed"):
        ledger.run_routed(spark, path, schema, out, ["k"], decide, ROUTES)
    seen = tables(spark, out)
    assert all(set(seen[n]) <= set(WANT[n]) for n in ROUTES) and sum(map(len, seen.values())) < 4
    monkeypatch.setattr(ledger, "_part", plain)
    ledger.run_routed(spark, path, schema, out, ["k"], decide, ROUTES)
    assert tables(spark, out) == WANT


def test_windows_of_a_stream_with_late_rows(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "ts timestamp, event_type string, value double"
    batches = [[("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 03:00:00", "a", 2.0)], [("2024-01-01 00:50:00", "a", 4.0), ("2024-01-01 02:30:00", "a", 8.0), ("2024-01-01 06:00:00", "a", 16.0)], [("2024-01-01 09:00:00", "a", 32.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
        stream = windowed_counts(spark.readStream.schema(kind).parquet(path), "ts", "1 hour", ["event_type"], "1 hour")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert k < 3
    got = {str(r.start)[11:16]: (r.n, r.total) for r in spark.read.parquet(out).collect()}
    # The row of 00:50 came when its window was closed; the one of 02:30 in time; windows still open are not written.
    assert got["00:00"] == (1, 1.0) and got["02:00"] == (1, 8.0) and got["03:00"] == (1, 2.0)
