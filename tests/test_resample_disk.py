"""What the bootstrap leaves on disk: draws as bits, shuffles that end with their table, tables that end with what is made of them."""

import time

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import resample, tables

SAMPLES = 200


def test_counts_as_bits():
    rng = np.random.default_rng(2)
    for counts in (rng.poisson(1.0, (300, SAMPLES)), np.array([[0, 0, 0]]), np.array([[700, 0, 1], [0, 0, 5]]), np.array([[7], [0], [8]])):
        rows = resample.packed(counts)
        assert (resample.counts_of(rows, counts.shape[1]) == counts).all()
        assert [len(r) for r in rows] == [-(-(int(c.sum()) + len(c)) // 8) for c in counts]
    assert resample.counts_of(resample.packed(np.zeros((0, 3), int)), 3).shape == (0, 3)


def test_draws_move_as_two_bits_a_resample(spark):
    pages = spark.range(3000).withColumnRenamed("id", "page_id")
    moved = {r.page_id: r.draws for r in resample.packed_draws(pages, SAMPLES).collect()}
    plain = {r.page_id: r.draws for r in resample.draws(pages, SAMPLES).collect()}
    assert sum(map(len, moved.values())) < 0.27 * sum(map(len, plain.values()))
    assert all(resample.counts_of([moved[k]], SAMPLES).astype(np.uint8).tobytes() == v for k, v in plain.items())


def test_sums_of_bits_and_of_features_made_late(spark):
    rng = np.random.default_rng(4)
    counts = rng.poisson(1.0, (400, SAMPLES))
    rows = [(int(k) % 17, f"p{k % 5}", int(k) % 90, float(k % 3), float(k % 7)) for k in range(400)]
    schema = "k long, part string, year int, a double, b double, draws binary"
    as_bits = spark.createDataFrame([(*r, d) for r, d in zip(rows, resample.packed(counts), strict=True)], schema)
    as_bytes = spark.createDataFrame([(*r, d.astype(np.uint8).tobytes()) for r, d in zip(rows, counts, strict=True)], schema)
    late = resample.summed(as_bits, "k", "part", "year", {"x": "a * b", "one": "1"}, SAMPLES, bits=True)
    early = resample.summed(as_bytes.withColumns({"x": F.col("a") * F.col("b"), "one": F.lit(1.0)}), "k", "part", "year", ["x", "one"], SAMPLES)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))


def _shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}


def test_a_shared_table_leaves_no_shuffle_files(spark):
    was = spark.conf.get(tables._CLEANUP)
    before = _shuffles(spark)
    rows = spark.range(5000).repartition(4, "id")
    table = tables.shared_table(rows, "dealt")
    for _ in range(50):
        left = _shuffles(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(tables._CLEANUP) == was
    assert table.count() == rows.count() == 5000


def test_tables_shared_for_a_kept_one_go_with_its_making(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)
    inner = []

    def make():
        own = tables.kept_table(spark, "inner", [source], 1, lambda: tables.shared_table(spark.range(7), "passing"))
        shared = tables.shared_table(own, "passing")
        inner.append((own, shared.inputFiles()[0]))
        return shared

    outside = tables.shared_table(spark.range(2), "outside")
    kept = tables.kept_table(spark, "outer", [source], 1, make)
    store, at = tables._store(spark, inner[0][1])
    assert kept.count() == inner[0][0].count() == 7 and outside.count() == 2 and not store.exists(at)
