"""Fixed-size resamples and kept tables against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import resample, tables

SAMPLES = 37


@pytest.fixture(scope="module")
def drawn(spark):
    pages = spark.range(0, 7000, 2).select((F.col("id") * 3).alias("page_id"))
    return {r.page_id: np.frombuffer(r.draws, np.uint8) for r in resample.draws(pages, SAMPLES).collect()}


def test_each_resample_draws_as_many_pages_as_there_are(drawn):
    total = sum(v.astype(int) for v in drawn.values())
    assert len(drawn) == 3500 and total.tolist() == [3500] * SAMPLES


def test_draws_are_even_and_differ(drawn):
    m = np.array([drawn[k] for k in sorted(drawn)]).astype(float)
    # Counts of draws with replacement: mean 1, variance near 1, resamples nearly uncorrelated.
    assert abs(m.var() - 1) < 0.05 and abs(np.corrcoef(m.T) - np.eye(SAMPLES)).max() < 0.1
    by_page = m.sum(1)
    assert abs(by_page.var() / SAMPLES - 1) < 0.15


def test_draws_equal_their_sql(drawn):
    import duckdb

    sql = f"with {resample.draws_sql('select unnest(range(0, 7000, 2)) * 3 as page_id', SAMPLES)} select page_id, i, n from drawn"
    plain = duckdb.sql(sql).fetchall()
    assert all(drawn[p][i - 1] == n for p, i, n in plain) and sum(n for _, _, n in plain) == 3500 * SAMPLES


def test_rests_of_the_prime():
    x = np.array([0, 1, resample.PRIME - 1, resample.PRIME, resample.PRIME + 1, 2 * resample.PRIME, (1 << 62) - 1, resample.PRIME**2, 10**17])
    assert resample._rest_of_prime(x.copy()).tolist() == [int(v) % resample.PRIME for v in x.tolist()]


def test_draws_are_made_by_all_tasks_and_not_sent_whole(spark):
    """Counts of blocks look small to the engine, which would make the draws of all pages in one task and send them to all."""
    pages = spark.range(0, 20000).withColumnRenamed("id", "page_id")
    made = resample.draws(pages, SAMPLES)
    tasks = made.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0]
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = pages.join(made, "page_id")
    assert joined.count() == 20000
    above = joined._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "SortMergeJoin" in above and "Broadcast" not in above


def test_draws_of_few_pages(spark):
    one = resample.draws(spark.range(5, 6).withColumnRenamed("id", "page_id"), 9).collect()
    assert [r.draws for r in one] == [bytes([1] * 9)]
    assert resample.draws(spark.range(0).withColumnRenamed("id", "page_id"), 9).collect() == []


@pytest.mark.parametrize("batch", ["7", "1000"])
def test_sums_equal_plain_loops(spark, batch):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(900):
        key = 1 if rng.random() < 0.5 else int(rng.integers(2, 40))
        part = None if rng.random() < 0.1 else f"p{rng.integers(0, 3 if key == 1 else 12)}"
        year = None if rng.random() < 0.2 else int(rng.integers(-500, 2000))
        rows.append((key, part, year, (rng.integers(0, 2, SAMPLES) * rng.integers(0, 3)).astype(np.uint8).tobytes(), float(rng.integers(0, 9)), 1.0))
    rows += [(99, "x", 7, bytes(SAMPLES), 1.0, 1.0)]  # drawn by no resample
    df = spark.createDataFrame(rows, "k long, part string, year int, draws binary, a double, one double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.i, r.k): (r.a, r.one, r.parts, r.low, r.high) for r in resample.summed(df, "k", "part", "year", ["a", "one"], SAMPLES).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    plain = defaultdict(list)
    for key, part, year, draws, a, one in rows:
        for i, n in enumerate(draws, 1):
            if n:
                plain[i, key].append((part, year, n * a, n * one))
    want = {}
    for at, own in plain.items():
        years = [y for _, y, _, _ in own if y is not None]
        want[at] = (sum(x[2] for x in own), sum(x[3] for x in own), len({p for p, *_ in own if p is not None}), min(years, default=None), max(years, default=None))
    assert got == want


def test_kept_tables(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(source)

    a = tables.kept_table(spark, "kept", [source], 1, make)
    assert tables.kept_table(spark, "kept", [source], 1, make).count() == a.count() == 5 and len(made) == 1
    tables.kept_table(spark, "kept", [source], 2, make)
    assert len(made) == 2
    spark.range(9).write.mode("overwrite").parquet(source)
    assert tables.kept_table(spark, "kept", [source], 1, make).count() == 9 and len(made) == 3


def test_a_run_that_dies_while_writing_is_made_again(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)

    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        tables.kept_table(spark, "died", [source], 1, die)
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.kept_table(spark, "died", [source], 1, lambda: broken)
    assert tables.kept_table(spark, "died", [source], 1, lambda: spark.range(5)).count() == 5


def test_release_deletes_what_was_made(spark, monkeypatch):
    monkeypatch.setattr(tables, "_MADE", {})
    t = tables.shared_table(spark.range(3), "gone")
    (path,) = tables._MADE[spark.sparkContext.applicationId]
    store, at = tables._store(spark, path)
    assert t.count() == 3 and store.exists(at)
    assert tables.release(spark) == 1 and not store.exists(at) and tables.release(spark) == 0


@pytest.fixture(scope="module")
def resamples(spark):
    """Resamples of 60 commanders with many ties, and the models that they belong to."""
    from lodestar.plans.synthesis import PROXIES

    rng = np.random.default_rng(5)
    parts = ("outcome", "outcome_battle", "scale_battle", "known", "scope", "temporal", "centrality", "evidence")
    rows = [(i, c, float(rng.integers(0, 9)), float(rng.integers(0, 3)), float(rng.choice([0.5, 1.0])), *(float(x) / 3 for x in rng.integers(0, 7, len(parts)))) for i in range(1, 6) for c in range(60) if rng.random() < 0.9]
    g = spark.createDataFrame(rows, "i long, commander_id long, m double, mb double, cap double, " + ", ".join(f"r_{p} double" for p in parts))
    member = [(m, c, f"n{c * 7 % 60:02d}", 1) for m in PROXIES for c in range(60) if "eligibility" not in m or c % 4]
    return g, spark.createDataFrame(member, "model string, commander_id long, name string, original_rank int")


def test_ranks_of_a_group_equal_ranks_in_ranges(resamples):
    from lodestar.plans import synthesis

    one, other = ({(r.i, r.model, r.commander_id): (r.score, r["rank"]) for r in f(*resamples).collect()} for f in (synthesis.ranked_together, synthesis.ranked_in_ranges))
    assert len(one) > 1200 and one == other


def test_percentiles_equal_the_engines(spark):
    rows = spark.range(0, 9000).select((F.col("id") % 37).alias("k"), F.concat(F.lit("m"), F.col("id") % 3).alias("model"), (F.hash("id") % 50).alias("rank"), (F.hash("id") % 999 / 7).alias("score")).filter("k <> 5 or score > 140")
    shares = [0.05, 0.1, 0.25, 0.5, 0.9]
    made = resample.percentiles(rows, ["k", "model"], {"rank": shares, "score": shares}, ("rank", 10))
    plain = rows.groupBy("k", "model").agg(F.percentile("rank", F.array(*map(F.lit, shares))).alias("a"), F.percentile("score", F.array(*map(F.lit, shares))).alias("b"), F.count("*").alias("n2"), F.count_if(F.col("rank") <= 10).alias("t2")).collect()
    got = {(r.k, r.model): r for r in made.collect()}
    assert len(got) == len(plain)
    for r in plain:
        own = got[r.k, r.model]
        assert (own.n, own.top) == (r.n2, r.t2) and [own[f"rank_{k}"] for k in range(5)] == r.a and [own[f"score_{k}"] for k in range(5)] == r.b


def test_a_resample_is_counted_in_stretches(spark, drawn, monkeypatch):
    """Draws are counted by block in the task that makes them, and no row a draw is grouped."""
    monkeypatch.setattr(resample, "STRETCH", 1000)
    monkeypatch.setattr(resample, "STEP", 300)
    pages = spark.range(0, 7000, 2).select((F.col("id") * 3).alias("page_id"))
    again = {r.page_id: np.frombuffer(r.draws, np.uint8) for r in resample.draws(pages, SAMPLES).collect()}
    assert all((again[k] == v).all() for k, v in drawn.items())
