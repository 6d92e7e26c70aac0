"""A folder a page: written and read by tasks, whatever the slugs, with nothing a page in the driver."""

from lodestar.sources import files

SCHEMA = "n long, links array<string>, props map<string,string>"
SLUGS = ["plain", "a/b c", "50%=half", "[x]^{y}", "Köln\n", "it's \"so\"?", "", None, "plain", "a\\b:*#"]


def pages(spark):
    rows = [(s, k, None if k == 2 else [f"l{k}", "line\nbreak"], {"lang": "de"} if k % 2 else None) for k, s in enumerate(SLUGS)]
    return spark.createDataFrame(rows, f"slug string, {SCHEMA}")


def key(rows):
    return sorted((r.slug or "", r.n, str(r.links), str(r.props)) for r in rows)


def test_pages_come_back_whatever_their_slugs(spark, tmp_path):
    path, df = f"file://{tmp_path}/pages", pages(spark)
    files.write_pages(df, path, "slug")
    back = files.read_pages(spark, path, SCHEMA, "slug")
    assert back.columns == ["n", "links", "props", "slug"]
    assert key(back.collect()) == key(df.collect())
    # Spark reads the folders as the partitions that its own writer makes.
    spark_own = spark.read.schema(f"{SCHEMA}, slug string").json(path)
    assert key(spark_own.collect()) == key(df.collect())
    df.write.partitionBy("slug").json(f"file://{tmp_path}/own")
    names = lambda p: sorted(x.name for x in p.iterdir() if x.is_dir() and not x.name.startswith("_"))
    assert names(tmp_path / "pages") == names(tmp_path / "own")


def test_an_overwritten_folder_keeps_no_old_page(spark, tmp_path):
    path = str(tmp_path / "pages")
    files.write_pages(pages(spark), path, "slug")
    files.write_pages(pages(spark).filter("n < 2"), path, "slug")
    assert sorted(r.n for r in files.read_pages(spark, path, SCHEMA, "slug").collect()) == [0, 1]
    files.write_pages(pages(spark).filter("n < 0"), path, "slug")
    assert files.read_pages(spark, path, SCHEMA, "slug").count() == 0


def test_the_driver_lists_no_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(3000).selectExpr("'page_' || id as slug", "id as n", "array('x') as links", "map('lang', 'en') as props")
    files.write_pages(df, path, "slug")
    back = files.read_pages(spark, path, SCHEMA, "slug")
    assert back.agg({"n": "sum"}).first()[0] == 3000 * 2999 // 2
    assert len(back.inputFiles()) < 100
