"""Lookups of single rows: what they give, and how many rows they read."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.sources.store import VersionedTable

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "project", "id", "external_key", "body")] + [T.StructField("version", T.LongType())])


def made(spark, path, n):
    t = VersionedTable(spark, path, SCHEMA, ["project", "id"], ("id", "external_key"))
    t.FILE_ROWS = 1000
    t.commit(spark.range(n).select(F.lit("a").alias("project"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("k"), "id").alias("external_key"), F.lit("x").alias("body")))
    t.compact()
    return t


def read_by(df):
    """Rows that scans of a plan gave, and the rows of its result."""
    plan = df._jdf.queryExecution().executedPlan()
    got = plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), len(got)


def test_reads_do_not_grow(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (4000, 16000):
            t = made(spark, str(tmp_path / f"t{n}"), n)
            key = t.latest().where("external_key = 'k77'").first().id
            rows, found = read_by(t.point("id", key, project="a"))
            assert found == 1 and rows <= 2500  # its file, and at most one that a bloom filter wrongly lets through
            rows, found = read_by(t.point("external_key", "k77", project="a"))
            assert found == 1 and rows <= 2500
            assert read_by(t.point("external_key", "nobody", project="a"))[1] == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_later_versions_count(spark, tmp_path):
    t = made(spark, str(tmp_path / "t"), 50)
    key = t.point("external_key", "k7").first().id
    t.commit([{"project": "a", "id": key, "external_key": "moved", "body": "y"}])
    assert t.point("external_key", "k7").collect() == [] and t.point("external_key", "moved").first().body == "y"
    t.commit([{"project": "a", "id": key, "external_key": "moved", "op": "D"}])
    assert t.point("external_key", "moved").collect() == [] and t.point("id", key).collect() == []
    for i in range(14):  # more keys than a list passed to the scan
        t.commit([{"project": "a", "id": f"n{i}", "external_key": "shared", "body": str(i)}])
    t.commit([{"project": "a", "id": "n3", "external_key": "other", "body": "3"}])
    assert {r.id for r in t.point("external_key", "shared", project="a").collect()} == {f"n{i}" for i in range(14) if i != 3}
    assert t.point("external_key", "shared", project="b").collect() == []
    t.compact()
    assert t.point("external_key", "shared").count() == 13 and t.point("id", "n3").first().external_key == "other"
