"""One object is looked up: nothing else is grouped for it."""

from pyspark.sql import functions as F

from heaploom.operators import listing
from heaploom.plans import fixture


def test_only_named_objects_are_made(spark, tmp_path):
    """Objects besides the one and its neighbours raise an error when they are made."""
    wanted = F.col("id").isin(1, 2, 3, 4)
    made = spark.range(1, 1001).withColumn("size", F.when(wanted, F.col("id")).otherwise(F.raise_error(F.lit("was made")).cast("long")))
    objects = made.selectExpr("id", "'t' AS type", "CAST(NULL AS STRING) AS value", "size", "CAST(NULL AS BIGINT) AS subtree_size").distinct()
    refs = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (4, 0, 1), (4, 1, 1), (9, 0, 10)], "src long, pos long, dst long")
    (one,) = listing.object_detail(objects, refs, 1).collect()
    assert [r["id"] for r in one["references"]] == [2, 3] and [r["id"] for r in one["referrers"]] == [4]


def test_more_names_than_few_are_joined(spark, monkeypatch):
    monkeypatch.setattr(listing, "FEW", 1)
    objects = spark.range(1, 6).selectExpr("id", "'t' AS type", "CAST(NULL AS STRING) AS value", "id AS size", "CAST(NULL AS BIGINT) AS subtree_size")
    refs = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (4, 0, 1), (5, 1, 1)], "src long, pos long, dst long")
    (one,) = listing.object_detail(objects, refs, 1).collect()
    assert [r["id"] for r in one["references"]] == [2, 3] and [r["id"] for r in one["referrers"]] == [4, 5]


def test_the_first_line_is_that_of_the_objects(spark):
    objects = fixture.objects(spark, "/root/testdata/sf0.001")
    assert fixture.first_line(spark, "/root/testdata/sf0.001") == objects.where("type = 'app.LineItem'").agg(F.min("id")).first()[0]


def test_the_plain_dump_is_stored_once_and_looked_up_by_source(spark, monkeypatch):
    """One table holds objects and links; a filter on the source of links is answered by the statistics of that table."""
    small, made, given = "/root/testdata/sf0.001", [], fixture.stored
    monkeypatch.setattr(fixture, "_KEPT", {})
    monkeypatch.setattr(fixture, "stored", lambda df, name: made.append(name) or given(df, name))
    dump = fixture.plain(spark, small)
    assert len(made) == 1
    for found, wanted in ((dump.refs, fixture.refs(spark, small)), (dump.objects.drop("subtree_size"), fixture.objects(spark, small))):
        assert found.count() == wanted.count() and found.select(wanted.columns).exceptAll(wanted).isEmpty()
    assert "PushedFilters: [In(id," in dump.refs.where("src IN (7, 9)")._jdf.queryExecution().executedPlan().toString()
