"""Joins and numbering must not depend on which way is taken."""

import pytest
from pyspark.sql import functions as F

from topicloom import session
from topicloom.scale import (
    bounded_arrow,
    bounded_rows,
    dense_index,
    explode_once,
    filter_once,
    fits_broadcast,
    frequent_join,
    lookup_join,
    salted_join,
    written_lookup,
)


def test_bounded_rows(spark):
    df = spark.range(5)
    assert len(bounded_rows(df, 5)) == 5
    assert bounded_rows(df, 4) is None
    assert bounded_arrow(df, 5).num_rows == 5
    assert bounded_arrow(df, 4) is None


def test_lookup_join_same_rows_salted_or_broadcast(spark):
    # One key holds a third of all rows, some keys have no partner or two.
    facts = spark.range(3000, numPartitions=7).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")
    )
    lookup = spark.createDataFrame([(k, k * 10) for k in range(40)] + [(1, -1)], "k long, v long")
    for how in ("inner", "left"):
        small = lookup_join(facts, lookup, "k", how)
        large = lookup_join(facts, lookup, "k", how, max_broadcast_rows=3, salts=4)
        assert "_salt" not in large.columns
        assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_join_moves_only_rare_keys(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(
        F.col("id") % 40).alias("k"))
    lookup = written_lookup(facts.where("k <> 5").groupBy("k").agg(
        F.count("*").alias("n"), F.max("id").alias("v")))
    plain = sorted(facts.join(lookup, "k").collect())
    for bounds in ((1_000_000, 1 << 30), (30, 1 << 30), (1, 1 << 30), (0, 1 << 30), (1000, 100)):
        joined = frequent_join(facts, lookup, "k", "n", *bounds)
        assert sorted(joined.select("k", "id", "n", "v").collect()) == plain
    plan = frequent_join(facts, lookup, "k", "n", 1)._jdf.queryExecution().optimizedPlan().toString()
    # The key of 900 rows is sent; the anti join keeps it from moving.
    assert "LeftAnti" in plan and "_salt" not in plan
    assert frequent_join(facts, lookup.where("n < 0"), "k", "n").count() == 0


def test_salted_join_splits_one_partition_and_refuses_outer_kinds(spark):
    facts = spark.range(1000, numPartitions=1).select("id", F.lit(1).alias("k"))
    lookup = spark.createDataFrame([(1, "x")], "k int, v string")
    joined = salted_join(facts, lookup, "k", salts=8)
    assert joined.count() == 1000
    salts = facts.withColumn("s", F.pmod(F.xxhash64(F.spark_partition_id(), "id", "k"), F.lit(8)))
    assert salts.select("s").distinct().count() == 8
    for how in ("right", "full", "outer", "right_outer"):
        with pytest.raises(ValueError):
            salted_join(facts, lookup, "k", how)


def test_known_rows_do_not_skip_the_byte_check(spark):
    facts = spark.range(10).withColumnRenamed("id", "k")
    wide = spark.range(3).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("v"))
    assert not fits_broadcast(wide, max_bytes=100)
    assert lookup_join(facts, wide, "k", known_rows=3).count() == 3


def test_dense_index_distributed_equals_window(spark):
    df = spark.range(1000, numPartitions=9).select((F.col("id") * 7919 % 1000).alias("n"))
    order = [F.desc(F.col("n") % 10), F.asc("n")]
    window = dense_index(df, order, "i", start=1, known_rows=1000)
    ranged = dense_index(df, order, "i", start=1)
    assert sorted(window.collect()) == sorted(ranged.collect())
    assert sorted(r.i for r in ranged.collect()) == list(range(1, 1001))
    assert dense_index(df.where("n < 0"), ["n"]).collect() == []


def test_scratch_goes_when_asked(spark, monkeypatch):
    monkeypatch.setattr(session, "_given", {})
    kept = written_lookup(spark.range(5))
    assert kept.count() == 5
    assert session.clear_scratch(spark) == 1
    assert session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(kept.inputFiles()[0])


def test_explode_once_and_filter_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "id int, t string")
    words = F.filter(F.split("t", " "), lambda w: w != "")
    assert explode_once(df, words, "w").select("id", "w").collect() == [(1, "a"), (1, "b"), (3, "c")]
    placed = explode_once(df, words, "w", "p").select("id", "p", "w").collect()
    assert placed == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    kept = filter_once(df.withColumn("n", F.length("t")), F.col("n") > 0)
    assert kept.columns == ["id", "t", "n"]
    assert [r.id for r in kept.collect()] == [1, 3]
