"""Joins and numbering, with hot keys and with many small buckets."""

import random

from pyspark.sql import functions as F

from notewright.operators import scaling as S
from notewright.plans.views import Inputs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    fact = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    dim = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(
        spark.createDataFrame([(1, -1)], "k bigint, v bigint")
    )
    for how in ("inner", "left"):
        assert rows(S.salted_join(fact, dim, ["k"], ["id"], how).select("id", "k", "v")) == rows(fact.join(dim, ["k"], how).select("id", "k", "v"))


def test_lookup_join_beyond_the_broadcast_size(spark):
    fact = spark.range(500).select("id", (F.col("id") % 7).alias("k"))
    dim = spark.range(5).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    small, large = S.lookup_join(fact, dim, ["k"], ["id"]), S.lookup_join(fact, dim, ["k"], ["id"], max_rows=2)
    assert rows(small.select("id", "k", "v")) == rows(large.select("id", "k", "v"))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert "_salt" in large._jdf.queryExecution().toString()


def test_running_index_with_gaps_and_groups(spark):
    rnd = random.Random(3)
    data = [(g, p) for g in (2, 1, 5) for p in rnd.sample(range(-50, 1000), 200)]
    df = spark.createDataFrame(data, "g int, p bigint")
    got = rows(S.running_index(df, "p", ["g"], "n", start=10, width=16).select("g", "p", "n"))
    assert got == [(g, p, i + 10) for i, (g, p) in enumerate(sorted(data))]


def test_running_index_of_very_sparse_positions(spark):
    rnd = random.Random(9)
    values = sorted({rnd.randint(-(2**62), 2**62) for _ in range(200)} | set(range(50)))
    df = spark.createDataFrame([(v,) for v in values], "p bigint")
    assert rows(S.running_index(df, "p")) == [(v, i) for i, v in enumerate(values)]
    got = rows(S.neighbours(df, "p", "p").select("p", "prev", "next"))
    assert got == list(zip(values, [None, *values[:-1]], [*values[1:], None]))


def test_neighbours_across_buckets(spark):
    values = sorted(random.Random(4).sample(range(10_000), 300))
    df = spark.createDataFrame([(v,) for v in values], "i bigint")
    got = rows(S.neighbours(df, "i", "i", width=16).select("i", "prev", "next"))
    assert got == list(zip(values, [None, *values[:-1]], [*values[1:], None]))


def test_first_rows_with_a_hot_key_and_null_keys(spark):
    rnd = random.Random(5)
    data = [(o, rnd.choice(["hot", "hot", "a", "b", None, f"k{o % 50}"])) for o in rnd.sample(range(100_000), 5000)]
    df = spark.createDataFrame(data, "o bigint, k string")
    first = {}
    for o, k in sorted(data):
        first.setdefault(k, o)
    got = {(o, k): f for o, k, f in S.is_first(df, "k", "o").select("o", "k", "is_first").collect()}
    assert got == {(o, k): first[k] == o for o, k in data}


def test_spread(spark):
    assert S.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8
    many = spark.range(0, 10, 1, 20)
    assert S.spread(many) is many


def test_salted_join_never_broadcasts_the_repeats(spark):
    """The planner's estimate of the repeated side is that of one copy."""
    fact, dim = spark.range(500).select("id", (F.col("id") % 7).alias("k")), spark.range(5).select(F.col("id").alias("k"))
    for how in ("inner", "left"):
        joined = S.salted_join(fact, dim, ["k"], ["id"], how)
        assert len(joined.collect()) == (500 if how == "left" else 358)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().toString()


def test_dealt_sides_are_not_coalesced(spark):
    left, right = spark.range(1000), spark.range(0, 1000, 2).withColumnRenamed("id", "k")
    a, b = S.dealt(1000, (left, "id"), (right, "k"), per_task=25)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 40
    assert a.join(b, F.col("id") == F.col("k"), "left").count() == 1000


def test_terms_to_score_are_dealt_by_their_rows(spark, tmp_path):
    orders = [(i, "1-URGENT", "O") for i in range(300)] + [(7, "1-URGENT", "O"), (None, None, None)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i % 200, i, "N", 30.0, 0.05) for i in range(1000)] + [(None, 1, "N", 1.0, 0.0)]
    kind = "l_orderkey bigint, l_partkey bigint, l_returnflag string, l_quantity double, l_discount double"
    spark.createDataFrame(lines, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    view = Inputs(spark, str(tmp_path))("v_eval_terms")
    assert view.count() == 1000 + 100 + 5 + 1
    assert view._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
