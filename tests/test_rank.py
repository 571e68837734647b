from pyspark.sql import Window
from pyspark.sql import functions as F

from churnspark.operators.rank import hash_key, hashed_rank, ranged_sums, running_sums


def test_hashed_rank_equals_plain_window(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    got = hashed_rank(df, "k", 42, ["g"], out="r", prefix_hex=2)
    w = Window.partitionBy("g").orderBy(hash_key(F.col("k"), 42), "k")
    want = df.withColumn("r", F.row_number().over(w).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


def test_running_sums_equal_plain_cumsum(spark):
    df = spark.range(500).select((F.col("id") * 7 % 101).cast("double").alias("s"),
                                 (F.col("id") % 2).alias("g"), F.lit(1).alias("c"))
    lv = df.groupBy("g", "s").agg(F.sum("c").alias("c"))
    got = running_sums(lv, "s", ["c"], ["g"], descending=True, n_buckets=7)
    w = Window.partitionBy("g").orderBy(F.col("s").desc())
    want = lv.withColumn("c_cum", F.sum("c").over(w))
    a = {(r.g, r.s): r.c_cum for r in got.collect()}
    b = {(r.g, r.s): r.c_cum for r in want.collect()}
    assert a == b


def test_ranged_sums_equal_plain_cumsum_in_one_scan(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    src = spark.range(500).select(F.when(F.col("id") % 50 > 0, (F.col("id") * 7 % 101).cast("double")).alias("s"),
                                  F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"), F.lit(1).alias("c"))
    lv = src.mapInArrow(count, src.schema).groupBy("g", "s").agg(F.sum("c").alias("c"))
    for down in (True, False):
        read.value = 0
        got = ranged_sums(lv, "s", ["c"], ["g"], descending=down, n_buckets=7)
        a = {(r.g, r.s): (r.c_cum, r.c_all) for r in got.collect()}
        assert read.value == 500
        order = F.col("s").desc() if down else F.col("s").asc()
        want = src.groupBy("g", "s").agg(F.sum("c").alias("c")) \
            .withColumn("c_cum", F.sum("c").over(Window.partitionBy("g").orderBy(order))) \
            .withColumn("c_all", F.sum("c").over(Window.partitionBy("g")))
        assert a == {(r.g, r.s): (r.c_cum, r.c_all) for r in want.collect()}
    assert ranged_sums(lv.filter("c < 0"), "s", ["c"], ["g"]).count() == 0
