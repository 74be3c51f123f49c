"""Rows of many elements take time in proportion to them."""

import time

from pyspark.sql import functions as F

from weftline.operators import collation, tasks


def test_needles_among_very_many_sentences(spark):
    d = spark.range(1).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: i.cast("string")).alias("s"))
    spark.range(1).count()
    start = time.time()
    got = d.select(tasks.inserted(tasks.shuffled(F.col("s"), "essay", F.col("id")), F.array(F.lit("x")), F.array(F.lit(0.5))).alias("t"), tasks.shuffled(F.col("s"), "essay", F.col("id")).alias("s")).first()
    assert time.time() - start < 20
    assert got["t"] == got["s"][:3000] + ["x"] + got["s"][3000:]


def test_common_start_of_long_texts(spark):
    long = "é𝄞" * 100_000
    d = spark.createDataFrame([(long + "a", long + "b"), ("", "x"), ("abc", "abc"), ("ab", "abc"), ("xb", "yb")], "a string, b string")
    start = time.time()
    got = [r[0] for r in d.select(collation.common_start(F.col("a"), F.col("b"))).collect()]
    assert time.time() - start < 20
    assert got == [long, "", "abc", "ab", ""]
