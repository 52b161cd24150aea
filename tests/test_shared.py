"""Numbers over all rows, from ranges."""

import random

from pyspark.sql import functions as F

from lectern.sources.shared import numbered


def test_numbers_equal_one_sort(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i) for i in range(3000)] + [(None, 5000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = numbered(spark.createDataFrame(rows, "n int, id long").repartition(7), F.desc("n"), F.col("id")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(x.n, x.id) for x in sorted(got, key=lambda x: x.place)] == want and sorted(x.place for x in got) == list(range(1, 3002))
    assert numbered(spark.createDataFrame([], "n int"), F.col("n")).collect() == []
