import random
from itertools import accumulate
from operator import xor

import pytest
from pyspark.sql import functions as F

from threadloom.plans.running import PART, in_ranges, running


@pytest.mark.parametrize("sizes", [[1, 1, 400, 2, 90, 1], [5] * 30, [300], []])
def test_equals_one_pass(spark, sizes):
    rng = random.Random(4)
    rows = [(g - 2, k, rng.randrange(-(2**62), 2**62)) for g, n in enumerate(sizes) for k in range(n)]
    want = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        for (_, k, _), n, x in zip(mine, accumulate(1 for _ in mine), accumulate((r[2] for r in mine), xor)):
            want[g, k] = (n, x)
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranged = in_ranges(spark.createDataFrame(rows, "g long, k int, v long"), "g", "k")
    got = running(ranged, "g", ["k"], n=("sum", F.lit(1).cast("long")), x=("bit_xor", F.col("v"))).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.g, r.k): (r.n, r.x) for r in got} == want and len(got) == len(rows)
    assert not sizes or 400 not in sizes or len({r[PART] for r in got if r.g == 0}) > 1
