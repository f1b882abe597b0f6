"""Building blocks on keys that hold most of the rows, against brute force."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from incident_analytics.operators.scale import (exact_percentiles, heavy_keys, salted_join,
                                                sequence_numbers)


def nearest_rank(values, pct):
    ordered = sorted(values)
    if pct <= 0:
        return ordered[0]
    return ordered[min(len(ordered), max(1, math.ceil(round(pct * len(ordered), 6) / 100))) - 1]


def test_percentile_goldens(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    row = exact_percentiles(df, [], "v", {"p50": 50, "p95": 95, "p100": 100, "p0": 0}).first()
    assert (row.p50, row.p95, row.p100, row.p0) == (50, 95, 100, 1)
    one = spark.createDataFrame([(10.0,)], "v double")
    assert exact_percentiles(one, [], "v", {"p95": 95}).first().p95 == 10
    assert exact_percentiles(one.where("v < 0"), [], "v", {"p95": 95}).count() == 0


def test_percentiles_equal_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot", rng.choice([rng.lognormvariate(3, 2), -rng.random() * 5, 42.0])) for _ in range(5000)]
    rows += [(f"k{i % 40}", round(rng.random() * 1000, 3)) for i in range(2000)]
    probs = {"p1": 1, "p50": 50, "p95": 95, "p99": 99.9}
    got = {r.k: r for r in exact_percentiles(
        spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", probs, 16).collect()}
    for key in {k for k, _ in rows}:
        mine = [v for k, v in rows if k == key]
        for name, pct in probs.items():
            assert got[key][name] == nearest_rank(mine, pct), (key, name)


def test_sequence_numbers_are_dense_for_any_gaps(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-5000, 10**12), 3000) + list(range(10**13, 10**13 + 2000))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(9)
    got = [r.seq for r in sequence_numbers(df, "id").orderBy("id").collect()]
    assert got == list(range(1, len(ids) + 1))


def test_sequence_numbers_per_key(spark):
    rows = [("hot" if i % 3 else f"c{i % 5}", i * 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, id bigint").repartition(5)
    got = {(r.k, r.id): r.seq for r in sequence_numbers(df, "id", ["k"]).collect()}
    seen: dict[str, int] = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        assert got[k, i] == seen[k]


def test_salted_join_equals_plain_join(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 50)).alias("token"))
    right = left.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(right, "token", "n", share=20)
    assert [r.token for r in heavy.collect()] == ["hot"]
    joined = salted_join(left, right, "token", heavy, F.col("id"))
    assert joined.exceptAll(left.join(right, "token").select(*joined.columns)).count() == 0
    assert joined.count() == 6000


def test_worker_functions_travel_by_value(tmp_path):
    """Executors need no copy of the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from incident_analytics.operators.cache_ttl import _follow_key

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(_follow_key(5)))
    code = ("import pickle, pandas as pd; f = pickle.load(open('f.pkl', 'rb'));"
            "print(list(f(pd.DataFrame({'__key': ['k'] * 3, '__us': [0, 5, 6]}))['__us']))")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "[0, 6]"


def test_sequence_numbers_keep_nulls(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), (None, 1), (None, 9), ("a", 2)], "k string, id bigint")
    got = {(r.k, r.id): r.seq for r in sequence_numbers(df, "id", ["k"]).collect()}
    assert got == {("a", None): 1, ("a", 2): 2, ("a", 5): 3, (None, 1): 1, (None, 9): 2}


def test_numbering_blocks_stay_balanced_beside_outliers(spark):
    """Two far values, one key with a third of all rows, NULL values: numbers dense and in order, blocks small."""
    from incident_analytics.operators.scale import _with_block
    near = spark.range(60_000).select((F.col("id") * 3 + 1_700_000_000).alias("v"),
                                      F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    far = spark.createDataFrame([(-9_000_000_000_000_000_000, "hot"), (9_000_000_000_000_000_000, "hot"), (None, "hot")],
                                "v bigint, k string")
    rows = near.unionByName(far)
    blocks = _with_block(rows, "v").groupBy("__block").count()
    assert blocks.agg(F.max("count")).first()[0] < 2_000 and blocks.count() > 200
    got = sequence_numbers(rows, "v", ["k"])
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    same = got.join(want, F.col("want").eqNullSafe(F.col("seq")) & got.k.eqNullSafe(want.k) & got.v.eqNullSafe(want.v))
    assert got.count() == same.count() == 60_003
