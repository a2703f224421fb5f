import random

from pyspark.sql import functions as F

from mnemograph.operators.ordered import carry_forward, lags, ordinals, running_sums


def sample(n=200, keys=3, seed=1):
    rnd = random.Random(seed)
    # One key holds most of the rows.
    return [(i, "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(keys)}",
             rnd.choice([None, None, "a", "b", "c"]), rnd.randrange(5)) for i in range(1, n + 1)]


def frame(spark, data):
    return spark.createDataFrame(data, "seq bigint, key string, mark string, x bigint").repartition(4)


def test_carry_forward_matches_a_loop(spark):
    data = sample()
    want, last = {}, None
    for seq, _, mark, _ in data:
        last = mark if mark is not None else last
        want[seq] = last
    for block in (7, 64, None):
        got = carry_forward(frame(spark, data), "seq", F.col("mark"), "cur", block=block)
        assert {r.seq: r.cur for r in got.collect()} == want


def test_carry_forward_by_key(spark):
    data = sample()
    want, last = {}, {}
    for seq, key, mark, _ in data:
        last[key] = mark if mark is not None else last.get(key)
        want[seq] = last[key]
    got = carry_forward(frame(spark, data), "seq", F.col("mark"), "cur", ("key",), block=9)
    assert {r.seq: r.cur for r in got.collect()} == want


def test_running_sums_match_a_loop(spark):
    data = sample()
    want, total = {}, {}
    for seq, key, _, x in data:
        total[key] = total.get(key, 0) + x
        want[seq] = total[key]
    got = running_sums(frame(spark, data), "seq", {"s": F.col("x")}, ("key",), block=11)
    assert {r.seq: r.s for r in got.collect()} == want


def test_lags_reach_over_empty_and_short_blocks(spark):
    data = sample()
    want, past = {}, {}
    for seq, key, _, x in data:
        p = past.setdefault(key, [])
        want[seq] = (p[-1] if p else None, p[-2] if len(p) > 1 else None)
        p.append(x)
    for block in (2, 5, 1000):
        got = lags(frame(spark, data), "seq", "x", 2, ("key",), block=block)
        assert {r.seq: (r.lag_1, r.lag_2) for r in got.collect()} == want


def test_ordinals_are_dense_over_splits(spark):
    data = [(s, i + 100 * s) for s in (2, 0, 1) for i in range(5 + s)]
    df = spark.createDataFrame(data, "split int, local bigint")
    got = sorted((r.split, r.local, r.n) for r in ordinals(df, ("split",), "local", "n").collect())
    assert [r[2] for r in got] == list(range(1, len(data) + 1))
