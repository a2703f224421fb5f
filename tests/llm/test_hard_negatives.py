"""Hard negatives against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mnemograph.llm import hard_negatives as hn
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<double>, label int, row string, q int, span string"


def brute(rows):
    fixed = [(i, la, [int(np.floor(256 * x)) for x in v]) for i, v, la in rows
             if la is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]

    def order(i):
        return (i is None, i or 0)
    out = []
    for n, (i, la, v) in enumerate(fixed):
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, lb) for m, (j, lb, w) in enumerate(fixed)
                  if m != n and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], order(s[1])))
        for ps, pid, _ in [s for s in scored if s[2] == la][:5]:
            window = [s for s in scored if s[2] != la and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(i, pid, r, s[1], ps, s[0]) for r, s in enumerate(window, 1)]
    return sorted(out, key=str)


def run(spark, rows):
    table = spark.createDataFrame([(i, v, la, "r", 1, "s") for i, v, la in rows], VECTORS)
    got = hn.mined(hn.fixed_rows(table, F.col("label")), F.col("id") % 50 == 0)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_mined_equals_brute_force(spark, monkeypatch, small):
    if small:       # many parts, spans and tiles
        monkeypatch.setattr(hn, "PART_ROWS", 3)
        monkeypatch.setattr(hn, "SPAN_LEAST", 100)
        monkeypatch.setattr(hn, "TILE", (2, 16))
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.7) for x in centres[rng.randrange(5)]], i % 4) for i in range(500)]
    rows += [(600 + i, [0.5] * 8, i % 2) for i in range(60)]               # ties and one hot vector
    rows += [(50, [0.4] * 8, 1), (50, [0.4] * 8, 1), (50, [-0.4] * 8, 2)]  # repeated ids and rows
    rows += [(None, [0.5] * 8, 1), (None, [0.3] * 8, 0), (700, None, 1), (750, [0.1] * 8, None),
             (800, [float("nan")] + [0.1] * 7, 1), (850, [None] * 8, 1), (900, [float("inf")] * 8, 0),
             (950, [1.0, 2.0], 0), (951, [1.0, 2.5], 0), (952, [0.5, 1.5], 3),   # another length
             (1000, [0.0] * 8, 0), (1001, [0.0] * 8, 0), (1002, [0.0] * 8, 5),   # no direction
             (1050, [9.0] * 8, 77), (1100, [], 1), (1101, [], 1), (1102, [], 2)]
    want = brute(rows)
    assert len(want) > 100
    assert run(spark, rows) == want


def test_empty_table_and_large_vectors(spark):
    assert run(spark, []) == []
    big = [(0, [1.2e6, 1.0], 1), (1, [1.1e6, 2.0], 1), (2, [9e5, 3.0], 2), (3, [8e5, 4.0], 0)]
    assert run(spark, big) == brute(big) != []
    with pytest.raises(Exception, match="too large for exact scores"):
        run(spark, [(0, [1e300, 1.0], 1), (1, [1.0, 1.0], 1)])


def test_bounds_hold_and_exclude_pairs_of_clusters():
    """Every exact score lies in its interval; of clustered rows few pairs stay open."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 32))
    label = rng.integers(0, 10, 1000)
    q = np.floor(256 * (centres[label] + 0.05 * rng.normal(size=(1000, 32)))).astype(int)
    axes = np.linalg.qr(np.stack([q[label == i].mean(0) for i in range(10)]).T)[0]
    norm = np.sqrt((q * q).sum(1))
    cos = np.clip(q / norm[:, None] @ axes, -1, 1)
    side = hn.Side(pa.table({
        "row": np.arange(1000), "id": np.arange(1000), "label": label, "norm": norm,
        "q": list(q), "angles": list(np.arccos(cos)),
        "apart": np.arccos(np.sqrt(np.minimum((cos * cos).sum(1), 1)))}).combine_chunks().to_batches()[0])
    low, high = side.bounds(side, slice(0, 100), slice(0, 1000))
    exact = q[:100] @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    top = exact.max(1)[:, None]
    assert ((high >= 0.5 * top) & (low <= 0.95 * top)).mean() < 0.3
