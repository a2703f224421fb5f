"""Exact top-k search and preference formatting against brute force."""

import random

import numpy as np

from mnemograph.llm import impact_search, preference

VECTORS = "vec_id bigint, embedding array<double>, q int, block string"


def brute(rows, queries, k):
    fixed = {}
    clean = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for n, (i, v) in enumerate(clean):
        if i in queries:
            scored = sorted((-int(v @ w), j) for m, (j, w) in enumerate(clean)
                            if m != n and len(w) == len(v))
            fixed.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return {i: sorted(x for found in v for x in enumerate(found, 1)) for i, v in fixed.items()}


def run(spark, rows, queries, k):
    table = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], VECTORS)
    vectors = impact_search.numbered(impact_search.quantised(table))
    index = impact_search.build_index(vectors)
    found = {}
    for r in impact_search.search(index, vectors.where(vectors.id.isin(list(queries))), k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], (r.vec_id, r.score)))
    return {q: sorted(v) for q, v in found.items()}


def test_search_with_ties_nulls_and_odd_values(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]                  # ties
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8),
             (2003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2004, [1.0, 2.0])]
    rows += [(2005, [1e300] * 8), (2006, [-1e300] * 8)]
    rows += [(0, [2.0] * 8), (0, [2.0] * 8), (7, [3.0] + [0.0] * 7)]     # ids of other rows
    queries = {0, 7, 1000, 2000, 2004}
    want = brute([r for r in rows if r[0] not in (2005, 2006)], queries, 10)
    got = run(spark, [r for r in rows if r[0] not in (2005, 2006)], queries, 10)
    assert {q: v for q, v in got.items() if v} == {q: v for q, v in want.items() if v}
    assert len(run(spark, rows, {2005}, 5)[2005]) == 5                   # huge values do not break


def test_clustered_blocks_stop_early_and_stay_exact():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    exact = np.floor(1024 * (base[rng.integers(0, 20, 1500)] + 0.05 * rng.normal(size=(1500, 16)))
                     ).astype(np.int64)
    import pandas as pd
    rows = impact_search.index_block((16, 0), pd.DataFrame(
        {"id": range(1500), "row": range(1500), "q": [x.tolist() for x in exact]}))
    block = impact_search.Block(rows)
    pruned = 0
    for q in range(0, 1500, 100):
        ids, scores = block.search(exact[q], q, 10)
        all_scores = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(1500), -all_scores)) if i != q][:10]
        assert ids.tolist() == order and scores.tolist() == all_scores[order].tolist()
        may = block.possible(exact[q], block.ids != q, 10)
        assert may[order].all()
        pruned += may.sum() < 750
    assert pruned == 15


def test_empty_vectors_table(spark):
    assert run(spark, [], set(), 3) == {}


TURNS = "pair_id bigint, side string, position int, role string, text string, part int, block string"


def test_preferences(spark):
    def rows(pair, side, *turns):
        return [(pair, side, p, r, t, 0, "x") for p, (r, t) in enumerate(turns)]
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    long = [("user", f"t{i}") for i in range(700)]
    data = (rows(1, "chosen", u, a) + rows(1, "rejected", u, b)
            + rows(2, "chosen", u, a) + rows(2, "rejected", u, a)           # equal
            + rows(3, "chosen", u, a, u) + rows(3, "rejected", u)           # one ends
            + rows(4, "chosen", u)                                          # one side
            + rows(5, "chosen", *long, a) + rows(5, "rejected", *long, b)   # many turns
            + rows(6, "chosen", (None, None), a) + rows(6, "rejected", ("", ""), b)
            + rows(1, "chosen", u, a)                                       # repeated rows
            + [(None, "chosen", 0, "user", "x", 0, "x"), (7, None, 0, "user", "x", 0, "x"),
               (7, "chosen", None, "user", "x", 0, "x")])
    parts = preference.format_preferences(spark.createDataFrame(data, TURNS))
    got = {r.pair_id: r for r in preference.assembled(parts).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}

    def say(*turns):
        return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (say(u), say(a), say(b))
    assert got[1].chosen[got[1].chosen_trained[0]["first"]:got[1].chosen_trained[0]["end"]] \
        == "yes<|end|>\n"
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == (say(u, a), "", "")
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == (say(u), say(a, u), "")
    assert len(got[3].chosen_trained) == 1
    assert (got[4].prompt, got[4].chosen) == ("", say(u))
    assert got[5].prompt == say(*long) and got[5].rejected == say(b)
    assert got[6].prompt == say(("", "")) and got[6].rejected == say(b)
    empty = spark.createDataFrame([], TURNS)
    assert preference.format_preferences(empty).count() == 0


def test_stale_reply_pairs_differ_in_the_last_reply(spark):
    c = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"),
                               (1, 3, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "z")],
                              "conv_id bigint, turn bigint, role string, text string")
    rejected = {(r.pair_id, r.position): r.text for r in preference.stale_reply_pairs(c).collect()
                if r.side == "rejected"}
    assert rejected == {(1, 0): "q", (1, 1): "a", (1, 2): "r", (1, 3): "a", (2, 0): "q"}
