"""Links of lines against brute force, and that no pair of lines becomes a row."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mnemograph.llm import line_dedup, line_links
from tests.llm.test_documents import line_texts


def near_lines(n, words=30):
    """A group in which nearly all lines are similar, and some are not."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        line = list(base)
        for _ in range(rng.randrange(1, 4)):
            line[rng.randrange(words)] = f"x{rng.randrange(4 * n)}"
        out.append(" ".join(line))
    return out


def plain_links(lines):
    """{line number: (first line of its set, first earlier similar line, number of links)}"""
    sets = [frozenset(x.split()) for x in lines]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    kinds = list(first.items())
    links = {s: [j for o, j in kinds if o != s and 10 * len(s & o) >= 8 * len(s | o)] for s, _ in kinds}
    return {i: (first[s], min((j for j in links[s] if j < first[s]), default=None), len(links[s]))
            for i, s in enumerate(sets) if s}


@pytest.mark.parametrize("block", [2048, 100])
def test_links_of_a_large_group_need_no_pair_rows(docs_of, monkeypatch, block):
    staged = []

    def counted(df, name, keep=line_dedup.stage):
        out = keep(df, name)
        staged.append((out.count(), name))
        return out
    for module in (line_dedup, line_links):
        monkeypatch.setattr(module, "stage", counted)
    monkeypatch.setattr(line_links, "BLOCK", block)
    lines = near_lines(260) + ["alone in the world", "alone in the world", ""]
    rows = line_dedup.matched_lines(docs_of(lines), links=True).collect()
    assert {r.doc: (r.class_doc, r.to_doc, r.n_links) for r in rows} == plain_links(lines)
    assert sum(r.n_links for r in rows) > 20_000
    assert staged and max(staged)[0] < 10 * len(lines), staged


@pytest.mark.parametrize("hot,long,few,short,common", [
    (200_000, 1000, 16, 32, 16), (40, 1000, 1, 0, 2), (40, 12, 2, 0, 500), (200_000, 12, 16, 3, 16)])
def test_similar_sets_meet_and_count_once(monkeypatch, hot, long, few, short, common):
    for name, x in (("HOT_WORD", hot), ("LONG", long), ("FEW", few), ("SHORT", short), ("COMMON", common)):
        monkeypatch.setattr(line_links, name, x)
    lines = [x for t in line_texts() for x in t.split("\n")] + near_lines(40) + near_lines(9, 120)
    lines = list({frozenset(x.split()): x for x in lines}.values())
    counts = np.zeros(line_dedup.CELLS, np.int64)
    sets = line_dedup.LineSets(pa.array(lines), counts, whole=False)
    np.add.at(counts, line_dedup.cells_of(sets.hash[sets.word]), 1)
    sets = line_dedup.LineSets(pa.array(lines), counts, whole=False)
    key, of, n, hashes = line_links.postings(sets, sets.full)
    h, at = sets.hash[sets.word].view(np.uint64), sets.start[sets.full]
    place = line_dedup.mixed(h, 3)
    bit, low = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(63) == 0
    high = np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), at)
    bits = np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), at)
    size = sets.size[sets.full]
    bits = np.where(size >= line_links.WIDE, bits, bits ^ high)
    blocks = list(line_links.flushed([(key, of, bits[of], size[of], n, high[of], hashes)], 3))
    name, member = [], []
    for b in blocks:
        posted, hs = line_links.unpacked(b.column("postings")[0].as_py())
        g, k, ids = line_links.lists_of(posted, hs)
        owner, _ = line_links.ragged(k)
        name.extend(g[owner].tolist())
        member.extend(ids.tolist())
    # What Spark does in between: each list once, with the lists of less name beside a set.
    on = sorted(set(zip(name, member)))
    lists = {}
    for g, i in on:
        lists.setdefault(i, []).append(g)
    words = [sets.hash[sets.word[sets.start[i]:sets.start[i] + sets.size[i]]] for i in sets.full]
    where = sets.full
    batch = pa.RecordBatch.from_pydict({
        "g": pa.array([g for g, _ in on]), "bi": pa.array([0] * len(on), pa.int32()),
        "bj": pa.array([0] * len(on), pa.int32()), "b": pa.array([0] * len(on), pa.int32()),
        "doc": pa.array([int(where[i]) for _, i in on]), "line": pa.array([0] * len(on), pa.int32()),
        "t1": pa.array([0] * len(on)), "t2": pa.array([0] * len(on)),
        "s1": pa.array([int(where[i]) for _, i in on]), "s2": pa.array([0] * len(on)),
        "words": pa.array([words[i].tobytes() for _, i in on], pa.binary()),
        "lower": pa.array([[x for x in lists[i] if x < g] for g, i in on], pa.list_(pa.int64()))})
    found = {}
    for r in line_links.counted(batch).to_pylist():
        first, links = found.get(r["s1"], (None, 0))
        to = [x for x in (first, r["to_doc"]) if x is not None]
        found[r["s1"]] = (min(to, default=None), links + r["n"])
    want = {i: x[1:] for i, x in plain_links(lines).items() if x[2]}
    assert found == want and len(want) > 60
