"""Fill-in-middle against a plain version on strings."""

import hashlib
import random
import re

import pytest

from mnemograph.llm import fim


def plain_version(doc_id, text, pattern=None, rate=90, spm_rate=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    begins = [m.start() for m in re.finditer(pattern or r"(?s:.)", text) if m.group()]
    n = len(begins)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    x, y = (0 if not k else len(text) if k == n else begins[k]
            for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h[3] % 100 < spm_rate:
        return n, "spm", x, y - x, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", x, y - x, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("pattern", [None, r"\w+", r"[^x]{3}"])
def test_every_cut_equals_the_plain_version(spark, docs_of, odd_texts, pattern):
    rng = random.Random(2)
    letters = "aé日😀 \n<PSM>x"
    texts = [*odd_texts, "a <M> b", "<S", "P>", "<<P", "a" * 255, "é" * 128, "ab" * 128, "😀" * 64]
    texts += ["".join(rng.choices(letters, k=rng.choice([1, 2, 60, 260, 3000]))) for _ in range(150)]
    texts += texts[-3:]                                                     # repeated rows
    ids = [*range(len(texts) - 6), None, None, 3, 3, -5, 1 << 62]
    got = fim.fill_in_middle(docs_of(texts, ids), pattern=pattern) \
        .withColumn("again", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    want = [(i, *plain_version(i, t, pattern)) for i, t in zip(ids, texts)]
    key = str
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted(want, key=key)
    assert sorted(r.again for r in got) == sorted(t or "" for t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_many_texts_of_a_slice_and_blocks_of_a_text(monkeypatch):
    """The tree of one slice, with blocks and lists of cuts so small that all steps repeat."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(fim, "CUTS", 7)
    rng = random.Random(4)
    texts = ["".join(rng.choices("aé日😀", k=rng.randrange(0, 900))) for _ in range(60)]
    h = [np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2)]
    never, psm = np.zeros(60, np.int64), np.full(60, 99)
    array = pa.array(["cut off", *texts], pa.large_string())[1:]            # an array with an offset
    n, form, a, b, out = fim.cut_slice(array, [*h, never, psm], None, 90, 20)
    for i, t in enumerate(texts):
        if t:
            x, y = sorted((h[0][i] % (len(t) + 1), h[1][i] % (len(t) + 1)))
            assert out[i].as_py() == f"<P>{t[:x]}<S>{t[y:]}<M>{t[x:y]}"
            assert (n[i].as_py(), a[i].as_py(), b[i].as_py()) == (len(t), x, y - x)


def test_empty_table(spark, docs_of):
    assert fim.digests(fim.fill_in_middle(docs_of([]))).collect() == []
