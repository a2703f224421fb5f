"""The pipeline against a plain version of its stages, and its planted cases."""

import collections
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from mnemograph.llm import near_dedup, pii, quality
from mnemograph.llm.common import text_slices
from tests.llm.test_documents import invented, plain_counts, plain_matches, plain_weighted

WORD = public_tokenizers.path("word_bpe_49k.json")


def small_corpus(spark, tmp_path):
    rng = random.Random(11)
    good = ["\n".join(invented(rng, 25, 4000) for _ in range(4)) for _ in range(30)]
    shared = good[0].split("\n")[0]
    texts = good + [good[3], good[3].replace("w", "v", 1)]                     # copies
    texts += [shared + "\n" + invented(rng, 60, 4000)]                          # a shared line
    texts += [invented(rng, 40, 4000) + " card 4111 1111 1111 1111 mail jo@example.com"]
    texts += [" ### ".join(invented(rng, 3) for _ in range(20)) for _ in range(8)] + ["short", None, ""]
    docs = spark.createDataFrame(
        [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(34 + i, 0, 0) for i in range(5)],
                                   "doc_id bigint, quality bigint, toxic bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return texts


def test_stages_one_after_another(spark, tmp_path):
    texts = small_corpus(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    tables = []
    for name, step in corpus_pipeline.STAGES:
        docs = near_dedup.stage(step(spark, docs, sf), f"test-{name}")
        tables.append(docs)
        assert name == "packing" or docs.columns == columns
    kept, lined, single, private, packed = tables

    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(range(34))                       # all good documents, no junk
    match = plain_matches([(i, texts[i]) for i in sorted(ids)])
    want = {i: "\n".join(x for n, x in enumerate(texts[i].split("\n"))
                         if (i, n) not in match or match[i, n][3]) for i in ids}
    got = {r.doc_id: r for r in lined.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    alone = {r.doc_id for r in single.collect()}
    groups = collections.defaultdict(list)
    for i in sorted(ids):
        head = next((g for g in groups if want[g] == want[i] or (
            want[g].split() and want[i].split() and plain_weighted(want[g], want[i], 1) >= 0.8)), i)
        groups[head].append(i)
    assert alone == set(groups)

    texts_out = {r.doc_id: r.text for r in private.collect()}
    permuter = pii.Permuter(corpus_pipeline.PII_KEY)
    assert texts_out == {i: permuter.replaced(want[i])[0] for i in alone}
    assert "4111 1111" not in texts_out[33] and "jo@" not in texts_out[33]

    tok = Tokenizer.from_file(WORD)
    sizes = collections.Counter()
    for r in packed.collect():
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1
                     for i, t in texts_out.items()}

    whole = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()} == {
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed.collect()}


def test_counts_decide_before_forests():
    s = {c: np.array([v]) for c, v in zip(quality.COUNTS, plain_counts("a b c d e f g h i"))}
    assert quality.base_failed(s).all()


def test_shingling_holds_little_beside_a_slice():
    """The arrays of a slice, which a task holds at a time, take 20 MB at most."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    weight = np.ones(near_dedup.CELLS, np.float32)
    tracemalloc.start()
    for part in text_slices([batch], "text", near_dedup.SLICE_BYTES):
        found = near_dedup.Shingled(part.column("text"))
        near_dedup.band_keys(found, weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
