"""BPE codec, token counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemograph.llm import bpe_codec, packing, token_counts

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def plain_ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def generated_texts(n):
    rng = random.Random(3)
    alphabet = list("aabbcdeE'.,!  \n\t0123é日ΣZ") + ["<|endoftext|>", "'s", "   ", " "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_codec_equals_library(docs_of, odd_texts, library):
    texts = odd_texts + generated_texts(150)
    done = bpe_codec.encode(docs_of(texts), WORD, decoded=True)
    tok = library[WORD]
    for row in done.collect():
        want = plain_ids(tok, texts[row.doc_id])
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == want and row.n_tokens == len(want)
        assert row.decoded == tok.decode(want, skip_special_tokens=False)
    again = {r.doc_id: r.decoded for r in bpe_codec.decode(done.select("doc_id", "ids"), WORD).collect()}
    assert again == {r.doc_id: r.decoded for r in done.collect()}


def test_overlapping_merges(library):
    own, tok = bpe_codec.codec(WORD), library[WORD]
    for word in ("aaaaaaa", "ababababab", "hahahahaha", "zzzz", "mississippi" * 5):
        ids = np.frombuffer(own.encode_words([word])[0], "<u4").tolist()
        assert ids == plain_ids(tok, word)


def test_counts_equal_library(docs_of, odd_texts, library):
    texts = odd_texts + generated_texts(300) + ["a\n ", " a", "a \n <|endoftext|>", "a   b \n\n  c "]
    rows = token_counts.over_limit(token_counts.count_tokens(docs_of(texts), BYTE), 1024).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = len(plain_ids(library[BYTE], texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (
            len((texts[r.doc_id] or "").encode()), want, want > 1024)


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert bpe_codec.encode(empty, WORD).count() == 0
    assert token_counts.count_tokens(empty, BYTE).count() == 0
    assert packing.pack_documents(empty, WORD).count() == 0


def test_pieces_and_places(docs_of, odd_texts, library):
    texts = odd_texts + generated_texts(40)
    ids = [None, *range(1, len(texts) - 1), 1]
    rows = packing.pack_documents(docs_of(texts, ids), WORD, limit=64).collect()
    want = sorted((i, plain_ids(library[WORD], t) + [0]) for i, t in list(zip(ids, texts))[1:])
    got = {}
    for r in rows:
        values = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(values) == r.length <= 64 and r.start == 64 * r.piece
        got.setdefault(r.doc_id, []).append((r.piece, values))
    assert sum(len(p) for p in got.values()) == sum(-(-len(x) // 64) for _, x in want) + 1
    for i, x in want:
        if i != 1:
            assert sum((v for _, v in sorted(got[i])), []) == x
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64


def test_digest_and_sequences(docs_of):
    docs = docs_of(["a b c", "d e", "", "f " * 200])
    whole = packing.pack_documents(docs, WORD, limit=32)
    crcs = {(r.doc_id, r.piece): zlib.crc32(bytes(r.ids)) for r in whole.collect()}
    digest = packing.pack_documents(docs, WORD, limit=32, digest=True).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in digest} == crcs
    joined = packing.sequences(whole).collect()
    assert sum(len(r.ids) for r in joined) == sum(len(r.ids) for r in whole.collect())


def fewest(items, limit, best=None):
    """The least number of bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted({x for x in bins if x >= items[i]}):
            rest = list(bins)
            rest[rest.index(b)] = b - items[i]
            put(i + 1, rest)
        put(i + 1, [*bins, limit - items[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_plan_holds_everything_and_reduction_loses_nothing(seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 17, 30])
    items = [rng.randint(1, limit) for _ in range(rng.randint(1, 9))]
    counts = {x: items.count(x) for x in items}
    patterns = packing.plan(counts, limit)
    held = {}
    for n, pattern in patterns:
        assert n > 0 and sum(k * m for k, m in pattern) <= limit
        for k, m in pattern:
            held[k] = held.get(k, 0) + n * m
    assert held == counts
    # What the reduction fixes leaves a rest that needs no more bins than before.
    stock = packing.Stock(counts)
    fixed = sum(n for n, _ in packing.reduced(stock, limit))
    rest = [k for k, n in stock.counts.items() for _ in range(n)]
    assert fixed + fewest(rest, limit) == fewest(items, limit)


def test_lengths_outside_the_limit_are_refused():
    with pytest.raises(ValueError):
        packing.plan({33: 1}, 32)
