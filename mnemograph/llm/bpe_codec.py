"""BPE encoding and decoding with a pair occurrence index.

A slice of a partition is encoded as a whole: its distinct words lie end to end in one
array of symbols, and an index maps every adjacent pair with a merge rank to all its
positions. Active ranks are applied in ascending order; one merge rewrites all its
positions at once and files the new pairs, which always have higher ranks, in the
lists of their own ranks. Text is cut at ASCII white space first, which no match of the
vocabulary's pattern crosses, so a word is encoded once per slice and its ids are
looked up for every occurrence.

The vocabulary file is one of the kind with word ends: normal form C, lower case, white
space dropped, byte-level symbols, an end mark on the last symbol of a word.

Defined results: null and empty texts have no ids and decode to the empty string. Special
strings of the vocabulary inside a text become their own ids. Rows are independent:
repeated rows repeat, null ids stay, other columns are not read, an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from mnemograph.llm.common import arrow_map, no_cycles, text_slices

SLICE_BYTES = 12 << 20
KEPT_CHUNKS = 400_000      # chunks whose ids a worker remembers
KEPT_LENGTH = 32

_codecs: dict[str, "Codec"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class PairIndex:
    """Symbols of many words end to end, with all positions of each mergeable pair."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merges: np.ndarray, width: int):
        self.keys, self.ranks, self.merges, self.width = keys, ranks, merges, width

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def file(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Adds positions to the lists of their ranks."""
        known = rank >= 0
        if not known.any():
            return
        at, rank = at[known], rank[known]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        firsts = rank[np.concatenate(([0], cuts))].tolist()
        for r, places in zip(firsts, np.split(at, cuts) if len(cuts) else (at,)):
            if r in self.lists:
                self.lists[r].append(places)
            else:
                self.lists[r] = [places]
                heapq.heappush(self.active, r)

    def encode(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that remain, and for each word the end of its ids."""
        n = len(symbols)
        sym = symbols.astype(np.int32)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends[:-1]] = -1
        self.lists, self.active = {}, []
        inner = np.flatnonzero(nxt >= 0)
        self.file(inner, self.rank_of(sym[inner], sym[inner + 1]))
        while self.active:
            r = heapq.heappop(self.active)
            places = self.lists.pop(r)
            at = places[0] if len(places) == 1 else np.concatenate(places)
            left, right, new = self.merges[r]
            after = nxt[at]
            at = at[(sym[at] == left) & (after >= 0) & (sym[after] == right)]
            if not len(at):
                continue
            if left == right:
                at = self.alternate(np.unique(at), nxt)
            gone = nxt[at]
            follow = nxt[gone]
            sym[at] = new
            sym[gone] = -1
            nxt[at] = follow
            has = follow >= 0
            prv[follow[has]] = at[has]
            before = prv[at]
            at_left, at_right = before[before >= 0], at[has]
            heads = np.concatenate((at_left, at_right))
            if len(heads):
                self.file(heads, self.rank_of(sym[heads], sym[nxt[heads]]))
        kept = sym >= 0
        return sym[kept], np.cumsum(kept)[ends - 1]

    @staticmethod
    def alternate(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of runs like a a a a, the occurrences that merging from the left takes."""
        linked = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
        start = np.flatnonzero(~linked)
        offset = np.arange(len(at)) - start[np.cumsum(~linked) - 1]
        return at[offset % 2 == 0]


class Codec:
    """Encoder and decoder of one vocabulary file, with the ids of frequent chunks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**vocab, **self.specials}.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                       if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") \
            if self.specials else None
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], dtype=np.int32)
        self.last = np.array([vocab[c + self.end] for c in names], dtype=np.int32)
        width = len(vocab)
        triples = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]],
                           dtype=np.int64)
        key = triples[:, 0] * width + triples[:, 1]
        order = np.argsort(key, kind="stable")
        self.index = PairIndex(key[order], order.astype(np.int64), triples.astype(np.int32), width)
        self.kept: dict[str, bytes] = {}

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk between special strings, as the vocabulary sees them."""
        if not chunk.isascii():
            # Lower case letter by letter: no rule for a sigma that ends a word.
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        return [chunk] if chunk.isalpha() else self.word.findall(chunk)

    def parts(self, chunk: str) -> list[str]:
        """Words and special strings of a chunk."""
        if "<" not in chunk or self.special is None or not self.special.search(chunk):
            return self.words(chunk)
        out = []
        for i, part in enumerate(self.special.split(chunk)):
            out += [part] if i % 2 else self.words(part)
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each as little-endian unsigned 32-bit numbers."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        ids, stops = self.index.encode(symbols, ends)
        blob, cuts = ids.astype("<u4").tobytes(), (stops * 4).tolist()
        return [blob[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those of frequent ones are remembered."""
        kept = self.kept
        cut = {c: self.parts(c) for c in chunks if c not in kept}
        distinct = list({w: 0 for ws in cut.values() for w in ws if w not in self.specials})
        ids = dict(zip(distinct, self.encode_words(distinct)))
        ids.update((s, i.to_bytes(4, "little")) for s, i in self.specials.items())
        new = {c: ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w])
               for c, w in cut.items()}
        out = [kept[c] if c in kept else new[c] for c in chunks]
        if len(kept) < KEPT_CHUNKS:
            kept.update([(c, v) for c, v in new.items() if len(c) <= KEPT_LENGTH]
                        [:KEPT_CHUNKS - len(kept)])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts without nulls, end to end, and where each text's end.

        Splitting at ASCII white space and finding the distinct chunks are Arrow's
        work; only distinct chunks become Python strings.
        """
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        with no_cycles():
            ids = self.encode_chunks(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        # Position of every id in the pool: its chunk's start, then onwards.
        shift = starts[codes] - ends[:-1]
        flat = pool[np.repeat(shift, lengths) + np.arange(ends[-1])]
        return flat, ends[bounds]

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between them, as the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def codec(path: str) -> Codec:
    """The codec of a file, read once per worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of binary values from numbers end to end."""
    cuts = (ends * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                 [None, pa.py_buffer(cuts), pa.py_buffer(flat.tobytes())])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every row, and the text decoded from the ids if asked for.

    ``ids`` holds little-endian unsigned 32-bit numbers. ``tokenizer`` is a file's
    place on each machine.
    """
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for part in text_slices(batches, "text", SLICE_BYTES):
            flat, ends = own.encode(part.column("text").fill_null(""))
            ids = binaries(flat.astype("<u4"), ends)
            cols = [part.column("id"), pa.array(np.diff(ends), pa.int64()), ids]
            names = ["id", "n_tokens", "ids"]
            if decoded:
                cols.append(pa.array(map(own.decode, ids.to_pylist()), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = pairs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded
    return arrow_map(pairs, run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of every row of ids; null ids decode to the empty string."""
    pairs = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for part in text_slices(batches, "ids", SLICE_BYTES):
            texts = [own.decode(x) for x in part.column("ids").fill_null(b"").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(texts, pa.string())], ["id", "decoded"])

    kind = pairs.schema["id"].dataType.simpleString()
    return arrow_map(pairs, run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
