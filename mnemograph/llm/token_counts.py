"""Token counts: how many tokens a public tokenizer makes of every text.

The tokenizers library encodes inside Arrow functions and only lengths leave the task.
Texts are cut at safe boundaries into pieces; each distinct piece of a slice is
encoded once, in library batches that hold about the same number of bytes.

A boundary is safe between a character that is no white space and one space that is
followed by such a character: every match of the byte-level pattern ends there, and no
special string of the vocabulary holds a space. So the counts of the pieces add up to
the count of the text.

Defined results: a null or empty text has zero bytes and tokens. Rows are
independent, so repeated rows give repeated results, null ids stay, other columns are
not read, and an empty table gives an empty result. A text without a safe boundary is
one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mnemograph.llm.common import arrow_map, no_cycles, quiet_tokenizers, text_slices

SLICE_BYTES = 12 << 20      # of text that a task holds at a time
BATCH_BYTES = 1 << 20      # of pieces in one call of the library
KEPT_PIECES = 400_000      # lengths of pieces that a worker remembers
KEPT_LENGTH = 48           # characters of the longest piece worth remembering

SAFE = re.compile(r"(?<=\S)(?= \S)")
# A space that white space precedes and white space or the end follows (RE2 syntax).
_WHITE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
UNSAFE = rf"{_WHITE} (?:{_WHITE}|\z)"
_workers: dict[str, tuple] = {}


def byte_batches(pieces: list[str], most: int) -> Iterator[list[str]]:
    """The pieces in order of length, in lists of about ``most`` bytes each."""
    batch, size = [], 0
    for piece in sorted(pieces, key=len):
        batch.append(piece)
        size += 4 * len(piece) if not piece.isascii() else len(piece)
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _worker(path: str):
    if path not in _workers:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        specials = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        if any(re.search(r"\s", s) for s in specials):
            raise ValueError("a special string with white space has no safe boundary")
        _workers[path] = tok, specials, {}
    return _workers[path]


def _encode(pieces: list[str], path: str) -> list[int]:
    """Lengths of distinct pieces."""
    tok, _, kept = _worker(path)
    new = [x for x in pieces if x not in kept]
    lengths = {}
    for batch in byte_batches(new, BATCH_BYTES):
        found = tok.encode_batch_fast(batch, add_special_tokens=False)
        lengths.update(zip(batch, map(len, found)))
    out = [kept[x] if x in kept else lengths[x] for x in pieces] if new else \
        [kept[x] for x in pieces]
    if len(kept) < KEPT_PIECES:
        kept.update([(x, lengths[x]) for x in new if len(x) <= KEPT_LENGTH]
                    [:KEPT_PIECES - len(kept)])
    return out


def lengths(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text of a slice without nulls."""
    specials = _worker(path)[1]
    odd = pc.match_substring_regex(texts, UNSAFE)
    for special in specials:
        odd = pc.or_(odd, pc.match_substring(texts, special))
    out = np.zeros(len(texts), np.int64)
    # Where every space may begin a piece, splitting and finding the distinct pieces
    # are Arrow's work, and only distinct pieces become Python strings.
    plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
    if len(plain):
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        firsts = split.flatten().take(pa.array(starts)).dictionary_encode()
        coded = split.flatten().dictionary_encode()
        counts = np.array(_encode([f" {x}" for x in coded.dictionary.to_pylist()], path),
                          np.int64)[coded.indices.to_numpy()]
        counts[starts] = np.array(_encode(firsts.dictionary.to_pylist(), path),
                                  np.int64)[firsts.indices.to_numpy()]
        out[plain] = np.add.reduceat(counts, starts)
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        out[i] = sum(_encode(SAFE.split(texts[int(i)].as_py()), path))
    return out


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; ``tokenizer`` is a file's place on each machine."""
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            texts = part.column("text").fill_null("")
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            with no_cycles():
                counts = pa.array(lengths(texts, tokenizer), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), sizes, counts], ["id", "n_bytes", "n_tokens"])

    kind = pairs.schema["id"].dataType.simpleString()
    return arrow_map(pairs, run, f"id {kind}, n_bytes bigint, n_tokens bigint") \
        .withColumnRenamed("id", id_col)


def over_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    """Marks the texts that are longer than a context of ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
