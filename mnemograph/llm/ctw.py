"""LM scoring by context-tree weighting over bytes.

A text is a string of bytes (ASCII letters in lower case) and one end mark. Every byte is
eight binary decisions; at each of its nodes the model mixes Krichevsky-Trofimov
estimates in the contexts of the last 0, 1, 2 and 3 bytes, with the weights that
context-tree weighting gives after the training documents: a context's own estimate counts
by its share in the weighted probability of all it has seen. The result is the model's
log10 probability of a text, and its code length per byte.

Spark counts what follows every context of three bytes, over all training documents; the
counts of shorter contexts are their sums. Weights are built from groups of contexts with the
same last two bytes, then from one row for each such pair. All contexts of three bytes are in
the model, a stored table that grows with them. The ``CONTEXTS`` most visited ones and all
shorter ones go to every task; texts travel to the others in a join.

The baseline is a smoothed unigram model of words. Counts of words are exact. The most
frequent words, at most ``FREQUENT``, are looked up in the task; the others travel to
their counts and back in a join.

Defined results: null and empty texts have no bytes but the end mark, one token. Words are
compared by 64-bit hashes. Rows are independent; repeated rows train and are scored like
others. A null id has no checksum, so its row is not held out and trains. Other columns are
not read. An empty table gives an empty result; without training rows every bit costs one
bit, and the baseline has no known words.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemograph.llm.common import arrow_map, row_key, stage, text_slices
from mnemograph.llm.line_dedup import word_hashes

SLICE_BYTES = 4 << 20
BLOCK = 1 << 19               # bytes whose probabilities are looked up at a time
END = 0xFF                    # never a byte of UTF-8
CONTEXTS = 1 << 16            # contexts of three bytes whose tables go to every task
FREQUENT = 1 << 19            # words whose counts go to every task
SMOOTH = 0.5

LOG2, LOG10 = math.log(2), math.log(10)
_models: dict[str, "Scorer"] = {}


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability (natural log) of a string with so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - math.log(math.pi)


def bit_counts(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 nodes of a byte's tree, from counts of 256 bytes each."""
    zeros, ones = [], []
    for level in range(8):
        half = follows.reshape(len(follows), 1 << level, 2, -1).sum(axis=3)
        zeros.append(half[:, :, 0])
        ones.append(half[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte, from the probability of a one at each node."""
    byte = np.arange(256)
    total = np.zeros((len(one), 256))
    for level in range(8):
        node = (1 << level) - 1 + (byte >> (8 - level))
        bit = (byte >> (7 - level)) & 1
        p = one[:, node]
        total += np.log10(np.where(bit, p, 1 - p))
    return total


class Pair:
    """The contexts that end in two bytes: counts and weights of depths three and two."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.codes, of = np.unique(code >> 8, return_inverse=True)
        follows = np.zeros((len(self.codes), 256))
        np.add.at(follows, (of, code & 255), n)
        self.visits = follows.sum(axis=1).astype(np.int64)
        z3, o3 = bit_counts(follows)
        self.zeros, self.ones = z3.sum(axis=0), o3.sum(axis=0)
        own = log_kt(self.zeros, self.ones)
        self.weighted = np.logaddexp(own, log_kt(z3, o3).sum(axis=0)) - LOG2
        self.rho = np.exp(own - LOG2 - self.weighted)
        self.p3 = (o3 + 0.5) / (z3 + o3 + 1)
        self.p2 = (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def one(self) -> np.ndarray:
        """Probability of a one below depth one: known contexts, and last an unknown one."""
        return self.rho * self.p2 + (1 - self.rho) * np.vstack([self.p3, np.full((1, 255), 0.5)])


def root(weighted: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and estimate of the empty context, from those of all last bytes."""
    z, o = zeros.sum(axis=0), ones.sum(axis=0)
    own = log_kt(z, o)
    return np.exp(own - np.logaddexp(own, weighted.sum(axis=0))), (o + 0.5) / (z + o + 1)


class Scorer:
    """Lookup tables of a model: a row for each context, log10 probabilities of 256 bytes."""

    def __init__(self, depth: np.ndarray, code: np.ndarray, table: np.ndarray):
        self.table, self.depth = table, depth
        self.of = np.zeros(1 << 24, np.int32)
        rows = np.arange(len(depth), dtype=np.int32)
        # From short contexts to long ones, so the longest one that the model has stays.
        self.of[:] = rows[depth == 0][0]
        self.of.reshape(1 << 16, 256)[:, code[depth == 1]] = rows[depth == 1]
        self.of.reshape(256, 1 << 16)[:, code[depth == 2]] = rows[depth == 2]
        self.of[code[depth == 3]] = rows[depth == 3]

    def scores(self, text: np.ndarray, context: np.ndarray, bounds: np.ndarray, whole: bool
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text: bytes with their contexts, and the texts' bounds.

        If the tables are not ``whole``, bytes whose context may have one elsewhere are left
        out: their places, and their log10 probabilities if it has none.
        """
        total, places, logs = np.zeros(len(text) + 1), [], []
        for lo in range(0, len(text), BLOCK):
            hi = min(lo + BLOCK, len(text))
            row = self.of[context[lo:hi]].astype(np.int64)
            found = self.table.ravel()[row * 256 + text[lo:hi]]
            if not whole:
                # Every pair of last bytes has a table, so a context without one is unknown.
                at = np.flatnonzero(self.depth[row] == 2)
                places.append(at + lo)
                logs.append(found[at])
                found[at] = 0
            total[lo + 1:hi + 1] = found
        sums = np.cumsum(total, out=total)
        return (sums[bounds[1:]] - sums[bounds[:-1]], np.concatenate([np.zeros(0, np.int64), *places]),
                np.concatenate([np.zeros(0, np.float32), *logs]))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with end marks, the three bytes before each, the texts' bounds.

    A text begins in the context of end marks.
    """
    low = pc.ascii_lower(texts).cast(pa.large_binary())
    size = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(low.to_pylist()), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.full(bounds[-1], END, np.uint8)
    mark = np.zeros(bounds[-1], bool)
    mark[bounds[1:] - 1] = True
    text[~mark] = raw
    padded = np.concatenate((np.full(3, END, np.uint8), text)).astype(np.int32)
    context = padded[:-3] << 16 | padded[1:-2] << 8 | padded[2:-1]
    # The first bytes of a text do not see the text before it.
    first = bounds[:-1]
    for i in range(3):
        at = first + i
        at = at[at < bounds[1:]] if i else at
        keep = (1 << 8 * i) - 1
        context[at] = (context[at] & keep) | (0xFFFFFF & ~keep)
    return text, context, bounds


def follow_counts(train: DataFrame) -> DataFrame:
    """(code, n): how often each context of three bytes and next byte occur in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            text, context, _ = text_bytes(part.column("text").fill_null(""))
            code = context.astype(np.uint32) << np.uint32(8) | text
            code.sort()
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) \
                else np.zeros(0, int)
            n = np.diff(np.append(first, len(code)))
            yield pa.RecordBatch.from_arrays([pa.array(code[first].astype(np.int64)), pa.array(n)],
                                             ["code", "n"])

    return arrow_map(train.select("text"), run, "code bigint, n bigint") \
        .groupBy("code").agg(F.sum("n").alias("n"))


MODEL = "depth int, code bigint, visits bigint, logs binary"
TOP = "weighted binary, zeros binary, ones binary"


def fit(train: DataFrame) -> DataFrame:
    """The model, a stored table (depth, code, visits, logs) of all contexts."""
    counts = stage(follow_counts(train), "ctw-counts")
    # No more than 256 contexts, whatever the corpus.
    by_pair = counts.groupBy(F.shiftright("code", 8).bitwiseAND(0xFFFF).alias("pair"))

    def of(rows: pd.DataFrame) -> Pair:
        return Pair(rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))

    def pair_weights(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = of(rows)
        return pd.DataFrame({"pair": [key[0]], "weighted": [s.weighted.tobytes()],
                             "zeros": [s.zeros.tobytes()], "ones": [s.ones.tobytes()]})

    def weights(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, z, o = (np.array([np.frombuffer(x) for x in rows[c]]) for c in ("weighted", "zeros", "ones"))
        z, o = z.sum(axis=0), o.sum(axis=0)
        w = np.logaddexp(log_kt(z, o), w.sum(axis=0)) - LOG2
        return pd.DataFrame({"last": [key[0]], "weighted": [w.tobytes()], "zeros": [z.tobytes()],
                             "ones": [o.tobytes()]})

    # 256 rows of 255 numbers.
    tops = by_pair.applyInPandas(pair_weights, f"pair bigint, {TOP}") \
        .groupBy(F.col("pair").bitwiseAND(255).alias("last")) \
        .applyInPandas(weights, f"last bigint, {TOP}").collect()
    empty = train.sparkSession.createDataFrame([], MODEL)
    if not tops:
        return empty
    tops = sorted(tops)
    w1, z1, o1 = (np.array([np.frombuffer(r[c]) for r in tops]) for c in ("weighted", "zeros", "ones"))
    rho0, p0 = root(w1, z1, o1)
    rho1, p1 = np.exp(log_kt(z1, o1) - LOG2 - w1), (o1 + 0.5) / (z1 + o1 + 1)
    at = {r["last"]: i for i, r in enumerate(tops)}

    def mix(i: int | slice, below: np.ndarray) -> np.ndarray:
        return byte_logs(rho0 * p0 + (1 - rho0) * (rho1[i] * p1[i] + (1 - rho1[i]) * below)) \
            .astype(np.float32)

    def tables(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = of(rows)
        logs = mix(at[key[0] & 255], s.one())
        return pd.DataFrame({"depth": [3] * len(s.codes) + [2], "code": [*s.codes, key[0]],
                             "visits": [*s.visits, s.visits.sum()], "logs": [x.tobytes() for x in logs]})

    # The context of a byte never seen has only the root.
    short = [(1, r["last"], 0, bytearray(x.tobytes())) for r, x in zip(tops, mix(slice(None), 0.5))]
    one = (rho0 * p0 + (1 - rho0) * 0.5)[None, :]
    short.append((0, 0, 0, bytearray(byte_logs(one).astype(np.float32).tobytes())))
    return stage(by_pair.applyInPandas(tables, MODEL).unionByName(
        train.sparkSession.createDataFrame(short, MODEL)), "ctw-model")


def hot_part(model: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What every task gets, and the (context, logs) of the contexts it leaves out, if any."""
    step = F.floor(F.log2("visits") * 8)
    deep = F.col("depth") == 3
    # A histogram of visits in steps of an eighth of an octave reaches the driver.
    least, held = None, 0
    for row in sorted(model.where(deep).groupBy(step.alias("step")).count().collect(), reverse=True):
        held += row["count"]
        if held > CONTEXTS:
            least = row["step"] + 1
            break
    if least is None:
        return model, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw = b"".join(part.column("logs").to_pylist())
            logs = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * 256),
                                            pa.array(np.frombuffer(raw, np.float32)))
            yield pa.RecordBatch.from_arrays([part.column("code"), logs], ["context", "logs"])

    cold = arrow_map(model.where(deep & (step < least)).select("code", "logs"), run,
                     "context bigint, logs array<float>")
    return model.where(~deep | (step >= least)), cold


def arrays_of(model: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depths, codes and tables of a stored model; one uniform table for an empty one."""
    found = model.toArrow()
    logs = [np.frombuffer(x.buffers()[2], np.uint8)[np.frombuffer(x.buffers()[1], np.int32)[x.offset]:][
        :1024 * len(x)] for x in found.column("logs").cast(pa.binary()).chunks if len(x)]
    if not logs:
        return np.zeros(1, int), np.zeros(1, int), np.full((1, 256), -8 * math.log10(2), np.float32)
    return (found.column("depth").to_numpy(), found.column("code").to_numpy(),
            np.concatenate(logs).view(np.float32).reshape(-1, 256))


def scorer_of(name: str, arrays: tuple) -> Scorer:
    if name not in _models:
        _models.clear()
        _models[name] = Scorer(*arrays)
    return _models[name]


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): the exact count of each word's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            word, code, real, _ = words_of(part.column("text").fill_null(""))
            n = np.bincount(code[real], minlength=len(word))
            yield pa.RecordBatch.from_arrays([pa.array(word[n > 0]), pa.array(n[n > 0])], ["word", "c"])

    return arrow_map(train.select("text"), run, "word bigint, c bigint") \
        .groupBy("word").agg(F.sum("c").alias("c"))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words; of every word its place among them, whether it is one, its text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    code = coded.indices.to_numpy()
    return word_hashes(coded.dictionary), code, full[code] if len(code) else np.zeros(0, bool), owner


def scored(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Both models' log10 probabilities of every row, learnt from the rows not ``held`` out.

    (id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)
    """
    spark = docs.sparkSession
    held = held_out(F.col(id_col)) if held is None else held
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"),
                       held.alias("held"))
    train = rows.where(~F.col("held"))
    hot, cold = hot_part(fit(train))
    whole_model = cold is None
    counts = stage(word_counts(train), "word-counts")
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    docs_trained = train.count()       # each has one end token
    total = (sums[0] or 0) + docs_trained
    kinds = sums[1] + (1 if docs_trained else 0)
    whole = total + SMOOTH * (kinds + 1)
    end = math.log10((docs_trained + SMOOTH) / whole)

    # Counts from which on at most FREQUENT words are sent to the tasks.
    step = F.floor(F.log2("c") * 8)
    least, seen = 0, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        seen += row["count"]
        if seen > FREQUENT:
            least = row["step"] + 1
            break
    common = counts.where(step >= least).toArrow().sort_by("word")
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((
        common.column("word").to_numpy(), common.column("c").to_numpy(), arrays_of(hot)))
    del common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counted, table = shared.value
        scorer = scorer_of(name, table)
        for part in text_slices(batches, "text", SLICE_BYTES):
            texts = part.column("text")
            n = len(texts)
            text, context, bounds = text_bytes(texts)
            score, place, logs_there = scorer.scores(text, context, bounds, whole_model)
            # Bytes in other contexts, each kind once a text.
            kind = np.searchsorted(bounds, place, side="right") - 1 << 32 \
                | context[place].astype(np.int64) << 8 | text[place]
            kind, first, times = np.unique(kind, return_index=True, return_counts=True)
            ends = pa.array(np.searchsorted(kind >> 32, np.arange(n + 1)).astype(np.int32))
            far = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (
                kind & 0xFFFFFFFF, times.astype(np.int32), logs_there[first])]
            word, code, real, owner = words_of(texts)
            at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
            hit = words[at] == word if len(words) else np.zeros(len(word), bool)
            c = np.where(hit, counted[at], 0) if len(words) else np.zeros(len(word))
            logs = np.log10((c + SMOOTH) / whole)
            code, owner = code[real], owner[real]
            known = np.bincount(owner, hit[code], n).astype(np.int64)
            base = np.bincount(owner, np.where(hit, logs, 0.0)[code], n).astype(np.float64)
            tokens = np.bincount(owner, minlength=n) + 1
            # Other words of each text once, with their number, to be looked up in a join.
            rare = ~hit[code]
            pair = owner[rare] * np.int64(len(word) + 1) + code[rare]
            pair, times = np.unique(pair, return_counts=True)
            of = pair // (len(word) + 1)
            cuts = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            rare_words = pa.ListArray.from_arrays(
                pa.array(cuts), pa.array(word[pair % (len(word) + 1)]))
            rare_times = pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("held"), part.column("row"), pa.array(tokens),
                 pa.array(known), pa.array(base), pa.array(score),
                 pa.array(np.diff(bounds) - 1), rare_words, rare_times, *far],
                ["doc", "held", "row", "tokens", "known", "base", "score", "n_bytes", "words",
                 "times", "codes", "code_times", "code_logs"])

    kind = rows.schema["doc"].dataType.simpleString()
    keyed = rows.withColumn("row", row_key("doc", "text"))
    parts = stage(arrow_map(
        keyed, run, f"doc {kind}, held boolean, row bigint, tokens bigint, known bigint, "
        "base double, score double, n_bytes bigint, words array<bigint>, times array<int>, "
        "codes array<bigint>, code_times array<int>, code_logs array<float>"),
        "ctw-scored")
    # Equal rows ask once: each takes the same answer from the join.
    rare = parts.dropDuplicates(["row"]).select("row", F.explode(F.arrays_zip("words", "times")).alias("w")) \
        .select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    looked = rare.join(counts.where(step < least), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + SMOOTH) / whole)).alias("rest"))
    once = parts.dropDuplicates(["row"])
    if not whole_model:
        far = once.select("row", F.explode(F.arrays_zip("codes", "code_times", "code_logs")).alias("w")) \
            .select("row", F.shiftright("w.codes", 8).alias("context"), "w.*") \
            .join(cold, "context", "left")
        log = F.coalesce(F.get("logs", F.col("codes").bitwiseAND(255).cast("int")), "code_logs")
        far = far.groupBy("row").agg(F.sum(F.col("code_times") * log.cast("double")).alias("far"))
        parts = parts.join(far, "row", "left").withColumn(
            "score", F.col("score") + F.coalesce("far", F.lit(0.0))).drop("far")
    bits = -F.col("score") * (LOG10 / LOG2)
    return parts.drop("words", "times", "codes", "code_times", "code_logs").join(looked, "row", "left").select(
        F.col("doc").alias(id_col), F.col("held").alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + (1 if docs_trained else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + end).alias("base_score"), "score",
        "n_bytes", (bits / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
