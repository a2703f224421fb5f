"""Best-fit packing of token pieces with Martello-Toth dominance reduction.

Packing needs no more of the corpus than how many pieces there are of each length, at
most ``limit`` numbers whatever the size of the corpus. The planner works on these
counts: it fixes sets that provably dominate every alternative (a piece with the one
that fills its sequence, or with partners no feasible set can beat), many equal
sequences at a time, until nothing can be fixed, and packs the rest by best fit in
decreasing order. Its result is a list of patterns, each for a number of sequences.
Spark then ranks the pieces of each length, in blocks so that no common length meets in
one task, and finds each piece's place by its rank.

Defined results: a null or empty text is one piece that holds the separator alone.
Repeated rows are packed each for itself; they share an id and pieces, so equal rows
may swap places. A null id stays. Columns with other names are not read. An empty table
gives no rows. Lengths outside 1..limit are refused.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mnemograph.llm.bpe_codec import SLICE_BYTES, binaries, codec
from mnemograph.llm.common import arrow_map, stage, text_slices

LIMIT = 2048
SEPARATOR = 0
BLOCK_ROWS = 1000      # pieces of one length that are ranked together

Pattern = tuple[tuple[int, int], ...]     # (length, how many) in the order of places


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, separator: int = SEPARATOR,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): each document's ids and a separator, cut at ``limit``."""
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for part in text_slices(batches, "text", SLICE_BYTES):
            flat, ends = own.encode(part.column("text").fill_null(""))
            closed = np.insert(flat, ends[1:], separator)
            lengths = np.diff(ends) + 1
            bases = np.cumsum(lengths) - lengths
            cuts = -(-lengths // limit)
            doc = np.repeat(np.arange(len(cuts)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * limit
            length = np.minimum(lengths[doc] - start, limit)
            ids = binaries(closed.astype("<u4"), np.append(bases[doc] + start, len(closed)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                 pa.array(start), pa.array(length), ids],
                ["id", "piece", "start", "length", "ids"])

    kind = pairs.schema["id"].dataType.simpleString()
    return arrow_map(pairs, run, f"id {kind}, piece int, start bigint, length bigint, ids binary") \
        .withColumnRenamed("id", id_col)


class Stock:
    """Pieces still to be packed: a count for each length, and the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to ``most`` that is left besides ``without``; 0 if none."""
        at = bisect_left(self.lengths, most + 1) - 1
        while at >= 0 and self.counts[self.lengths[at]] <= without.count(self.lengths[at]):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def smallest(self, n: int, above: int = 0, without: tuple[int, ...] = ()) -> list[int]:
        """The ``n`` smallest pieces longer than ``above`` besides ``without``."""
        found, at = [], bisect_left(self.lengths, above + 1)
        while len(found) < n and at < len(self.lengths):
            k = self.lengths[at]
            found += [k] * min(self.counts[k] - without.count(k), n - len(found))
            at += 1
        return found


def dominating(stock: Stock, length: int, limit: int) -> tuple[int, ...] | None:
    """Partners of a piece that are at least as good as any others; None if not proven.

    A set dominates if every feasible set with the piece can be exchanged for it, part
    by part, without need of more sequences.
    """
    own, room = (length,), limit - length
    best = stock.largest(room, own)
    if not best:
        return ()
    low = stock.smallest(3, without=own)
    if best == room or len(low) < 2 or low[0] + low[1] > room:
        return (best,)               # no other set holds more, or a second partner
    if len(low) == 3 and sum(low) <= room:
        return None
    # Two partners at most: (best, second) wins if no pair has both above the second.
    second = stock.largest(room - best, (*own, best))
    if not second:
        # Nothing goes with the best; a pair could still hold more than it alone.
        return (best,) if top_pair(stock, own, room) <= best else None
    above = stock.smallest(2, above=second, without=own)
    return (best, second) if len(above) < 2 or sum(above) > room else None


def top_pair(stock: Stock, own: tuple[int, ...], room: int) -> int:
    """The largest sum up to ``room`` of two pieces."""
    most = 0
    for a in stock.lengths:
        if a >= room:
            break
        if stock.counts[a] > own.count(a) and (b := stock.largest(room - a, (*own, a))):
            most = max(most, a + b)
    return most


def reduced(stock: Stock, limit: int) -> list[tuple[int, Pattern]]:
    """Takes dominating sets from the stock, many equal ones at a time."""
    fixed, going = [], True
    while going:
        going = False
        for length in stock.lengths[::-1]:
            while length in stock.counts:
                partners = dominating(stock, length, limit)
                if partners is None:
                    break
                pattern = count_runs((length, *partners))
                n = min(stock.counts[k] // m for k, m in pattern)
                for k, m in pattern:
                    stock.take(k, n * m)
                fixed.append((n, pattern))
                going = True
    return fixed


def count_runs(lengths: tuple[int, ...]) -> Pattern:
    return tuple((k, lengths.count(k)) for k in sorted(set(lengths), reverse=True))


def best_fit(stock: Stock, limit: int) -> list[tuple[int, Pattern]]:
    """Best fit in decreasing order of what is left, equal sequences together."""
    rooms: dict[int, list[tuple[int, Pattern]]] = {}
    order: list[int] = []

    def put(room: int, n: int, pattern: Pattern) -> None:
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_left(order, room), room)
        rooms[room].append((n, pattern))

    for length in stock.lengths[::-1]:
        left = stock.counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                each = limit // length
                n = max(1, left // each)
                m = min(each, left)
                put(limit - m * length, n, ((length, m),))
                left -= n * m
                continue
            room = order[at]
            n, pattern = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                del order[at]
            used = min(n, left)
            if used < n:
                put(room, n - used, pattern)
            *front, (last, m) = pattern
            put(room - length, used, (*front, (last, m + 1)) if last == length
                else (*pattern, (length, 1)))
            left -= used
    return [x for xs in rooms.values() for x in xs]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, Pattern]]:
    """Patterns and how many sequences follow each; together they hold every piece."""
    if any(k < 1 or k > limit for k in counts):
        raise ValueError(f"a piece must have between 1 and {limit} tokens")
    stock = Stock(counts)
    return reduced(stock, limit) + best_fit(stock, limit)


def places(patterns: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset) of each part."""
    rows, used, first = [], {}, 0
    for n, pattern in patterns:
        offset = 0
        for length, m in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, rank + n * m, m, first, offset))
            used[length] = rank + n * m
            offset += m * length
        first += n
    return rows


def pack(items: DataFrame, order: list[str], limit: int = LIMIT, length_col: str = "length"
         ) -> DataFrame:
    """``items`` with sequence_id and offset; ``order`` names the columns that tell items apart.

    ``items`` is read several times and should be a stored table. Its columns must not
    begin with ``_pk_``.
    """
    spark = items.sparkSession
    # At most ``limit`` rows reach the driver, and at most ``limit`` are sent back.
    sizes = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}
    blocks = F.broadcast(spark.createDataFrame(
        [(k, -(-n // BLOCK_ROWS)) for k, n in sizes.items()], "_pk_length bigint, _pk_blocks bigint"))
    length = F.col(length_col)
    cut = items.join(blocks, length == F.col("_pk_length")).withColumn(
        "_pk_block", F.pmod(F.xxhash64(*order), "_pk_blocks")).drop("_pk_blocks")
    # Ranks in two steps: blocks of a length, and pieces of a block.
    starts = cut.groupBy("_pk_length", "_pk_block").count().select(
        F.col("_pk_length").alias("_pk_l"), F.col("_pk_block").alias("_pk_b"),
        (F.sum("count").over(Window.partitionBy("_pk_length").orderBy("_pk_block"))
         - F.col("count")).alias("_pk_start"))
    within = F.row_number().over(
        Window.partitionBy("_pk_length", "_pk_block").orderBy(*order)) - 1
    ranked = cut.withColumn("_pk_within", within).join(
        starts, (F.col("_pk_length") == F.col("_pk_l")) & (F.col("_pk_block") == F.col("_pk_b"))) \
        .withColumn("_pk_rank", F.col("_pk_start") + F.col("_pk_within"))
    # Parts of patterns: each step of the planner uses up a length or a kind of sequence,
    # so their number is bounded by the limit, not by the corpus.
    parts = F.broadcast(spark.createDataFrame(
        places(plan(sizes, limit)), "_pk_len bigint, _pk_from bigint, _pk_to bigint, "
        "_pk_each bigint, _pk_first bigint, _pk_offset bigint"))
    rank = F.col("_pk_rank")
    nth = rank - F.col("_pk_from")
    placed = ranked.join(parts, (F.col("_pk_length") == F.col("_pk_len"))
                         & (rank >= F.col("_pk_from")) & (rank < F.col("_pk_to")))
    return placed.select(
        *items.columns, (F.col("_pk_first") + (nth / F.col("_pk_each")).cast("bigint"))
        .alias("sequence_id"),
        (F.col("_pk_offset") + nth % F.col("_pk_each") * length).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id",
                   text_col: str = "text", digest: bool = False) -> DataFrame:
    """Pieces of all documents with their places.

    Their ids come along, or only a checksum of them (``ids_crc32``) with ``digest``.
    """
    cut = pieces(docs, tokenizer, limit, id_col=id_col, text_col=text_col)
    if digest:
        cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stage(cut, "pieces"), [id_col, "piece"], limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence, at most ``limit`` numbers."""
    return packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
        .alias("ids"))
