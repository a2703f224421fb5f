"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. A text is its five-word shingles, each with a weight: its count in the text, times
   1 + ``DAMP`` x its inverse document frequency (scaled to 0..1). Frequencies are counted
   over all documents in a sketch of fixed size. The damping keeps large groups alive: in a
   group of thousands of near copies the common shingles are frequent and the odd edit is
   rare, and plain TF-IDF would let the edit outweigh all that the copies share.
2. Equal texts form one node. Each node gets ``BANDS`` x ``ROWS`` consistent weighted samples;
   nodes with an equal band are candidates.
3. In each band the most central node (the one with most company over all bands) is compared
   with all others, by exact weighted Jaccard similarity. Nodes it does not reach are then
   compared with the members of other components in their band, unless the distances to
   the centre exclude a link (weighted Jaccard distance is a metric). Members of one
   component need no further comparison, so a group of copies costs its size, not its square.
4. Classes are the connected components of the verified links, labelled by the least
   document id.

Defined results: words are runs of characters outside ASCII white space. A text of one to
four words is one shingle of all of them; texts without words match only equal texts.
Null texts count as empty. Every row gets a class; rows that repeat an id or a
text are members like others. The class id is the least id of the class, nulls aside
(null if there is none). Other columns pass through ``one_of_each`` whatever their names. An
empty table gives an empty result. Shingles are compared by 64-bit hashes and texts by
128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemograph.llm.common import arrow_map, free_shuffles, stage, text_slices, unstage
from mnemograph.llm.line_dedup import mixed, word_hashes

SLICE_BYTES = 1 << 20       # of text that a task holds at a time; its arrays take 25 times that
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3        # 0.08 % of pairs at the threshold share no band
DAMP = 0.25
CELLS = 1 << 18            # of the sketch of document frequencies
FILTER_CELLS = 1 << 18     # rows at most in the table that preselects documents
CACHED = 1 << 16           # shingles sampled at a time
TABLE = 1 << 16            # draws of each distribution
MAP_WORDS = 32            # 64-bit words of a text's parity map

U = np.uint64
_rng = np.random.default_rng(20_240_229)
GAMMA_R = _rng.gamma(2.0, 1.0, TABLE).astype(np.float32) + np.float32(1e-6)
LOG_C = np.log(_rng.gamma(2.0, 1.0, TABLE) + 1e-9).astype(np.float32)


def node_of(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Shingled:
    """Distinct shingles of the texts of a slice, with their counts, sorted in each text."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        coded = split.flatten().dictionary_encode()
        word = word_hashes(coded.dictionary)[coded.indices.to_numpy()].view(U)
        bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        # Trimming leaves one empty word in a text without words.
        empty = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(
            zero_copy_only=False)
        sizes = np.where(empty, 0, np.diff(bounds))
        each = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
        self.owner = np.repeat(np.arange(n), each)
        at = np.arange(len(self.owner)) - np.repeat(np.cumsum(each) - each, each) \
            + np.repeat(bounds[:-1], each)
        span = np.repeat(np.minimum(sizes, SHINGLE), each)
        key = np.zeros(len(at), U)
        for i in range(SHINGLE):
            use = span > i
            key[use] = mixed(key[use] ^ word[at[use] + i], 11)
        order = np.lexsort((key, self.owner))
        key, owner = key[order], self.owner[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(fresh)
        self.hash, self.owner = key[first], owner[first]
        self.count = np.diff(np.append(first, len(key)))
        self.bounds = np.searchsorted(self.owner, np.arange(n + 1))


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes, 12) >> U(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def frequencies(texts: DataFrame) -> np.ndarray:
    """Weight of a shingle by its cell; CELLS numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(CELLS, np.int64), 0
        for part in text_slices(batches, "text", SLICE_BYTES):
            found = Shingled(part.column("text"))
            total += np.bincount(cells_of(found.hash), minlength=CELLS)
            docs += part.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs))], ["cell", "n"])

    rows = arrow_map(texts.select("text"), run, "cell bigint, n bigint") \
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = rows["cell"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    docs = int(n[cell < 0].sum())
    df = np.zeros(CELLS, np.float64)
    df[cell[cell >= 0]] = n[cell >= 0]
    idf = np.log((docs + 1) / (np.minimum(df, docs) + 1)) / np.log(max(docs, 1) + 1)
    return (1 + DAMP * idf).astype(np.float32)


def band_keys(found: Shingled, weight: np.ndarray) -> list[np.ndarray | None]:
    """The keys of the bands of every text, None for a text without words."""
    out: list[np.ndarray | None] = [None] * (len(found.bounds) - 1)
    full = np.flatnonzero(np.diff(found.bounds))
    at = 0
    while at < len(full):
        # Whole texts, together about as many shingles as stay in a core's cache.
        stop = int(np.searchsorted(found.bounds[full + 1], found.bounds[full[at]] + CACHED, "right"))
        texts = full[at:max(stop, at + 1)]
        lo, hi = found.bounds[texts[0]], found.bounds[texts[-1] + 1]
        h, starts = found.hash[lo:hi], found.bounds[texts] - lo
        log_w = np.log(weight[cells_of(h)] * found.count[lo:hi].astype(np.float32))
        places = np.arange(hi - lo, dtype=np.int64)
        keys = np.zeros((len(texts), BANDS), U)
        for band in range(BANDS):
            key = np.full(len(texts), band, U)
            for row in range(ROWS):
                z = mixed(h, 100 + band * ROWS + row)
                r = GAMMA_R[(z & U(TABLE - 1)).astype(np.intp)]
                beta = ((z >> U(16)) & U(0xFFFFFF)).astype(np.float32) * np.float32(2.0 ** -24)
                t = np.floor(log_w / r + beta)
                log_a = LOG_C[(z >> U(48)).astype(np.intp)] - r * (t - beta) - r
                # A float's bits, made to sort like the float, above the place in the block.
                bits = log_a.view(np.int32).astype(np.int64)
                bits ^= (bits >> 63) & 0x7FFFFFFF
                best = np.minimum.reduceat((bits << 32) | places, starts) & 0xFFFFFFFF
                key = mixed(key ^ h[best], 13)
                key = mixed(key ^ t[best].astype(np.int64).view(U), 14)
            keys[:, band] = key
        for i, text in enumerate(texts.tolist()):
            out[text] = keys[i].view(np.int64)
        at = max(stop, at + 1)
    return out


def heavy_weight(weight: np.ndarray) -> float:
    """What most shingles that few documents have weigh at least."""
    return float(np.quantile(weight, 0.2))


def parity_maps(found: Shingled, weight: np.ndarray) -> np.ndarray:
    """A bit map for each text, in which each of its shingles flips one bit.

    Each bit in which two maps differ stands for a shingle that only one text has. In
    the second half of the map such a shingle weighs ``heavy_weight`` at least, in
    the first half 1. That bounds the similarity from above.
    """
    place = mixed(found.hash, 15)
    heavy = weight[cells_of(found.hash)] >= np.float32(heavy_weight(weight))
    word = (place >> U(32)) % U(MAP_WORDS // 2) + np.where(heavy, U(MAP_WORDS // 2), U(0))
    maps = np.zeros((len(found.bounds) - 1, MAP_WORDS), U)
    np.bitwise_xor.at(maps, (found.owner, word.astype(np.intp)), U(1) << (place & U(63)))
    return maps


def nodes_of(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """(doc, node, bands, total, map): hash, band keys, weight and parity map of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            texts = part.column("text")
            found = Shingled(texts)
            keys = band_keys(found, weight)
            total = np.bincount(found.owner, weight[cells_of(found.hash)] * found.count,
                                len(texts)).astype(np.float64)
            maps = parity_maps(found, weight).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("node"), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(total), pa.array(list(maps), pa.list_(pa.int64()))],
                ["doc", "node", "bands", "total", "map"])

    kind = docs.schema["doc"].dataType.simpleString()
    return arrow_map(docs.select("doc", "node", "text"), run,
                     f"doc {kind}, node binary, bands array<bigint>, total double, map array<bigint>")


def shingles_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes, counts) of the wanted nodes, one row each."""
    # A table of FILTER_CELLS rows at most spares most texts the shuffle.
    cell = F.pmod(F.xxhash64("node"), F.lit(FILTER_CELLS))
    cells = F.broadcast(wanted.select(cell.alias("cell")).distinct())
    near = texts.withColumn("cell", cell).join(cells, "cell", "left_semi") \
        .join(wanted, "node", "left_semi").select("node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES // 2):
            found = Shingled(part.column("text"))
            cuts = pa.array(found.bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.ListArray.from_arrays(cuts, pa.array(found.hash.view(np.int64))),
                 pa.ListArray.from_arrays(cuts, pa.array(found.count, pa.int32()))],
                ["node", "hashes", "counts"])

    return arrow_map(near, run, "node binary, hashes array<bigint>, counts array<int>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
               weight: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = (weight[cells_of(h.view(U))] * n for h, n in (a, b))
    both = np.minimum(wa[i], wb[j]).sum(dtype=np.float64)
    return float(both / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both))


def compared(texts: DataFrame, pairs: DataFrame, weight: np.ndarray) -> DataFrame:
    """``pairs`` (a, b), a stored table, with their similarity, stored as well."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stage(shingles_of(texts, wanted), "shingles")
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("na"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cols = [part.column(c) for c in ("ha", "na", "hb", "nb")]
            sims = []
            for i in range(part.num_rows):
                ha, na, hb, nb = (np.asarray(c[i].values) for c in cols)
                sims.append(similarity((ha, na), (hb, nb), weight))
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(sims, pa.float64())],
                ["a", "b", "similarity"])

    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ha", "na", "hb", "nb")
    tested = stage(arrow_map(both, run, "a binary, b binary, similarity double"), "near-tested")
    unstage(sets)
    free_shuffles(pairs.sparkSession)
    return tested


def components(links: DataFrame) -> DataFrame:
    """(node, label) of linked nodes, stored: the least node that links reach.

    Large and small stars in turn until nothing changes; the number of rounds grows
    with the logarithm of a component's size. Every round is a stored table.
    """
    edges = stage(links.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(
            F.col("x").alias("u"), F.least("x", "m").alias("m"))
        large = both.join(least, F.col("x") == F.col("u")).where("y > x") \
            .select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = stage(large.where("x <> y").distinct(), "large-star")
        least = large.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("u"), "m")
        small = large.join(least, F.col("x") == F.col("u"))
        small = small.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y") \
            .unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).distinct()
        new = stage(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
                    .distinct(), "small-star")
        # Stars only: every node has one neighbour, and no centre is a leaf.
        many = new.groupBy("x").count().where("count > 1")
        inner = new.select(F.col("x").alias("c")).join(new, F.col("c") == F.col("y"), "left_semi")
        if many.isEmpty() and inner.isEmpty():
            done = new.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(
                new.select(F.col("y").alias("node"), F.col("y").alias("label"))).distinct()
            done = stage(done, "near-labels")
            unstage(edges, large, new)
            return done
        unstage(edges, large)
        edges = new


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, node, label) of every row: equal labels are one class."""
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("text")) \
        .withColumn("node", node_of("text"))
    weight = frequencies(rows)
    members = stage(nodes_of(rows, weight), "near-nodes")
    bands = members.where("bands IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands")) \
        .select("node", F.explode("bands").alias("band"))
    bands = stage(bands, "near-bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    groups = stage(bands.join(shared, "band"), "near-groups")
    central = groups.groupBy("node").agg(F.sum("n").alias("company"))
    heads = groups.join(central, "node").groupBy("band").agg(
        F.max(F.struct("company", "node")).alias("h")).select("band", F.col("h.node").alias("head"))
    starred = stage(groups.select("band", "node").join(heads, "band"), "near-stars")
    texts = rows.select("node", "text")
    first = stage(starred.where("node <> head").select(
        F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    unstage(bands, groups)
    tested = compared(texts, first, weight)
    links = tested.where(F.col("similarity") >= SIMILARITY)
    label = components(links)
    # Bands whose nodes are still apart: members of different components, if the
    # distances to the head leave room for a link.
    apart = starred.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")) \
        .join(tested.select(F.col("a").alias("head"), F.col("b").alias("node"), "similarity"),
              ["head", "node"], "left").withColumn(
        "far", 1 - F.when(F.col("head") == F.col("node"), 1.0).otherwise(F.col("similarity")))
    split = apart.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")) \
        .where("l0 <> l1").select("band")
    apart = apart.join(split, "band", "left_semi").where("node <> head") \
        .select("band", "node", "label", "far")
    maps = members.groupBy("node").agg(F.first("total").alias("total"), F.first("map").alias("map"))
    apart = stage(apart.join(maps, "node"), "near-apart")
    other = apart.select(*[F.col(c).alias(f"{c}_b") for c in apart.columns])
    near = F.lit(1 - SIMILARITY + 1e-9)
    # (S - D) / (S + D) is the similarity, S the sum of both weights and D that of
    # what they do not share; bits in which the maps differ are a lower bound of D.
    def differ(words: range) -> Column:
        return sum((F.bit_count(F.col("map")[i].bitwiseXOR(F.col("map_b")[i])) for i in words), F.lit(0))

    light, heavy = differ(range(MAP_WORDS // 2)), differ(range(MAP_WORDS // 2, MAP_WORDS))
    least = light + heavy * (heavy_weight(weight) - 1e-6)
    most = (F.col("total") + F.col("total_b")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    second = apart.join(other, F.col("band") == F.col("band_b")).where(
        (F.col("node") < F.col("node_b")) & (F.col("label") != F.col("label_b"))
        & (F.abs(F.col("far") - F.col("far_b")) <= near)
        & (F.abs(F.col("total") - F.col("total_b")) <= most) & (least <= most)) \
        .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    second = stage(second.join(first, ["a", "b"], "left_anti"), "near-pairs")
    again = compared(texts, second, weight)
    more = again.where(F.col("similarity") >= SIMILARITY)
    if not more.isEmpty():
        unstage(label)
        label = components(links.unionByName(more))
    unstage(starred, first, tested, apart, second, again)
    return members.select("doc", "node").join(label, "node", "left").select(
        "doc", "node", F.coalesce("label", "node").alias("label"))


def class_ids(classes: DataFrame) -> DataFrame:
    """(doc, class_id): the least document id of each row's class."""
    ids = classes.groupBy(F.col("label").alias("l")).agg(F.min("doc").alias("class_id"))
    return classes.join(ids, F.col("label") == F.col("l")).select("doc", "class_id")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row of each class, that with the least id and then text hash, with all its columns."""
    doc, node, key = "_nd_doc", "_nd_node", "_nd_nth"
    least = classes.groupBy("label").agg(F.min(F.struct("doc", "node")).alias("k")) \
        .select(F.to_json(F.struct(F.col("k.doc").alias("id"))).alias(doc),
                F.col("k.node").alias(node))
    # The join leaves rows dealt and sorted by these two, so the window adds no shuffle.
    same = Window.partitionBy(doc, node).orderBy(doc)
    return docs.withColumn(doc, F.to_json(F.struct(F.col(id_col).alias("id")))) \
        .withColumn(node, node_of(text_col)).join(least, [doc, node]) \
        .withColumn(key, F.row_number().over(same)).where(F.col(key) == 1).select(*docs.columns)
