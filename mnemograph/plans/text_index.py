"""A stored inverted index: postings sorted by term, and the totals that scores need.

Documents are added in steps; each step writes one segment whose files hold ranges of
terms, and a table of *fences* with the first and last term of every file. A query reads
the fences, and then only the files in which its terms, or the terms its prefixes start,
can lie; within them Parquet's own statistics prune on. Scores that depend on the whole
collection (BM25, fact scores) come from postings and totals at the time of the query, so
adding never rewrites anything. The norms of vectors do depend on every document: they are
derived from the postings, without any text, when they are asked for and out of date.

Segments are merged when there are many, and each state of the index is published at
once (:mod:`mnemograph.sources.versions`).
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions import text as X
from mnemograph.operators import retrieval
from mnemograph.sources import sinks
from mnemograph.sources.versions import Versions

MERGE_FROM = 8          # segments from which the newest are merged
KEPT = 3                # merges, and tables of norms, whose files stay for readers
LAST = "\U0010ffff"     # after every string that a prefix starts

#: Kinds of postings: full-text tokens (BM25), and words (TF-IDF).
FULL_TEXT, WORDS = "f", "w"
KINDS = {FULL_TEXT: X.fts_tokens, WORDS: X.tokenize}


def posting_rows(docs: DataFrame, key: str, text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(kind, term, key, tf, len): one row per document, kind and term."""
    toks = docs.select(F.col(key).alias("key"), *[KINDS[kind](F.col(text)).alias(kind) for kind in kinds])
    rows = toks.select("key", F.inline_outer(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("toks")) for kind in kinds])))
    return X.counted(rows, "toks", "key", "kind")


class TextIndex:
    """``kinds`` names the postings that are stored; a search needs those of its kind."""

    def __init__(self, spark: SparkSession, path: str, key: str, kinds: tuple[str, ...] = tuple(KINDS)):
        self.spark, self.path, self.key, self.kinds = spark, path.rstrip("/"), key, kinds
        self.versions = Versions(spark, f"{self.path}/versions")

    def state(self) -> dict | None:
        return self.versions.newest()

    def upto(self) -> int:
        """The last log position that was added, as its writer gave it."""
        state = self.state()
        return state["upto"] if state else 0

    # -- writing ----------------------------------------------------------------

    def _write(self, rows: DataFrame, home: str) -> None:
        """A table in files of term ranges, and its fences.

        The term comes first: Spark compares rows by the first bytes of the first column.
        """
        order = ["term", "kind", "key"]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{home}/rows")
        # A file's rows lie in order, so its ends give the fences; places aggregate without a sort.
        placed = self.spark.read.parquet(f"{self.path}/{home}/rows").select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "kind", "term")
        ends = placed.groupBy("file", "kind").agg(F.min("row").alias("first"), F.max("row").alias("last"))
        placed.join(F.broadcast(ends), ["file", "kind"]).where(F.col("row").isin(F.col("first"), F.col("last"))) \
            .groupBy("file", "kind").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1) \
            .write.parquet(f"{self.path}/{home}/fences")

    def add(self, docs: DataFrame, text: str, upto: int = 0, after: int | None = None) -> bool:
        """Add documents with new keys as a segment; False if another writer was first.

        ``upto`` is remembered with the segment; ``after`` is what it was when the
        documents were picked.
        """
        home = f"seg-{uuid.uuid4().hex}"
        # The bounds of the ranges are sampled in a pass of their own, so the tokens are written first.
        draft = f"{self.path}/{home}/draft"
        posting_rows(docs, self.key, text, self.kinds).write.parquet(draft)
        self._write(self.spark.read.parquet(draft), home)
        sinks.remove(self.spark, draft)
        # Documents without tokens count too; the long ones count by their postings.
        n = docs.count()
        length = self.spark.read.parquet(f"{self.path}/{home}/rows").where(
            F.col("kind") == FULL_TEXT).agg(F.sum("tf")).collect()[0][0] or 0

        def change(old: dict | None) -> dict | None:
            state = old or {"n": 0, "length": 0, "upto": 0, "segments": [], "vectors": None, "gone": []}
            if after is not None and state["upto"] != after:
                return None
            return {**state, "n": state["n"] + n, "length": state["length"] + length,
                    "upto": max(upto, state["upto"]),
                    "segments": state["segments"] + [{"home": home, "n": n}]}

        state = self.versions.update(change)
        if state is None:
            sinks.remove(self.spark, f"{self.path}/{home}")
            return False
        if len(state["segments"]) > MERGE_FROM:
            self.merge()
        return True

    def merge(self) -> None:
        """Merge the newest segments, as far back as none is larger than twice the later ones."""
        state = self.state()
        segments, start, later = state["segments"], len(state["segments"]) - 1, 0
        while start > 0 and segments[start - 1]["n"] <= 2 * (later + segments[start]["n"]):
            later += segments[start]["n"]
            start -= 1
        picked = [s["home"] for s in segments[start:]]
        if len(picked) < 2:
            return
        home = f"seg-{uuid.uuid4().hex}"
        self._write(self.spark.read.parquet(*[f"{self.path}/{h}/rows" for h in picked]), home)

        def change(old: dict | None) -> dict | None:
            if not set(picked) <= {s["home"] for s in old["segments"]}:
                return None
            left = [s for s in old["segments"] if s["home"] not in picked]
            n = sum(s["n"] for s in old["segments"] if s["home"] in picked)
            return {**old, "segments": [*left, {"home": home, "n": n}],
                    "gone": (old["gone"] + [picked])[-KEPT:]}

        done = self.versions.update(change)
        for names in ([[home]] if done is None else (state["gone"] + [picked])[:-KEPT]):
            for name in names:
                sinks.remove(self.spark, f"{self.path}/{name}")

    def vectors(self) -> dict:
        """The state with the norms of all documents' vectors, derived if out of date."""
        state = self.state()
        if state["vectors"] and state["vectors"]["n"] == state["n"]:
            return state
        rows = self._rows(state).where(F.col("kind") == WORDS).select("term", "key", "tf", "len")
        df = rows.groupBy("term").agg(F.count("tf").alias("df"))
        squares = rows.join(df, "term").select("key", self._raw(state).alias("raw"))
        home = f"norm-{uuid.uuid4().hex}"
        squares.groupBy("key").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")) \
            .where(F.col("norm") > 0).write.parquet(f"{self.path}/{home}")
        made = {"home": home, "n": state["n"]}
        stale = []

        def change(old: dict | None) -> dict | None:
            if old["n"] != made["n"]:
                return None
            kept = [*([old["vectors"]["home"]] if old["vectors"] else []), *old.get("old_vectors", [])]
            stale[:] = kept[KEPT:]
            return {**old, "vectors": made, "old_vectors": kept[:KEPT]}

        done = self.versions.update(change)
        if done is None:
            sinks.remove(self.spark, f"{self.path}/{home}")
            return self.vectors()
        for name in stale:
            sinks.remove(self.spark, f"{self.path}/{name}")
        return done

    @staticmethod
    def _raw(state: dict) -> Column:
        """A term's weight before it is normalised, of its ``tf``, ``len`` and ``df``."""
        return F.col("tf") / F.col("len") * retrieval.idf(F.lit(max(state["n"], 1)), F.col("df"))

    # -- reading ----------------------------------------------------------------

    def _rows(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{s['home']}/rows" for s in state["segments"]])

    def lookup(self, homes: list[str], kind: str, ranges: list[tuple[str, str]]) -> DataFrame:
        """Rows whose term lies in one of the ranges, out of the files that can hold them."""
        def inside(low: Column, high: Column) -> Column:
            hits = [(high >= a) & (low <= b) for a, b in ranges]
            return (F.col("kind") == kind) & reduce(lambda x, y: x | y, hits)

        fences = self.spark.read.parquet(*[f"{self.path}/{h}/fences" for h in homes])
        files = [r["file"] for r in fences.where(inside(F.col("low"), F.col("high"))).select("file").collect()]
        if not files:
            return self.spark.read.parquet(f"{self.path}/{homes[0]}/rows").limit(0)
        return self.spark.read.parquet(*files).where(inside(F.col("term"), F.col("term")))

    def postings(self, kind: str, ranges: list[tuple[str, str]], state: dict | None = None) -> DataFrame:
        if kind not in self.kinds:
            raise ValueError(f"postings of kind {kind!r} are not stored")
        return self.lookup([s["home"] for s in (state or self.state())["segments"]], kind, ranges)

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("key", self.key)

    def bm25(self, query: str) -> DataFrame:
        """(key, rank) of every document with a token that a prefix of the query starts."""
        state, prefixes = self.state(), X.fts_prefixes(query)
        found = self.postings(FULL_TEXT, [(p, p + LAST) for p in prefixes] or [("", "")], state)
        if not prefixes:
            return self._named(found.select("key", F.lit(0.0).alias("rank")).limit(0))
        counted = found.groupBy("key", "len").agg(*[
            F.sum(F.when(F.col("term").startswith(p), F.col("tf")).otherwise(0)).alias(f"f{i}")
            for i, p in enumerate(prefixes)])
        totals = F.struct(F.lit(state["n"]).alias("n"),
                          F.lit(state["length"] / max(state["n"], 1)).alias("avg_len"))
        return self._named(retrieval.bm25_rank(counted, ("key",), len(prefixes), totals))

    def bm25_top(self, query: str, k: int) -> DataFrame:
        return self.bm25(query).orderBy("rank", self.key).limit(k)

    def tfidf_top(self, query: str, k: int = P.VECTOR_K) -> DataFrame:
        """(key, similarity) by cosine, of the query's postings and the stored norms."""
        state, bag = self.vectors(), Counter(X.tokenize_text(query))
        hits = self.postings(WORDS, [(w, w) for w in bag] or [("", "")], state)
        words = self.spark.createDataFrame(list(bag.items()), "term string, c bigint")
        df = hits.groupBy("term").agg(F.count("tf").alias("df"))
        known = df.join(words, "term").select("term", "df", (
            F.col("c") * retrieval.idf(F.lit(state["n"]), F.col("df"))).alias("raw"))
        known = known.crossJoin(known.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))) \
            .select("term", "df", (F.col("raw") / F.col("norm")).alias("q"))
        norms = self.spark.read.parquet(f"{self.path}/{state['vectors']['home']}")
        weighed = hits.join(known, "term").join(norms, "key").select(
            "key", "q", S.rounded(self._raw(state) / F.col("norm"), 6).alias("weight"))
        return self._named(retrieval.top_similar(weighed, "key", k))

    def fact_top(self, query: str, k: int = 5) -> DataFrame:
        """(key, score) by summed tf-idf; a repeated query token counts each time."""
        state, bag = self.state(), Counter(X.tokenize_text(query))
        hits = self.postings(WORDS, [(w, w) for w in bag] or [("", "")], state)
        words = self.spark.createDataFrame(list(bag.items()), "term string, c bigint")
        df = hits.groupBy("term").agg(F.count("tf").alias("df"))
        score = F.sum(F.col("c") * F.col("tf") / F.col("len")
                      * retrieval.idf(F.lit(max(state["n"], 1)), F.col("df")))
        return self._named(hits.join(df, "term").join(words, "term").groupBy("key")
                           .agg(S.rounded(score).alias("score")).orderBy(F.desc("score"), "key").limit(k))
