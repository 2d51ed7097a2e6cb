"""Exact BM25 top-k search: an index per shard with impact lists and a matrix of frequent terms.

Document frequencies and the mean length are counted over all documents, so shards score as one
index would. A shard holds the distinct texts of its rows: forward lists of terms and impacts,
inverted lists of the rarer terms, and a matrix of the impacts of the terms that many texts
hold. Queries pass in blocks, read from the shared folder, so neither documents nor queries are
repeated in a shuffle. Matrix products and inverted lists give all scores of a block in single
precision; what is within its error of the k-th best is scored again in double precision from
the forward lists. Nothing is cut that could be among the k best. A task goes through several
shards and carries the k best from one to the next; those of all tasks are merged.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Documents without words are never
found and queries without words find nothing; null ids take no part; a document is not an answer
to a query with its own id; equal scores rank by smaller id; documents without a common word
are no answers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlscout.llm.common import byte_rows, counted_words, file_system, groups_of, over_batches, shared_folder, shuffles_dropped

K1, B = 1.2, 0.75
SHARD_BYTES = 24 << 20  # text of a shard
SHARD_ROWS = 20_000
FREQUENT = 20  # terms that one in so many texts holds have a column of the matrix
COLUMNS = 1_024  # that the matrix has at most
QUERY_BLOCK = 256
CARRIED = 2_000  # query blocks whose best a task carries from shard to shard; others put them out by shard
TASKS = 2  # by core; each goes through its shards one after another


def _texts(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter("doc_id IS NOT NULL")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) with term a 64-bit hash; counted per chunk of text before the shuffle."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, _, _ = counted_words(byte_rows(batch.column(1)))
        terms, counts = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "n"])

    parts = _texts(docs).mapInArrow(over_batches(make), "term long, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, counts, ends = counted_words(byte_rows(batch.column(1)))
        ids = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(terms.view(np.int64)), pa.array(counts)], ["query_id", "term", "qtf"]
        )

    return _texts(queries).mapInArrow(over_batches(make), "query_id long, term long, qtf long")


def _ranges(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after another."""
    return np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class ShardIndex:
    """The distinct texts of a shard; a text without words is left out."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], mean: float):
        number: dict[bytes, int] = {}
        own = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        texts = list(number)
        parts = [counted_words(texts[a:b]) for a, b in groups_of([len(t) for t in texts])]
        terms, counts = [p[0] for p in parts], [p[1] for p in parts]
        held = np.concatenate([np.diff(p[2]) for p in parts])
        self.n = len(number)
        # the rows of a text, by id, and the text of every row in order of ids
        order = np.lexsort((ids, own))
        self.rows, self.row_start = ids[order], np.searchsorted(own[order], np.arange(self.n + 1))
        order = np.argsort(ids, kind="stable")
        self.sorted_ids, self.text_of = ids[order], own[order]
        self.start = np.r_[0, np.cumsum(held)]
        self.vocabulary, at = np.unique(np.concatenate(terms), return_inverse=True)
        self.term = at.astype(np.int32)
        tf = np.concatenate(counts).astype(np.float64)
        words = np.bincount(np.repeat(np.arange(self.n), held), tf, self.n)
        length = np.repeat(words, held)
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        text = np.repeat(np.arange(self.n, dtype=np.int32), held)
        df = np.bincount(self.term, minlength=len(self.vocabulary))
        frequent = np.flatnonzero(df * FREQUENT >= self.n)
        frequent = frequent[np.argsort(-df[frequent], kind="stable")[:COLUMNS]]
        self.column = np.full(len(self.vocabulary), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        column = self.column[self.term]
        dense = column >= 0
        self.matrix = np.zeros((self.n, len(frequent)), np.float32)
        self.matrix[text[dense], column[dense]] = self.impact[dense]
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.list_start = np.searchsorted(self.term[rare], np.arange(len(self.vocabulary) + 1))
        self.listed, self.listed_impact = text[rare], self.impact[rare].astype(np.float32)
        # sums of positive numbers in single precision are off by a share of themselves
        self.error = 4 * (len(frequent) + 16) * 2.0**-24
        self.weights, self.asked = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary), bool)

    def _known(self, asked: np.ndarray) -> np.ndarray:
        """The numbers of terms, -1 of those no text holds."""
        if not len(self.vocabulary):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, asked), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == asked, at, -1)

    def _only_own(self, query_id: int) -> np.ndarray:
        """The texts of which every row has the query's id."""
        a, b = (np.searchsorted(self.sorted_ids, query_id, side) for side in ("left", "right"))
        if b - a < 2:
            texts = self.text_of[a:b]
            return texts[self.row_start[texts + 1] - self.row_start[texts] == 1]
        texts, n = np.unique(self.text_of[a:b], return_counts=True)
        return texts[self.row_start[texts + 1] - self.row_start[texts] == n]

    def _exact(self, near: np.ndarray) -> np.ndarray:
        own = [slice(a, b) for a, b in zip(self.start[near].tolist(), self.start[near + 1].tolist())]
        if not own:
            return np.zeros(0)
        term = np.concatenate([self.term[x] for x in own])
        hit = np.flatnonzero(self.asked[term])
        text = np.searchsorted(np.cumsum([x.stop - x.start for x in own]), hit, "right")
        scores = self.weights[term[hit]] * np.concatenate([self.impact[x] for x in own])[hit]
        # terms are added in one order for all
        return np.bincount(text, scores, minlength=len(near))

    def _best(self, near: np.ndarray, scores: np.ndarray, query_id: int, k: int):
        """The k best rows of the texts, other than those with the query's id."""
        begin = self.row_start[near]
        if (self.row_start[near + 1] - begin == 1).all():  # the own row's text is not among them
            ids = self.rows[begin]
            best = np.lexsort((ids, -scores))[:k]
            return ids[best], scores[best]
        ids, of = [], []
        for text, score in zip(near.tolist(), scores.tolist()):
            rows = self.rows[self.row_start[text] : self.row_start[text + 1]]
            a, b = (np.searchsorted(rows, query_id, side) for side in ("left", "right"))
            some = np.concatenate([rows[: min(a, k)], rows[b : b + k]])[:k]
            ids.append(some)
            of.append(np.full(len(some), score))
        ids, of = np.concatenate(ids), np.concatenate(of)
        best = np.lexsort((ids, -of))[:k]
        return ids[best], of[best]

    def search(self, query_ids: list[int], ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Put what is better into the best of each query; query i has the terms between two ends."""
        at = self._known(terms)
        column = np.where(at >= 0, self.column[at] if len(self.column) else -1, -1)
        asked = np.zeros((len(query_ids), self.matrix.shape[1]), np.float32)
        dense = column >= 0
        query = np.repeat(np.arange(len(query_ids)), np.diff(ends))
        np.add.at(asked, (query[dense], column[dense]), weights[dense])  # repeated ids repeat terms
        sums = asked @ self.matrix.T
        k = best.k
        for i, query_id in enumerate(query_ids):
            own = slice(ends[i], ends[i + 1])
            term, weight, row = at[own], weights[own], sums[i]
            rare = (term >= 0) & (column[own] < 0)
            some = term[rare]
            lengths = self.list_start[some + 1] - self.list_start[some]
            places = _ranges(self.list_start[some], lengths)
            if len(places):
                added = self.listed_impact[places] * np.repeat(weight[rare].astype(np.float32), lengths)
                row += np.bincount(self.listed[places], added, minlength=self.n).astype(np.float32)
            row[self._only_own(query_id)] = 0.0
            near = np.flatnonzero((row >= best.scores[i, -1] * (1 - self.error)) & (row > 0))
            if len(near) > 2 * k:
                some = row[near]
                near = near[some >= np.partition(some, -k)[-k] * (1 - self.error)]
            if not len(near):
                continue
            known = term >= 0
            np.add.at(self.weights, term[known], weight[known])
            self.asked[term[known]] = True
            best.merge(i, *self._best(near, self._exact(near), query_id, k))
            self.weights[term[known]], self.asked[term[known]] = 0.0, False


class Best:
    """The k best of each query of a block so far; places without a document score 0."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.ids = np.zeros((len(query_ids), k), np.int64)
        self.scores = np.zeros((len(query_ids), k))

    def merge(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[first], scores[first]

    def batch(self) -> pa.RecordBatch:
        found = self.scores > 0
        columns = [np.repeat(self.query_ids, found.sum(axis=1)), self.ids[found], self.scores[found]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "doc_id", "score"])


def _blocks(folder: str) -> Iterator[pa.RecordBatch]:
    """Blocks of (query_id, terms) from a stored table."""
    system, inner = file_system(folder)
    for file in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path):
        if file.base_name.endswith(".parquet"):
            with system.open_input_file(file.path) as source:
                yield from pq.ParquetFile(source).iter_batches(QUERY_BLOCK)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of each query."""
    rows = _texts(docs).filter(F.octet_length("text") > 0)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    n, total, size = rows.select(words.alias("n"), F.octet_length("text").alias("b")).filter("n > 0").agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))
    ).first()
    mean = total / max(1, n)
    shards = max(1, ceil(size / SHARD_BYTES), ceil(n / SHARD_ROWS))
    # a task's best of a query come out once, however many shards it goes through
    tasks = min(shards, ceil(TASKS * docs.sparkSession.sparkContext.defaultParallelism))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = query_terms(queries).join(document_frequencies(docs), "term").withColumn("weight", idf * F.col("qtf"))
    # a query's list is no longer than its text; every task reads the lists block by block
    folder = shared_folder(docs.sparkSession, "queries")
    with shuffles_dropped(docs.sparkSession):
        weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).write.parquet(folder)

    def found(ids: list[int], texts: list[bytes], carried: list[Best]) -> Iterator[pa.RecordBatch]:
        index = ShardIndex(np.array(ids, np.int64), texts, mean)
        for i, block in enumerate(_blocks(folder)):
            lists = block.column("terms")
            flat = lists.flatten()
            ends = np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy())]
            term = flat.field("term").to_numpy().view(np.uint64)
            weight = flat.field("weight").to_numpy()
            asked = block.column("query_id")
            best = carried[i] if i < len(carried) else Best(asked.to_numpy(), k)
            index.search(asked.to_pylist(), ends, term, weight, best)
            if i >= CARRIED:
                yield best.batch()
            elif i == len(carried):
                carried.append(best)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        carried: list[Best] = []
        held = 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for a, b in groups_of(sizes):
                if texts and (held + sum(sizes[a:b]) > SHARD_BYTES or len(texts) > SHARD_ROWS):
                    yield from found(ids, texts, carried)
                    ids, texts, held = [], [], 0
                some = batch.slice(a, b - a)
                ids += some.column(0).to_pylist()
                texts += byte_rows(some.column(1))
                held += sum(sizes[a:b])
        if texts:
            yield from found(ids, texts, carried)
        yield from (best.batch() for best in carried)

    # rows are dealt by a hash, and ranges of it hold equal numbers of rows
    dealt = rows.withColumn("_h", F.xxhash64("doc_id", "text")).repartitionByRange(tasks, "_h").drop("_h")
    met = dealt.mapInArrow(run, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "score"
    )
