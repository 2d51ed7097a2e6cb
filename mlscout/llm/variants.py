"""Spelling variants: words one edit apart, found by walking a trie that is a table.

Words are counted per task before they are shuffled. All words and their reversals form two
tries, kept as one table of edges (side, node, step, n): a node is a prefix, a step its next
two characters, and a step that ends a word has fewer and carries the count of that word.
A frontier of states (word, position, node), each with its one edit made, is joined with the
edges level by level; a state lives while its node has the step that its word goes on with,
and a state that ends where a word ends is a pair of neighbours.

Of two words one edit apart, the halves before or behind the edit are equal. So edits are
made only in the second half of a word or of its reversal, below the crowded top of the trie,
and every pair is found once: replacements from the word with the smaller character, lost
characters from the longer word at the last of equal characters. A join of states with edges
multiplies a row by the alphabet at most, whatever a node holds.

A level per two characters would not end for words of a million letters, so words beyond
``LONG`` characters meet by hashes of all their shortenings (a row per character) and the
pairs are checked on the words themselves. Tests run both ways on the same words.

Null and empty texts have no words; a null id counts as an empty one. Repeated rows count
again, equal ids alike. Texts are read whole. Only key and text are read, so other columns
and their names do not matter. A table without rows gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlscout.llm.common import over_batches, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOSS = 31  # a run whose hash this divides loses a character
LEAST_LENGTH, LEAST_N, RATIO = 7, 2, 10
LONG = 40  # characters of the longest word that walks the trie


def word_counts(
    df: DataFrame, *, key: str = "doc_id", column: str = "text", loss: int = LOSS, length: int = LEAST_LENGTH
) -> DataFrame:
    """(word, n) of all rows: runs in lower case, some with a character lost by their hash."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # lower() of bytes knows A-Z only
            for run, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
                h = zlib.crc32(run.encode(), start)
                if h % loss == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= length:
                    total[run] += n
        return pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
        )

    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("text"))
    return rows.mapInArrow(over_batches(make), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _from(text: Column, at: Column, n: int) -> Column:
    return text.substr(at + 1, F.lit(n))


def _paths(words: DataFrame) -> DataFrame:
    """(side, text, n, size, at, node): each word and its reversal at every place of its second half."""
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("text"), half.alias("first")),
        # the reversal takes the places that the word leaves
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("text"), (size - half).alias("first")),
    )
    return (
        words.select("n", size.alias("size"), F.explode(sides).alias("s"))
        .select("n", "size", "s.*")
        .withColumn("at", F.explode(F.sequence("first", "size")))
        .withColumn("node", F.substring("text", F.lit(1), F.col("at")))
        .drop("first")
    )


def _walked(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of the pairs among words of up to ``LONG`` characters."""
    paths = _paths(words)
    step = _from(F.col("text"), F.col("at"), 2)
    edges = paths.groupBy("side", "node", step.alias("step")).agg(
        F.max(F.when(F.col("at") + F.char_length(step) == F.col("size"), F.col("n"))).alias("end_n")
    )
    # two characters lead on even where a word ends behind them: that end is a step of its own
    edges = stored(edges.withColumn("end_n", F.when(F.char_length("step") < 2, F.col("end_n"))), "edges")

    own = paths.filter("at < size")
    here, there = _from(F.col("text"), F.col("at"), 1), _from(F.col("text"), F.col("at") + 1, 1)
    before = F.when(F.col("at") > 0, F.col("text").substr(F.col("at"), F.lit(1))).otherwise("")
    # of equal characters the last one is lost, which a reversal meets first
    last = F.when(F.col("side") == 0, here != there).otherwise(here != before)
    lost = own.filter(last).select("side", "text", "n", (F.col("at") + 1).alias("at"), "node")
    replaced = (
        own.withColumn("here", here).withColumn("then", there)
        .join(
            edges.filter("step <> ''").select(
                "side", "node", F.substring("step", 2, 1).alias("then"), "step", "end_n"
            ),
            ["side", "node", "then"],
        )
        .filter(F.substring("step", 1, 1) > F.col("here"))
    )
    states = _moved(lost, edges).unionByName(_moved_on(replaced))
    found = None
    while True:
        states = stored(states, "frontier")
        done = states.filter("end_n IS NOT NULL").select("side", "text", "n", "node", "end_n")
        found = done if found is None else found.unionByName(done)
        going = states.filter("end_n IS NULL").drop("end_n")
        if going.isEmpty():
            break
        states = _moved(going, edges)
    return found.select(
        F.when(F.col("side") == 0, F.col("text")).otherwise(F.reverse("text")).alias("word"),
        "n",
        F.when(F.col("side") == 0, F.col("node")).otherwise(F.reverse("node")).alias("other"),
        F.col("end_n").alias("other_n"),
    )


def _moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states whose node has the step that their word goes on with, one level further."""
    wanted = states.withColumn("step", _from(F.col("text"), F.col("at"), 2))
    return _moved_on(wanted.join(edges, ["side", "node", "step"]))


def _moved_on(joined: DataFrame) -> DataFrame:
    return joined.select(
        "side",
        "text",
        "n",
        (F.col("at") + 2).alias("at"),
        F.concat("node", "step").alias("node"),
        "end_n",
    )


PRIME, BASE = (1 << 31) - 1, (48271, 69621)  # two hashes of 31 bits each


def _shortenings(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(size, hashes of the word without each character, whether that is the last of equals, own hash)."""
    for word in words.to_pylist():
        codes = np.array([ord(c) for c in word], np.int64)
        shorter, own = np.zeros(len(codes), np.int64), 0
        for base in BASE:
            before = np.zeros(len(codes) + 1, np.int64)  # hash of each prefix
            behind = np.zeros(len(codes) + 1, np.int64)  # hash of each suffix
            power = np.ones(len(codes) + 1, np.int64)  # of the base, by length of a suffix
            for i, c in enumerate(codes.tolist()):
                before[i + 1] = (before[i] * base + c) % PRIME
                power[i + 1] = power[i] * base % PRIME
            for i in range(len(codes) - 1, -1, -1):
                behind[i] = (behind[i + 1] + int(codes[i]) * int(power[len(codes) - 1 - i])) % PRIME
            rest = power[:-1][::-1]
            mine = (before[:-1] * rest % PRIME + behind[1:]) % PRIME
            shorter, own = shorter << 32 | mine, own << 32 | int(before[-1])
        yield len(codes), shorter, np.append(codes[1:] != codes[:-1], True), own


def _long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word number, kind, size, place, hash): 0 the word itself, 1 a character lost, 2 replaced."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.column(0).slice(i, 1)
            for size, shorter, last, own in _shortenings(batch.column(1).slice(i, 1)):
                at = np.arange(size)
                lost = at[last]
                columns = [
                    np.repeat([0, 1, 2], [1, len(lost), size]),
                    np.concatenate([[size], np.full(len(lost), size - 1), np.full(size, size)]),
                    np.concatenate([[0], np.zeros(len(lost), np.int64), at]),
                    np.concatenate([[own], shorter[last], shorter]),
                ]
                ids = pa.array(one.to_pylist() * len(columns[0]), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, pa.int64()) for c in columns]], ["id", "kind", "size", "place", "hash"]
                )


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced character."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1 :] == b[at + (len(a) == len(b)) :]


def _hashed(words: DataFrame, long: int) -> DataFrame:
    """(word, n, other, other_n) of the pairs whose longer word has more than ``long`` characters."""
    mine = stored(words.select(F.sha2("word", 256).alias("id"), "word", "n"), "long-words")
    rows = stored(
        mine.select("id", "word").mapInArrow(_long_rows, "id string, kind long, size long, place long, hash long"),
        "shortenings",
    )
    meeting = ["size", "place", "hash"]
    # words that differ in one place only: no more than the alphabet has characters
    same = rows.filter((F.col("kind") == 2) & (F.col("size") > long))
    replaced = same.select("id", *meeting).join(same.select(F.col("id").alias("other_id"), *meeting), meeting)
    lost = rows.filter((F.col("kind") == 1) & (F.col("size") >= long)).select("id", *meeting)
    whole = rows.filter("kind = 0").select(F.col("id").alias("other_id"), *meeting)
    pairs = replaced.filter("id < other_id").unionByName(lost.join(whole, meeting)).select("id", "other_id").distinct()
    full = pairs.join(mine, "id").join(mine.toDF("other_id", "other", "other_n"), "other_id")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(map(one_edit, batch.column(0).to_pylist(), batch.column(2).to_pylist()), pa.bool_()))

    return full.select("word", "n", "other", "other_n").mapInArrow(
        checked, "word string, n long, other string, other_n long"
    )


def neighbours(words: DataFrame, *, long: int = LONG) -> DataFrame:
    """(word, n, other, other_n): each pair of distinct words (word, n) one edit apart, once."""
    size = F.char_length("word")
    short = _walked(words.filter(size <= long))
    rest = words.filter(size >= long)
    if words.filter(size > long).isEmpty():
        return short
    return short.unionByName(_hashed(rest, long))


def variants(
    df: DataFrame, *, key: str = "doc_id", column: str = "text", ratio: int = RATIO, least: int = LEAST_N, long: int = LONG
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words that occur ``least`` times or more.

    The form of a word is its most frequent neighbour, if that is ``ratio`` times as frequent;
    ties go to the first in code-point order. The root is where the forms end; as each form
    is more frequent than its word by the ratio, the chains are short and have no circles.
    """
    words = stored(word_counts(df, key=key, column=column).filter(F.col("n") >= least), "words")
    pairs = neighbours(words, long=long)
    both = pairs.select("word", "other", "other_n").unionByName(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b")
    )
    formed = words.join(best, "word", "left").withColumn("enough", -F.col("b.m") >= F.col("n") * ratio)
    formed = stored(
        formed.select(
            "word",
            F.when(F.col("enough"), F.col("b.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("enough"), -F.col("b.m")).alias("form_n"),
        ),
        "forms",
    )
    chains = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the length of the chain that a row has followed
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(chains.join(further, "root", "left"), "chains")
        chains = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next IS NOT NULL").isEmpty():
            break
    return formed.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
