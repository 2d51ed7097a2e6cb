"""Removal of repeated passages by merging Burrows-Wheeler transforms of text shards.

Every 100-byte window belongs to one segment: a run of windows with the same smallest
32-byte gram (by hash). Equal windows have equal smallest grams, so segments with one gram are
the only places where a window can occur again, and they are worked on apart from the rest.

1. One pass over the texts lists the segments as (gram, content hash, place). Per gram, all but
   the first of equal segments are repeats as a whole. Copies inside a chunk of text are
   settled before the shuffle, which keeps frequent passages small.
2. First segments whose gram has other contents as well are cut from their texts and dealt out
   by gram. Blocks of them are divided into shards, each shard's suffixes are sorted once and
   give its Burrows-Wheeler transform (over symbols of several bytes), and the transforms are merged by
   refining their interleaving: each round orders the slots by one more symbol, stably, until
   nothing changes or 100 bytes are reached. Neighbours with 100 bytes in common form the
   repeated intervals; all but the earliest window of one are repeats.
   A gram with very many contents (a common line) is not worked on in one place: its windows
   are compared by their own hashes instead.
3. The repeated windows of a document are united and cut out of its bytes.

A window counts as earlier by document id, then by place. Null texts are empty. Rows that share
an id are told apart by a number in the order of their texts, equal rows too. Kept bytes that
no longer form a character are left out of ``text``, never out of the digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.llm.common import byte_rows, groups_of, mixed, over_batches, stored

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # grams in a window of text
LONGEST = 128  # windows of a segment
CROWD = 20_000  # contents of a gram from which its windows are compared one by one
SHARD_BYTES = 1 << 16
BLOCK_BYTES = 1 << 18
CHUNK = 1 << 18
_BYTE = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))
_MUL = np.uint64(0x9FB21C651E98DF25)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte grams, by doubling."""
    h = _BYTE[data]
    width = 1
    while width < GRAM:
        h = h[:-width] * _MUL + (h[width:] ^ (h[width:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        width *= 2
    h *= _MUL
    h ^= h >> np.uint64(31)
    return h


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over all runs of ``size`` values."""
    width = 1
    while 2 * width <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return pick(values[:-rest], values[rest:]) if rest else values


def segments(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, content, start, windows, tied) of the segments of concatenated texts.

    ``ends`` are the ends of the texts; windows across an end are left out. ``tied`` marks
    segments in which the gram occurs more than once: only these may repeat a window within.
    """
    none = np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(bool)
    raw = np.frombuffer(data, np.uint8)
    grams = gram_hashes(raw)
    least = _sliding(grams, WINDOW, np.minimum)
    n = len(least)
    doc_of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    inside = doc_of[:n] == doc_of[LENGTH - 1 :]
    fresh = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc_of[1:n] != doc_of[: n - 1])]
    starts = np.flatnonzero(fresh)
    counts = np.diff(np.r_[starts, n])
    real = inside[starts]
    starts, counts = starts[real], counts[real]
    if (counts > LONGEST).any():
        pieces = -(-counts // LONGEST)
        order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(counts, pieces) - order * LONGEST
        starts, counts = np.repeat(starts, pieces) + order * LONGEST, np.minimum(left, LONGEST)
    values = least[starts]
    # places that are the smallest of some window, and whether a segment has two of its own
    pad = np.full(WINDOW - 1, 0, np.uint64)
    most = _sliding(np.r_[pad, least, pad], WINDOW, np.maximum)
    chosen = np.flatnonzero(grams == most[: len(grams)])
    twin = np.r_[grams[chosen[1:]] == grams[chosen[:-1]], False]
    at = np.searchsorted(chosen, starts)
    until = np.searchsorted(chosen, starts + counts + WINDOW - 2, side="right")
    twins = np.r_[0, np.cumsum(twin)]
    tied = twins[np.maximum(until - 1, at)] - twins[at] > 0
    last = starts + counts - 1 + LENGTH - GRAM
    content = mixed(counts.astype(np.uint64))
    for offset in range(0, int(counts.max(initial=0)) + LENGTH, GRAM):
        place = np.minimum(starts + offset, last)
        content = np.where(starts + offset - GRAM < last, mixed(content * _MUL + grams[place]), content)
    return values, content, starts, counts, tied


def _numbered(docs: DataFrame, others: Column | None = None) -> DataFrame:
    """(doc_id, copy, text, others); ``copy`` tells rows with equal ids apart."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *([others.alias("others")] if others is not None else []),
    )
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.withColumn("copy", F.lit(0))
    same = Window.partitionBy("doc_id").orderBy("text")
    return rows.withColumn("copy", F.row_number().over(same) - 1)


SEGMENTS = "gram long, content long, doc_id long, copy int, start int, windows int, known int"


def list_segments(rows: DataFrame) -> DataFrame:
    """All segments; ``known`` is 1 for repeats within a chunk, 2 for tied ones, else 0."""

    def make(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts = byte_rows(batch.column(1))
        for a, b in groups_of([len(t) for t in texts], CHUNK):
            ends = np.cumsum([len(t) for t in texts[a:b]])
            grams, contents, starts, counts, tied = segments(b"".join(texts[a:b]), ends)
            if not len(starts):
                continue
            doc = np.searchsorted(ends, starts, side="right")
            ids = pa.compute.fill_null(batch.column(0), -(1 << 63)).to_numpy(False)[a:b][doc]
            copies = batch.column(2).to_numpy(False)[a:b][doc]
            starts = starts - np.r_[0, ends][doc]
            known = np.where(tied, 2, 0)
            order = np.lexsort((starts, copies, ids, contents, grams))
            again = (grams[order][1:] == grams[order][:-1]) & (contents[order][1:] == contents[order][:-1])
            later = order[1:][again]
            known[later] = 1
            # settled rows need not meet their gram's others: spread them
            grams[later] = mixed(ids[later].astype(np.uint64) * _MUL + starts[later].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams.view(np.int64)),
                    pa.array(contents.view(np.int64)),
                    pa.array(ids),
                    pa.array(copies, pa.int32()),
                    pa.array(starts, pa.int32()),
                    pa.array(counts, pa.int32()),
                    pa.array(known, pa.int32()),
                ],
                ["gram", "content", "doc_id", "copy", "start", "windows", "known"],
            )

    return rows.select("doc_id", "text", "copy").mapInArrow(over_batches(make), SEGMENTS)


def _judged(found: DataFrame, crowd: int) -> DataFrame:
    """Segments that repeat (verdict 1), or are first among different contents: 2, in crowds 3."""
    gram = Window.partitionBy("gram")
    equal = Window.partitionBy("gram", "content").orderBy("doc_id", "copy", "start")
    dealt = found.repartition("gram")
    ranked = dealt.withColumn("nth", F.row_number().over(equal)).withColumns(
        {
            "low": F.min("content").over(gram),
            "high": F.max("content").over(gram),
            "firsts": F.sum((F.col("nth") == 1).cast("int")).over(gram),
        }
    )
    verdict = (
        F.when((F.col("known") == 1) | (F.col("nth") > 1), 1)
        .when(F.col("firsts") > crowd, 3)
        .when((F.col("low") != F.col("high")) | (F.col("known") == 2), 2)
        .otherwise(0)
    )
    return ranked.withColumn("verdict", verdict).filter("verdict > 0").select(
        "gram", "doc_id", "copy", "start", "windows", "verdict"
    )


class Shard:
    """The Burrows-Wheeler transform of a cyclic text over symbols of ``width`` bytes."""

    def __init__(self, text: np.ndarray, codes: np.ndarray, width: int):
        self.order = suffix_order(text)
        self.symbols = codes[self.order - width]


def cyclic_grams(text: np.ndarray, width: int) -> np.ndarray:
    wide = np.concatenate([text, np.resize(text, width)]).astype(np.uint32)
    grams = np.zeros(len(text), np.uint32)
    for i in range(width):
        grams = (grams << np.uint32(8)) | wide[i : i + len(text)]
    return grams


def make_shards(texts: list[np.ndarray]) -> tuple[list[Shard], int]:
    """Shards with common symbols: four bytes if their codes fit 16 bits, else two."""
    codes, width = np.concatenate([cyclic_grams(t, 4) for t in texts]), 4
    known, codes = np.unique(codes, return_inverse=True)
    if len(known) > 1 << 16:
        codes, width = np.concatenate([cyclic_grams(t, 2) for t in texts]), 2
    codes, at, made = codes.astype(np.uint16), 0, []
    for t in texts:
        made.append(Shard(t, codes[at : at + len(t)], width))
        at += len(t)
    return made, width


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a cyclic text, by doubling what is not yet settled."""
    n = len(text)
    wide = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    depth = 8
    while depth < 2 * n:
        alone = fresh & np.r_[fresh[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        some, group = order[slots], first[slots]
        follower = rank[(some + depth) % n]
        inner = np.argsort(group * n + follower)
        some, follower = some[inner], follower[inner]
        order[slots] = some
        split = np.r_[True, (follower[1:] != follower[:-1]) | (group[1:] != group[:-1])]
        fresh[slots] = split
        first[slots] = np.maximum.accumulate(np.where(split, slots, 0))
        rank[some] = first[slots]
        depth *= 2
    return order


def merge_transforms(
    shards: list[Shard], width: int, depth: int = LENGTH
) -> tuple[np.ndarray, np.ndarray]:
    """The interleaving (shard of each slot, rank within the shard) of several transforms.

    Round t leaves the slots in the order of their first ``width`` t bytes. A stable ordering of the
    slots by their preceding symbols carries each slot to the suffix that begins with it.
    """
    sizes = [len(s.order) for s in shards]
    offset = np.cumsum([0, *sizes])
    symbols = np.concatenate([s.symbols for s in shards])
    weave = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    rank = np.empty(len(weave), np.int64)

    def count() -> None:
        for s in range(len(shards)):
            rank[weave == s] = np.arange(offset[s], offset[s + 1])

    for _ in range(-(-depth // width) if len(shards) > 1 else 0):
        count()
        moved = weave[np.argsort(symbols[rank], kind="stable")]
        if np.array_equal(moved, weave):
            break
        weave = moved
    count()
    return weave, rank - offset[weave]


def repeated_windows(texts: list[bytes], owner: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Which windows of some segments an earlier one of them holds.

    ``owner`` orders the segments by place. The result has one flag per byte of the
    concatenated segments, for the windows that begin there.
    """
    sizes = [len(t) + 1 for t in texts]
    begin = np.cumsum([0, *sizes])
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    bounds = list(groups_of(sizes, shard_bytes))
    shards, width = make_shards([data[begin[a] : begin[b]] for a, b in bounds])
    bases = [begin[a] for a, _ in bounds]
    weave, rank = merge_transforms(shards, width)
    place = np.empty(len(data), np.int64)
    for s, shard in enumerate(shards):
        mine = weave == s
        place[mine] = shard.order[rank[mine]] + bases[s]
    segment = np.repeat(np.arange(len(texts)), sizes)
    valid = place + LENGTH < begin[segment[place] + 1]
    place = place[valid]
    same = _agree(data, place[:-1], place[1:])
    group = np.cumsum(np.r_[True, ~same]) if len(place) else place
    # the earliest window of a repeated interval stays
    when = owner[segment[place]] * np.int64(1 << 20) + (place - begin[segment[place]])
    earliest = np.full(int(group[-1]) + 1 if len(group) else 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, group, when)
    flags = np.zeros(len(data), bool)
    flags[place[when > earliest[group]]] = True
    return flags


def _agree(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows at two places have all ``LENGTH`` bytes in common."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(data)]
    same = np.ones(len(a), bool)
    alive = np.arange(len(a))
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        equal = words[a[alive] + at] == words[b[alive] + at]
        same[alive[~equal]] = False
        alive = alive[equal]
    return same


def _cut(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of segments: (gram, doc_id, copy, start, body)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                some = batch.slice(at, 50)
                ids, copies, lists = (some.column(i).to_pylist() for i in (0, 1, 3))
                out: list[list] = [[], [], [], [], []]
                for doc_id, copy, text, found in zip(ids, copies, byte_rows(some.column(2)), lists):
                    for s in found:
                        begin = s["start"]
                        row = (s["gram"], doc_id, copy, begin, text[begin : begin + s["windows"] + LENGTH - 1])
                        for column, value in zip(out, row):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)], ["gram", "doc_id", "copy", "start", "body"]
                )

    # a document's list is no longer than the document
    lists = wanted.groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("gram", "start", "windows")).alias("found")
    )
    joined = _with_sentinel(rows).join(lists, ["doc_id", "copy"]).select("doc_id", "copy", "text", "found")
    return joined.mapInArrow(run, "gram long, doc_id long, copy int, start int, body binary")


def _with_sentinel(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))


SPANS = "doc_id long, copy int, start int, windows int"


def _by_transform(bodies: DataFrame, block_bytes: int) -> DataFrame:
    """Repeated windows among segments of one gram, as runs (doc_id, copy, start, windows)."""

    def judge(columns: list[list]) -> pa.RecordBatch:
        grams, ids, copies, starts, texts = columns
        places = np.array(list(zip(ids, copies, starts)), np.int64).reshape(-1, 3)
        order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
        owner = np.empty(len(order), np.int64)
        owner[order] = np.arange(len(order))
        flags = repeated_windows(texts, owner)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
        firsts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        segment = np.searchsorted(begin, firsts, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(places[segment, 0]),
                pa.array(places[segment, 1], pa.int32()),
                pa.array(places[segment, 2] + firsts - begin[segment], pa.int32()),
                pa.array(ends - firsts, pa.int32()),
            ],
            ["doc_id", "copy", "start", "windows"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    # a block ends where a gram ends
                    if size >= block_bytes and row[0] != held[0][-1]:
                        yield judge(held)
                        held, size = [[], [], [], [], []], 0
                    for column, value in zip(held, row):
                        column.append(value)
                    size += len(row[4]) + 1
        if size:
            yield judge(held)

    dealt = bodies.repartition("gram").sortWithinPartitions("gram", "doc_id", "copy", "start")
    return dealt.select("gram", "doc_id", "copy", "start", "body").mapInArrow(run, SPANS)


def _by_window(bodies: DataFrame) -> DataFrame:
    """The same for grams with very many contents: each window by a hash of its 100 bytes."""
    place = F.explode(F.sequence(F.lit(0), F.octet_length("body") - LENGTH)).alias("at")
    windows = bodies.select("doc_id", "copy", "start", "body", place).select(
        "doc_id",
        "copy",
        (F.col("start") + F.col("at")).cast("int").alias("start"),
        F.sha2(F.substring("body", F.col("at") + 1, F.lit(LENGTH)), 256).alias("_w"),
    )
    # the first place of a window is an aggregate; the join back is split where one is frequent
    first = windows.groupBy("_w").agg(F.min(F.struct("doc_id", "copy", "start")).alias("_first"))
    again = windows.join(first, "_w").filter(F.struct("doc_id", "copy", "start") != F.col("_first"))
    return again.select("doc_id", "copy", "start", F.lit(1).alias("windows"))


def repeated_spans(rows: DataFrame, *, crowd: int = CROWD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs of repeated windows (doc_id, copy, start, windows) of numbered rows."""
    judged = stored(_judged(list_segments(rows), crowd), "segments")
    sure = judged.filter("verdict = 1").select("doc_id", "copy", "start", "windows")
    merged = _by_transform(_cut(rows, judged.filter("verdict = 2")), block_bytes)
    found = sure.unionByName(merged)
    crowded = judged.filter("verdict = 3")
    if not crowded.isEmpty():
        found = found.unionByName(_by_window(_cut(rows, crowded)))
    return found


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(rows: DataFrame, spans: DataFrame, keep: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                some = batch.slice(at, 50)
                out: list[list] = [[], [], [], [], []]
                for text, found in zip(byte_rows(some.column(2)), some.column(3).to_pylist()):
                    gone: list[list[int]] = []
                    for s in sorted(found or [], key=lambda s: s["start"]):
                        begin, end = s["start"], s["start"] + s["windows"] + LENGTH - 1
                        if gone and begin <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], end)
                        else:
                            gone.append([begin, end])
                    parts, last = [], 0
                    for begin, end in gone:
                        parts.append(text[last:begin])
                        last = end
                    kept = b"".join([*parts, text[last:]])
                    digest = hashlib.sha256(kept).hexdigest()
                    removed = len(text) - len(kept)
                    if removed and keep:
                        # a cut through a character leaves bytes that are none; they are dropped
                        kept = kept.decode("utf-8", "ignore").encode()
                    row = (len(text), removed, len(gone), digest, kept if keep else None)
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [*map(some.column, through), *(pa.array(c, k) for c, k in zip(out, kinds))],
                    [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    names = ["doc_id", "copy", *[c for c in rows.columns if c == "others"]]
    through = [0, 1, *range(4, 2 + len(names))]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    lists = spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    joined = _with_sentinel(rows).join(lists, ["doc_id", "copy"], "left")
    ordered = joined.select("doc_id", "copy", "text", "found", *[c for c in names if c == "others"])
    made = ordered.mapInArrow(run, f"{kinds}, {RESULT}")
    return made.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))


def remove_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """Per row doc_id, copy, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _numbered(docs)
    return _removed(rows, repeated_spans(rows, **options), False).drop("kept")


def without_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; every other column stays."""
    rows = _numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    made = _removed(rows, repeated_spans(rows.drop("others"), **options), True)
    return made.withColumn("text", F.col("kept").cast("string")).select("others.*", "text").select(docs.columns)
