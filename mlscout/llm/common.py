"""What several operators share: stored tables, bounded chunks of text, word hashes, files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlscout.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20  # text that one vectorised step works on
WORD_CACHE = 150_000  # words a Python worker remembers


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of a write once the table is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when the table is there."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut in columnar form.

    What comes after reads the table, so the shuffles behind it are not kept on the disks.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def apart(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds and however it is named."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def spread_evenly(df: DataFrame, n_rows: int, *columns: str) -> DataFrame:
    """Deal out rows that are small but stand for much work, in a number of tasks that stays.

    Spark folds partitions together by their bytes, which for paths or ranges says nothing.
    Each row is a task while the rows are few, and some sixteen share one beyond that.
    """
    few = 8 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n_rows, max(few, n_rows // 16))), *columns)


def utf8_text(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def file_system(uri: str):
    """The file system of a URI or local path, and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def groups_of(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` in total size, one row at least."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield begin, len(sizes)


def over_batches(
    make: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands ``make`` slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index("text"))
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(False)
            for a, b in groups_of(sizes.tolist()):
                made = make(batch.slice(a, b - a))
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made

    return run


def byte_rows(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, empty for null."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """A bounded memo of a pure function: of the older half, only what is used again stays."""

    def __init__(self, make: Callable, limit: int = WORD_CACHE):
        super().__init__()
        self.make, self.half, self.older = make, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self._age()
        self[key] = value
        return value

    def remember(self, found: dict) -> None:
        if len(self) >= self.half:
            self._age()
        self.update(found)

    def _age(self) -> None:
        self.older = dict(self)
        self.clear()


_kept: dict = {}


def kept(key: Hashable, make: Callable):
    """What this Python worker has made for a key. Only that of the last key stays.

    A worker serves one step after another, and what it remembered for one is of no use to the next.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LONG_WORD = 64  # bytes; longer words are hashed one by one
_SPAN = 1 << 14  # bytes whose words are hashed together
_BASE = 0x9E3779B97F4A7C15  # 5 modulo 8: its powers stay apart


def _tables() -> tuple[np.ndarray, ...]:
    """By byte: whether it is a blank, and a number, the same for A-Z and a-z. By place: powers and their inverses."""
    kinds = np.arange(256)
    blank = np.isin(kinds, [0x20, *range(0x09, 0x0E)])
    lower = np.where((kinds >= 0x41) & (kinds <= 0x5A), kinds + 32, kinds).astype(np.uint64)
    ones = np.ones(_SPAN + LONG_WORD, np.uint64)
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        ones[1:] = np.uint64(base)
        powers.append(np.cumprod(ones))
    return blank, mixed(mixed(lower + np.uint64(0xC2B2AE3D27D4EB4F))), *powers


_BLANK, _NUMBER, _POWER, _BACK = _tables()


def hashed_words(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

    A word is a polynomial of its bytes' numbers modulo 2 ** 64, taken from running sums over the
    text. Words that differ in one byte or in two bytes swapped never share a hash, others only by
    chance. That weakens with the length, so words beyond ``LONG_WORD`` bytes get their XXH3.
    """
    return _located_words(text)[1]


def words_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts, one after another, and where those of each begin and end."""
    start, words = _located_words(b" ".join(texts))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(start, begin)


def _located_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes."""
    flat = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(flat) + 2, bool)
    np.logical_not(_BLANK[flat], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    out = np.empty(len(start), np.uint64)
    for base in range(0, len(flat), _SPAN):
        own = slice(*np.searchsorted(start, [base, base + _SPAN]))
        some = _NUMBER[flat[base : base + _SPAN + LONG_WORD]]
        some *= _POWER[: len(some)]
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some, out=sums[1:])
        first = start[own] - base
        last = np.minimum(end[own] - base, len(some))
        out[own] = (sums[last] - sums[first]) * _BACK[first]
    size = end - start
    out = mixed(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]].lower())
    return start, out


_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
        0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one, none make none."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * np.uint64(_ODD[j % 8] + 2 * (j // 8))
    return np.unique(mixed(total))


def shingle_sets_of(texts: Sequence[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of several texts, one after another, and where each begins and ends."""
    words, ends = words_of(texts)
    counts = np.diff(ends)
    if not len(words):
        return words, np.zeros(len(texts) + 1, np.int64)
    total = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for j in range(size):
        total += words[j : j + len(total)] * np.uint64(_ODD[j % 8] + 2 * (j // 8))
    found = mixed(total)
    sets = []
    for begin, n in zip(ends.tolist(), counts.tolist()):
        if n >= size:
            own = found[begin : begin + n - size + 1]
            own.sort()  # texts have places of their own
            sets.append(own)
        else:
            sets.append(shingle_set(words[begin : begin + n], size))
    starts = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets)
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[starts[:-1][starts[:-1] < len(flat)]] = True
    return flat[fresh], np.r_[0, np.cumsum(fresh)][starts]


def counted_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word hashes of several texts, sorted within a text, how often each is there, and
    where those of each text begin and end."""
    words, ends = words_of(texts)
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        words[begin:end].sort()
    fresh = np.ones(len(words) + 1, bool)
    fresh[1:-1] = words[1:] != words[:-1]
    fresh[ends] = True
    starts = np.flatnonzero(fresh)
    return words[starts[:-1]], np.diff(starts), np.searchsorted(starts, ends)
