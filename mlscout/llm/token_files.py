"""Token ids as Arrow files of fixed-size-list batches.

A table is range-partitioned by document id; each partition writes one pair of files in the
shared folder. ``<name>.arrow`` holds sequences of one length (``ids``: fixed-size list of
uint16, or of uint32 for a vocabulary beyond 65,536; ``mask``: fixed-size list of bits, 0 on
the padding of a file's last sequence), so sequence i is a slice of one buffer and is reached
without decoding what lies before it. ``<name>.docs.arrow`` holds (doc_id, start, n_tokens)
in id order. The task returns one manifest row; files of failed or repeated attempts have
other names and are never read.

Null and empty texts have the end id alone. Repeated rows are written once each, and rows of
one id (or of none) are ordered by a hash of their text, so that they need not be one file. A
very long text is held whole by one task. Other columns, whatever their names, are not read.
A table without rows writes no tokens.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlscout.llm.common import Memo, byte_rows, file_system, groups_of, kept, shared_folder, spread_evenly, stored

SEQUENCE = 2048
WORDS = 2_000_000  # that a Python worker remembers, in some 300 MB
SEQUENCES_PER_BATCH = 256
PROBE = "An ox, it's 2 \u00e9t\u00e9 ON \u6f22\u5b57 end.".encode()  # tries how a tokenizer treats blanks
DOCS_PER_BATCH = 4096
MANIFEST = "part int, path string, n_docs long, n_tokens long"


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, word by word.

    Such a tokenizer never joins characters across white space, so the ids of a text are
    those of its words; frequent words are remembered. Others are refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if not self._drops_blanks():
            raise ValueError(f"{path} keeps white space, so its words cannot be encoded apart")
        # capitals can be folded before a word is looked up if the tokenizer folds them itself
        self.folds = self._raw(PROBE.lower()) == self._raw(PROBE) and self._lower_cases()
        self.words: Memo = Memo(self._raw, WORDS)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        return kept((cls, path), lambda: cls(path))

    def _raw(self, word: bytes) -> bytes:
        found = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False)
        return array(self.kind.char, found.ids).tobytes()

    def _drops_blanks(self) -> bool:
        """Whether blanks of each kind, before, between and after words, leave no trace."""
        apart = b"".join(map(self._raw, PROBE.split()))
        blanks = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"  ", b" \n\n "]
        return all(self._raw(x + x.join(PROBE.split()) + x) == apart for x in blanks)

    def _lower_cases(self) -> bool:
        """Whether lower-casing is a step of the tokenizer's own normaliser."""
        normaliser = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        steps = normaliser.get("normalizers", [normaliser])
        return any(x.get("type") == "Lowercase" for x in steps)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; words not met before are encoded together."""
        known = self.words
        # at the six ASCII blanks; other white space stays inside a word
        split = [(t.lower() if self.folds and t.isascii() else t).split() for t in texts]
        found = [list(map(known.get, ws)) for ws in split]
        missed = set()
        for ws, ids in zip(split, found):
            if None in ids:
                missed.update(w for w, x in zip(ws, ids) if x is None)
        older = known.older
        new = [w for w in missed if w not in older]
        made = {w: older[w] for w in missed if w in older}
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            encoded = self.tokenizer.encode_batch_fast(
                [w.decode("utf-8", "replace") for w in some], add_special_tokens=False
            )
            code = self.kind.char
            made |= {w: array(code, e.ids).tobytes() for w, e in zip(some, encoded)}
        known.remember(made)
        for i, ids in enumerate(found):
            if None in ids:
                found[i] = [made[w] if x is None else x for w, x in zip(split[i], ids)]
        return [np.frombuffer(b"".join(ids), self.kind) for ids in found]


def sequence_schema(length: int, kind: np.dtype) -> pa.Schema:
    number = pa.from_numpy_dtype(kind)
    return pa.schema([("ids", pa.list_(number, length)), ("mask", pa.list_(pa.bool_(), length))])


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class PairWriter:
    """Writes one pair of files; memory is bounded by a batch of sequences and one document."""

    def __init__(self, folder: str, length: int, kind: np.dtype):
        self.path = f"{folder}/{uuid.uuid4().hex}"
        self.length, self.kind = length, kind
        system, inner = file_system(self.path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.sinks = [system.open_output_stream(inner + end) for end in (".arrow", ".docs.arrow")]
        self.sequences = pa.ipc.new_file(self.sinks[0], sequence_schema(length, kind))
        self.docs = pa.ipc.new_file(self.sinks[1], DOC_SCHEMA)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = self.n_docs = 0
        self.rows: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.n_docs += 1
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * SEQUENCES_PER_BATCH:
            self._sequences(False)
        if len(self.rows) >= DOCS_PER_BATCH:
            self._docs()

    def _sequences(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        # batches within a file have equal length, so that a place tells its batch
        step = self.length * (1 if last else SEQUENCES_PER_BATCH)
        full = len(flat) // step * step
        body, rest = flat[:full], flat[full:]
        mask = np.ones(full, bool)
        if last and len(rest):
            gap = self.length - len(rest)
            body = np.concatenate([body, rest, np.zeros(gap, self.kind)])
            mask = np.concatenate([mask, np.ones(len(rest), bool), np.zeros(gap, bool)])
            rest = rest[:0]
        self.held, self.n_held = [rest.copy()], len(rest)
        step = self.length * SEQUENCES_PER_BATCH
        for at in range(0, len(body), step):
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(x[at : at + step]), self.length)
                for x in (body, mask)
            ]
            self.sequences.write_batch(
                pa.RecordBatch.from_arrays(lists, schema=sequence_schema(self.length, self.kind))
            )

    def _docs(self) -> None:
        columns = [pa.array(c, pa.int64()) for c in zip(*self.rows)] if self.rows else None
        if columns:
            self.docs.write_batch(pa.RecordBatch.from_arrays(columns, schema=DOC_SCHEMA))
        self.rows = []

    def close(self) -> None:
        self._sequences(True)
        self._docs()
        for x in (self.sequences, self.docs, *self.sinks):
            x.close()


def write(
    df: DataFrame, tokenizer: str, *, end_id: int = 1, length: int = SEQUENCE, key: str = "doc_id"
) -> DataFrame:
    """Write the table's ids in ascending ``key`` order and return the manifest.

    Manifest: part (file order), path, n_docs, n_tokens. Only texts are shuffled, once.
    """
    folder = shared_folder(df.sparkSession, "tokens")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(tokenizer)
        kind = words.kind if end_id <= np.iinfo(words.kind).max else np.dtype("<u4")
        end = np.array([end_id], kind)
        writer = part = None
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            for a, b in groups_of(sizes.to_pylist()):
                some = batch.slice(a, b - a)
                part = some.column(2)[0].as_py()
                writer = writer or PairWriter(folder, length, kind)
                found = words.encode(byte_rows(some.column(1)))
                for doc_id, ids in zip(some.column(0).to_pylist(), found):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer:
            writer.close()
            columns = [[part], [writer.path], [writer.n_docs], [writer.total]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "path", "n_docs", "n_tokens"]
            )

    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    rows = rows.withColumn("_h", F.xxhash64("text"))
    spread = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    numbered = spread.withColumn("part", F.spark_partition_id())
    return stored(numbered.mapInArrow(run, MANIFEST), "manifest")


def with_offsets(manifest: DataFrame) -> DataFrame:
    """Add ``offset``, the tokens in all files before; one row per file, so one small window."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class SequenceFile:
    """Random access to the sequences of one file; local files are memory-mapped."""

    def __init__(self, path: str):
        system, inner = file_system(path + ".arrow")
        local = type(system).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(inner) if local else system.open_input_file(inner)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        # all batches but the last have this many sequences
        self.per_batch = max(1, self.reader.get_batch(0).num_rows) if self.reader.num_record_batches else 1
        self._at: tuple[int, np.ndarray] | None = None

    def _batch(self, i: int) -> np.ndarray:
        if self._at is None or self._at[0] != i:
            self._at = (i, self.reader.get_batch(i).column(0).flatten().to_numpy())
        return self._at[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """Tokens ``start`` to ``start + n`` of the file; inner batches have equal length."""
        step = self.length * self.per_batch
        parts = []
        while n > 0:
            i, at = divmod(start, step)
            part = self._batch(i)[at : at + n]
            if not len(part):
                raise EOFError("the file ends before the tokens asked for")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence i, a view of the file, and its mask, unpacked from bits."""
        batch, row = divmod(i, self.per_batch)
        found = self.reader.get_batch(batch)
        ids, mask = (found.column(c)[row].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = SequenceFile(row["path"])
                system, inner = file_system(row["path"] + ".docs.arrow")
                with system.open_input_file(inner) as source:
                    reader = pa.ipc.open_file(source)
                    for i in range(reader.num_record_batches):
                        docs = reader.get_batch(i)
                        starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        sums = [
                            zlib.crc32(np.ascontiguousarray(file.ids(s, n), "<u4"))
                            for s, n in zip(starts.tolist(), counts.tolist())
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [
                                docs.column(0),
                                pa.array(starts + row["offset"]),
                                docs.column(2),
                                pa.array(sums, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # a few files per task: rows of paths are too small for Spark to tell how many tasks to use
    dealt = spread_evenly(with_offsets(manifest), manifest.count(), "path")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
