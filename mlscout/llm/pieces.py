"""SentencePiece encoding that keeps offsets, and decoding.

The normaliser is this module's own: it reads the character map compiled into the model (a
double-array trie over UTF-8 bytes, then its replacement strings), replaces the longest key
at every place, and records for each normalised byte the original byte it came from. The
library then only cuts the normalised text into pieces, with a copy of the model whose own
normaliser is blank, and every piece is projected through the record to the bytes of the
original text it stands for. Decoding is the library's.

Null texts count as empty; empty texts have no tokens. Very long texts are one call each and
are never cut. Repeated rows and equal ids repeat. A table without rows gives none. The input
columns a function returns keep their names; columns called like a result (``ids``,
``begins``, ``ends``) are replaced by ``encode``, and ``round_trip`` reads only key and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlscout.llm.common import over_batches

SPACE = "▁".encode()  # the mark for a blank


class CharacterMap:
    """The longest-prefix replacements of a compiled character map.

    ``blob`` is a little-endian length, a double array of that many bytes whose leaves are
    offsets, and NUL-ended replacements at these offsets. ``kept`` strings stay as they are.
    """

    def __init__(self, blob: bytes, kept: Iterable[str] = ()):
        self.replace: dict[str, bytes] = {}
        if blob:
            size = int.from_bytes(blob[:4], "little")
            strings = blob[4 + size :]
            for key, at in self._leaves(np.frombuffer(blob[4 : 4 + size], "<u4")):
                self.replace[key.decode()] = strings[at : strings.index(b"\0", at)]
        self.kept = {k: k.encode() for k in kept if k}
        self.longest = max(map(len, self.replace), default=0)
        self.longest_kept = max(map(len, self.kept), default=0)
        self.place = self._places()

    @staticmethod
    def _leaves(units: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """Every key and its value, level by level through all nodes of a depth at once."""
        labels = np.arange(1, 256, dtype=np.uint32)

        def below(at: np.ndarray, unit: np.ndarray) -> np.ndarray:
            wide = (unit & np.uint32(1 << 9)) >> np.uint32(6)
            return at ^ ((unit >> np.uint32(10)) << wide)

        at = below(np.zeros(1, np.uint32), units[:1])
        keys = [b""]
        while len(at):
            children = at[:, None] ^ labels
            inside = children < len(units)
            unit = units[np.where(inside, children, 0)]
            row, label = np.nonzero(inside & ((unit & np.uint32(0x800000FF)) == labels))
            unit = unit[row, label]
            at = below(children[row, label], unit)
            keys = [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), label.tolist())]
            for i in np.flatnonzero((unit >> np.uint32(8)) & np.uint32(1)).tolist():
                yield keys[i], int(units[at[i]] & np.uint32(0x7FFFFFFF))

    def _places(self) -> re.Pattern | None:
        """Where a key may begin: a key of one character, or the first two of a longer one."""
        single, pairs = set(), {}
        for key in [*self.replace, *self.kept]:
            if len(key) == 1:
                single.add(key)
            else:
                pairs.setdefault(key[1], set()).add(key[0])
        if not single and not pairs:
            return None
        any_of = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        parts = [any_of(single)] if single else []
        if pairs:
            parts.append(any_of(set().union(*pairs.values())) + f"(?={any_of(pairs)})")
        return re.compile("|".join(parts))

    def longest_at(self, text: str, at: int) -> tuple[int, bytes] | None:
        """Characters and replacement of the longest key at a place; kept strings come first."""
        for keys, most in ((self.kept, self.longest_kept), (self.replace, self.longest)):
            for n in range(min(most, len(text) - at), 0, -1):
                found = keys.get(text[at : at + n])
                if found is not None:
                    return n, found
        return None

    def chunks(self, text: str) -> Iterator[tuple[str, bytes | None]]:
        """The text cut into (original, replacement), None where characters stay."""
        done = at = 0
        while self.place:
            match = self.place.search(text, at)
            if not match:
                break
            found = self.longest_at(text, match.start())
            if found is None:
                at = match.start() + 1
                continue
            if match.start() > done:
                yield text[done : match.start()], None
            done = at = match.start() + found[0]
            yield text[match.start() : done], found[1]
        if done < len(text):
            yield text[done:], None


class Normaliser:
    """Normalised bytes of a text, with the original byte of each."""

    def __init__(self, chars: CharacterMap, *, prefix: bool, squeeze: bool, escape: bool, suffix: bool):
        self.chars = chars
        self.prefix, self.squeeze, self.escape, self.suffix = prefix, squeeze, escape, suffix

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised, origin): byte i comes from ``origin[i]``; the last entry is the end."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.chars.place is None and not self.squeeze:
            body = text.encode()
            n, first = len(body), 0
            origin = np.arange(n, dtype=np.int64)
        else:
            body, origin, first, n = self._replaced(text)
            if first == n:
                return b"", np.array([n], np.int64)
        mark = SPACE if self.escape else b" "
        if self.escape and b" " in body:
            origin = np.repeat(origin, np.where(np.frombuffer(body, np.uint8) == 32, len(SPACE), 1))
            body = body.replace(b" ", SPACE)
        if self.prefix:
            more = np.full(len(mark), n if self.suffix else first, np.int64)
            body, origin = (
                (body + mark, np.append(origin, more)) if self.suffix else (mark + body, np.append(more, origin))
            )
        end = n
        if self.squeeze and not (self.suffix and self.prefix):
            while body.endswith(mark):
                body = body[: -len(mark)]
                end = int(origin[len(body)])
                origin = origin[: len(body)]
        return body, np.append(origin, end)

    def _replaced(self, text: str) -> tuple[bytes, np.ndarray, int, int]:
        """Replacements made, and blanks after blanks dropped where the model asks for it."""
        bodies, origins, before, n, first = [], [], [], 0, 0
        skipping, made = self.squeeze, 0
        for original, new in self.chars.chunks(text):
            raw = original.encode()
            body = raw if new is None else new
            at = np.arange(made, made + len(body), dtype=np.int64)
            if new is None:
                origins.append(np.arange(n, n + len(raw), dtype=np.int64))
                before.append(at - 1)  # each character is asked for the blank before it
                lead = len(raw) - len(raw.lstrip(b" "))
                first += lead if skipping else 0
                skipping = skipping and lead == len(raw)
            else:
                origins.append(np.full(len(body), n, np.int64))
                lead = len(body) - len(body.lstrip(b" "))
                before.append(np.where(at < made + lead, made - 1, -2))
                skipping = skipping and body == b" "
                first += len(raw) if skipping else 0
            bodies.append(body)
            made, n = made + len(body), n + len(raw)
        body, origin = b"".join(bodies), np.concatenate(origins)
        if self.squeeze and b" " in body:
            bytes_, before = np.frombuffer(body, np.uint8), np.concatenate(before)
            after_blank = (before == -1) | ((before >= 0) & (bytes_[np.maximum(before, 0)] == 32))
            stays = ~((bytes_ == 32) & after_blank)
            body, origin = bytes_[stays].tobytes(), origin[stays]
        return body, origin, first, n


class Pieces:
    """One model: normaliser, a library that only cuts, and the byte length of every piece."""

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            raw = file.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        spec, piece = model.normalizer_spec, proto.ModelProto.SentencePiece
        kept = [p.piece for p in model.pieces if p.type == piece.USER_DEFINED]
        self.normalise = Normaliser(
            CharacterMap(spec.precompiled_charsmap, kept),
            prefix=spec.add_dummy_prefix,
            squeeze=spec.remove_extra_whitespaces,
            escape=spec.escape_whitespaces,
            suffix=model.trainer_spec.treat_whitespace_as_suffix,
        )
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.unknown = self.cutter.unk_id()
        self.size = np.array(
            [1 if p.type == piece.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64
        )
        self.decimal = [str(i) for i in range(len(model.pieces))]

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and where each piece begins and ends in the UTF-8 bytes of the text."""
        body, origin = self.normalise(text)
        ids = self.cutter.encode(body.decode(), out_type=int, num_threads=1)
        if self.unknown in ids:  # an unknown piece has the length of what it stands for
            found = self.cutter.encode(body.decode(), return_type="proto", num_threads=1)
            ends = np.array([p.end for p in found.pieces], np.int64)
        else:
            ends = np.cumsum(self.size[np.array(ids, np.int64)])
        if len(ends) and ends[-1] != len(body):
            raise ValueError("the pieces do not cover the normalised text")
        borders = origin[np.append(0, ends)] if len(ends) else np.zeros(1, np.int64)
        return ids, borders[:-1], borders[1:]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if ids else ""


def _texts(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def encode(df: DataFrame, model: str, *, column: str = "text") -> DataFrame:
    """Add ``ids`` and the original byte spans ``begins`` and ``ends`` of every piece."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = Pieces.of(model)
        made = [pieces.encode(t) for t in _texts(batch.column(batch.num_columns - 1))]
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
        arrays.append(pa.array([m[0] for m in made], pa.list_(pa.int32())))
        arrays += [pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in (1, 2)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    others = [c for c in df.columns if c not in ("ids", "begins", "ends")]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{column}`").cast("string").alias("text")
    )
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            rows.schema["row"],
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("begins", longs),
            T.StructField("ends", longs),
        ]
    )
    return rows.mapInArrow(over_batches(make), schema).select("row.*", "ids", "begins", "ends")


def decode(df: DataFrame, model: str) -> DataFrame:
    """Add ``decoded``, the text of the column ``ids``; null ids give an empty text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    others = [c for c in df.columns if c != "decoded"]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(make, schema).select("row.*", "decoded")


ROUND_TRIP = (
    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, lossless boolean"
)


def round_trip(df: DataFrame, model: str, *, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Digests of the ids, of their spans and of the decoded text, one row per row.

    ``spans_sha256`` is that of all begins, then all ends, as little-endian 64-bit integers;
    ``lossless`` tells whether decoding gave the text back.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = Pieces.of(model)
        counts, ids_sha, text_sha, span_sha, same = [], [], [], [], []
        for text in _texts(batch.column(1)):
            ids, begins, ends = pieces.encode(text)
            decoded = pieces.decode(ids)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(pieces.decimal.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            spans = hashlib.sha256(begins.astype("<i8").tobytes())
            spans.update(ends.astype("<i8").tobytes())
            span_sha.append(spans.hexdigest())
            same.append(decoded == text)
        arrays = [
            batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
            pa.array(text_sha, pa.string()), pa.array(span_sha, pa.string()), pa.array(same, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(
            arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "lossless"]
        )

    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("text")
    )
    return rows.mapInArrow(over_batches(make), ROUND_TRIP)
