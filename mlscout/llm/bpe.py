"""Byte-level BPE as a lazily determinised transducer, and its streaming inverse.

The merges are compiled, not replayed. A sequence of tokens is the encoding of its bytes
exactly when every two neighbours may stand beside each other, that is when no merge
across their border comes before the merges that built them. So the nondeterministic
transducer walks a trie of all tokens and may cut wherever a token ends that fits the token
before it. Determinised, a state is the list of open cuts, each with its place in the trie
and the token before it; states and arcs are made when first met. Each prefix of a text has
one encoding, whose last token the state tells, so the tokens are read off backwards; what
all open cuts agree on is final and emitted. A cut stays open for the longest token at most,
which bounds the lookahead.

Null texts count as empty, empty texts have no tokens, and repeated rows repeat.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.llm.common import Memo, byte_rows, kept, over_batches

MAX_STATES = 150_000  # states kept before the lazy construction starts afresh
WORDS = 500_000  # words and pieces remembered
EMIT_BYTES = 4096  # bytes after which a long piece emits what is final
DECODE_CHUNK = 4096  # ids that the streaming decoder takes at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeTransducer:
    """The transducer of one vocabulary. ``encode`` takes the bytes of one piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._size = {i: len(t) for t, i in ranks.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merge: dict[tuple[int, int], int] = {}
        self._next: dict[int, int] = {}  # trie node * 256 + byte -> trie node
        self._token = [-1]
        self._inner = [False]
        self._depth = [0]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._replay(token, rank)
                if len(parts) != 2:
                    continue  # no merge makes it; only a piece equal to it yields it
                self._halves[rank] = (parts[0], parts[1])
                self._merge[parts[0], parts[1]] = rank
            self._insert(token, rank)
        self._spines = Memo(self._spine, 100_000)
        self._fit = Memo(self._may_follow, 100_000)
        self._restart()

    def _replay(self, token: bytes, below: int) -> list[int]:
        """The merges in order of rank, for the construction only."""
        parts = [self.ranks[bytes([b])] for b in token]
        while len(parts) > 2:
            found = [
                (self._merge[pair], i)
                for i, pair in enumerate(zip(parts, parts[1:]))
                if pair in self._merge
            ]
            if not found or min(found)[0] >= below:
                return parts
            rank, i = min(found)
            parts[i : i + 2] = [rank]
        return parts

    def _insert(self, token: bytes, rank: int) -> None:
        node = 0
        for b in token:
            self._inner[node] = True
            child = self._next.get(node << 8 | b)
            if child is None:
                child = self._next[node << 8 | b] = len(self._token)
                self._token.append(-1)
                self._inner.append(False)
                self._depth.append(self._depth[node] + 1)
            node = child
        self._token[node] = rank

    def _spine(self, key: tuple[int, int]) -> list[tuple[int, int]]:
        """The pieces at one border of a token, each with the merge that used it up."""
        token, side = key
        used, out = 1 << 62, []
        while True:
            out.append((token, used))
            if token not in self._halves:
                return out
            used, token = token, self._halves[token][side]

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        """Whether no merge takes place across the border of two tokens.

        Merges run in order of rank, the leftmost first among equals. A merge across the
        border takes place if it comes before both pieces are used up inside their tokens.
        """
        for x, x_used in self._spines[pair[0], 1]:
            for y, y_used in self._spines[pair[1], 0]:
                rank = self._merge.get((x, y))
                if rank is not None and rank < x_used and rank <= y_used:
                    return False
        return True

    def _restart(self) -> None:
        self._states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self._numbers = {self._states[0]: 0}
        self._last = [-1]  # by state: the last token of the encoding of what was read
        self._arcs = Memo(self._arc, 1 << 62)  # state * 256 + byte -> state

    def _arc(self, key: int) -> int:
        """The next state: every open cut moves down the trie, and exactly one cut is new."""
        byte = key & 255
        moved = []
        for node, last in self._states[key >> 8]:
            child = self._next.get(node << 8 | byte)
            if child is None:
                continue
            if self._inner[child]:
                moved.append((child, last))
            token = self._token[child]
            if token >= 0 and (last < 0 or self._fit[last, token]):
                newest = token
        moved.append((0, newest))
        state = tuple(moved)
        number = self._numbers.get(state)
        if number is None:
            number = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._last.append(newest)
        return number

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. What all open cuts share is emitted every ``EMIT_BYTES``."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > MAX_STATES:
            self._restart()
        out, state = [], 0
        path: list[int] = []  # states at the places after the emitted tokens
        for at in range(0, len(piece), EMIT_BYTES):
            if at:
                done = self._agreed(state, path)
                out += done
                del path[: sum(map(self._size.__getitem__, done))]
            arcs = self._arcs
            for byte in piece[at : at + EMIT_BYTES]:
                state = arcs[state << 8 | byte]
                path.append(state)
        return out + self._back(path, len(path))

    def _back(self, path: list[int], place: int) -> list[int]:
        tokens = []
        while place:
            tokens.append(self._last[path[place - 1]])
            place -= self._size[tokens[-1]]
        return tokens[::-1]

    def _agreed(self, state: int, path: list[int]) -> list[int]:
        """The tokens that every open cut starts with; no later byte can change them."""
        starts = [len(path) - self._depth[node] for node, _ in self._states[state]]
        agreed = self._back(path, starts[0])
        for start in starts[1:]:
            other = self._back(path, start)
            same = 0
            while same < min(len(agreed), len(other)) and agreed[same] == other[same]:
                same += 1
            agreed = agreed[:same]
        return agreed


class Utf8Machine:
    """Tells how many bytes at the end of a chunk begin a character that is not complete."""

    def __init__(self):
        self.lead = {b: (0, 0, 0) for b in range(0x80)}
        self.lead |= {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
        self.lead |= {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)}
        self.lead |= {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}
        # overlong forms, surrogates and values beyond the last code point
        self.lead |= {
            0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F),
            0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F),
        }

    def open_bytes(self, tail: bytes) -> int:
        tail = tail[-3:]
        for i, b in enumerate(tail):
            need, low, high = self.lead.get(b, (0, 0, 0))
            for c in tail[i + 1 :]:
                if not need or not low <= c <= high:
                    need = 0
                    break
                need, low, high = need - 1, 0x80, 0xBF
            if need:
                return len(tail) - i
        return 0


class StreamingDecoder:
    """Ids in, text out, chunk by chunk; a character split over chunks waits for its rest."""

    machine = Utf8Machine()

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes = token_bytes
        self.held = b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.token_bytes.__getitem__, ids))
        cut = len(data) - self.machine.open_bytes(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back. Pieces are matched by ``pattern`` and encoded apart."""

    # a blank between blanks: only there can splitting at blanks part a run of white space
    _run = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, pattern: str):
        self.transducer = MergeTransducer(read_ranks(path))
        self.pieces = regex.compile(pattern)
        self.piece_ids = Memo(self._piece, WORDS)
        self.after_blank = Memo(self._after_blank, WORDS)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """One codec per Python worker."""
        return kept((cls, path, pattern), lambda: cls(path, pattern))

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _after_blank(self, word: str) -> bytes:
        if word.isalpha():  # one piece, and in most texts a frequent one is remembered whole
            return self._piece(" " + word)
        return self._matched(" " + word)

    def _matched(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.pieces.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Every blank before a word begins a piece, so a text can be cut at its blanks and
        the parts remembered, unless blanks stand in longer runs of white space.
        """
        if not text or self._run.search(text):
            return self._matched(text)
        first, *rest = text.split(" ")
        return self._matched(first) + b"".join(map(self.after_blank.__getitem__, rest))

    def decode(self, ids: bytes) -> Iterator[str]:
        numbers = np.frombuffer(ids, "<u4")
        decoder = StreamingDecoder(self.transducer.bytes_of)
        for at in range(0, len(numbers), DECODE_CHUNK):
            yield decoder.feed(numbers[at : at + DECODE_CHUNK].tolist())
        yield decoder.finish()


def encode(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit) and ``n_tokens``; no shuffle.

    Existing columns of these names are replaced.
    """

    @F.pandas_udf("binary")
    def ids(texts):
        codec = Codec.of(path, pattern)
        return texts.map(lambda t: codec.encode(t or ""))

    return df.withColumn("ids", ids(F.coalesce(F.col(f"`{column}`"), F.lit("")))).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long")
    )


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of an id column; null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        codec = Codec.of(path, pattern)
        return ids.map(lambda i: None if i is None else "".join(codec.decode(i)))

    return df.withColumn("decoded", text(F.col(f"`{column}`")))


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass and return the digests of both.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, same (whether the text came back).
    """

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        rows: list[list] = [[], [], [], []]
        for raw in byte_rows(batch.column(1)):
            ids = codec.encode(raw.decode("utf-8", "replace"))
            back = hashlib.sha256()
            for part in codec.decode(ids):
                back.update(part.encode())
            rows[0].append(len(ids) // 4)
            rows[1].append(hashlib.sha256(ids).hexdigest())
            rows[2].append(back.hexdigest())
            rows[3].append(back.digest() == hashlib.sha256(raw).digest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows[0], pa.int64()), *map(pa.array, rows[1:])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean"
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(over_batches(digests), schema)
