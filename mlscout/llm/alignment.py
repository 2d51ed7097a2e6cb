"""Two tokenizers aligned on the bytes of each text, with corpus-wide counts of linked ids.

Tokenizer A is a byte-level BPE of the tokenizers library, B a model of the sentencepiece
library. The character offsets of A and the byte spans of B are coarse cuts; where a
character is split over tokens (several tokens of A on one character, byte fallback in B),
the bytes that each token decodes to give the cut. Places where tokens of both end part the
text into groups, and every token of A in a group is linked with every token of B in it.

A text is encoded in segments that start at a blank after another character: neither
tokenizer joins across such a place (checked on the files; where they do, the text is one
segment), so each segment is aligned once per worker and remembered.

How many documents hold an id pair linked must be known for all documents before any
document can be summed up. Tasks work in blocks of bounded text size and write, per document,
its links as places in the list of distinct pairs of its block. Only the blocks' lists are
exploded, counted and joined, so a pair that stands in every document weighs one row per
block; the counts then return to the block. Nothing grows with pairs of rows of a group, and
nothing is collected.

Null and empty texts, and texts that the tokenizers do not give back byte for byte, have no
tokens: zeros and an empty digest. Null and repeated ids are rows like others. One text is
never cut, however long. Only key and text are read, so other columns and their names do not
matter. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.llm.common import Memo, groups_of, stored

BLOCK_BYTES = 4 << 20  # text of one block; a longer document is a block of its own
SEGMENTS = 600_000  # short segments that a worker remembers
SHORT = 64  # characters of a segment worth remembering
COLD = 4096  # segments encoded in one call


class Segment(NamedTuple):
    """What one segment adds to its document; ``pairs`` and ``times`` are int64 bytes."""

    whole: bool
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    text: str
    pairs: bytes
    times: bytes


NOT_WHOLE = Segment(False, 0, 0, 0, 0, "", b"", b"")
MARKS = ("\n", ";", ",", "|")  # before a segment's, a group's, a further token, the first of B
SECOND, ID_END = operator.itemgetter(1), operator.attrgetter("id", "end")
LARGE_GROUP = 4096  # links of a group beyond which equal ids are counted first


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies print bytes: printable ones are
    themselves, the others follow from U+0100 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse end where the decoded sizes agree with it, else, inside
    a character, the end that these sizes add up to."""
    decoded = np.cumsum(sizes)
    return np.where(coarse == decoded, coarse, decoded)


class Aligner:
    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import json

        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(False).items()}
        with open(path_a, encoding="utf-8") as file:
            cut = json.load(file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        model = proto.ModelProto()
        with open(path_b, "rb") as file:
            model.ParseFromString(file.read())
        self.bytes_b = [
            bytes([int(p.piece[1:-1], 16)])
            if p.type == proto.ModelProto.SentencePiece.BYTE
            else p.piece.replace("▁", " ").encode()
            for p in model.pieces
        ]
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, token in self.bytes_a.items():
            self.size_a[i] = len(token)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        most = max(len(self.size_a), len(self.size_b))
        self.size_a = np.pad(self.size_a, (0, most - len(self.size_a)))
        self.marked = [f"{m}{i}" for m in MARKS for i in range(most)]
        spec, before = model.normalizer_spec, cut["pre_tokenizer"] or {}
        # A cuts before every run of white space; no piece of B has a blank after something else
        apart = (
            not cut["normalizer"]
            and before.get("type") == "ByteLevel"
            and before["use_regex"]
            and not before["add_prefix_space"]
            and not any(re.search("[^▁]▁", p.piece) for p in model.pieces)
            and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces
            and not spec.precompiled_charsmap
            and not model.trainer_spec.treat_whitespace_as_suffix
        )
        self.border = re.compile(r"(?<=[^\s▁]) (?!\Z)") if apart else re.compile(r"(?!)")
        self.known = Memo(lambda s: None, SEGMENTS)

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def learn(self, segments: list[str]) -> list[Segment]:
        """The segments aligned, from memory where they are short and known."""
        known, older = self.known, self.known.older
        out = [known[s] if s in known else older.get(s) for s in segments]
        old = {s: made for s, made in zip(segments, out) if made and s not in known}
        cold = [i for i, made in enumerate(out) if made is None]
        for at in range(0, len(cold), COLD):
            some = cold[at : at + COLD]
            for i, made in zip(some, self.fresh([segments[i] for i in some])):
                out[i] = made
        # only now, as remembering may drop the older half
        known.remember(old | {segments[i]: out[i] for i in cold if len(segments[i]) <= SHORT})
        return out

    def fresh(self, segments: list[str]) -> list[Segment]:
        """Align segments; each stands for a blank and its own characters.

        Segments that end as a border asks for are encoded side by side as one text, which
        by the rule of the borders changes nothing; the others are texts of their own.
        """
        closed = [bool(s) and not (s[-1].isspace() or s[-1] == "▁") for s in segments]
        inner = [s for s, c in zip(segments, closed) if c]
        alone = [s for s, c in zip(segments, closed) if not c]
        units = ([" ".join(inner)] if inner else []) + alone
        of_a = self.a.encode_batch([" " + s for s in units], add_special_tokens=False)
        of_b = [x.pieces for x in self.b.encode(units, return_type="proto", num_threads=1)]
        # every character and byte of the batch has a place, blanks before segments included
        text = " " + " ".join(units)
        if text.isascii():
            widths = np.ones(len(text), np.int64)
        else:
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            widths = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        place = np.append(0, np.cumsum(widths))  # of a character, in bytes
        chars = np.array([len(s) + 1 for s in units])
        begin = np.cumsum(chars) - chars
        stop = place[np.cumsum([len(s) + 1 for s in inner + alone])]  # of each segment
        chain = itertools.chain.from_iterable
        counts_a = np.array([len(e.ids) for e in of_a])
        n = int(counts_a.sum())
        ids_a = np.fromiter(chain([e.ids for e in of_a]), np.int64, n)
        ends_a = np.fromiter(map(SECOND, chain([e.offsets for e in of_a])), np.int64, n)
        ends_a = place[ends_a + np.repeat(begin, counts_a)]
        counts_b = np.array([len(x) for x in of_b])
        both = np.fromiter(chain(map(ID_END, chain(of_b))), np.int64, 2 * int(counts_b.sum()))
        ids_b, ends_b = both[::2], both[1::2] + 1 + np.repeat(place[begin], counts_b)
        raw = text.encode()
        ids, ends = [ids_a, ids_b], []
        for mine, coarse, counts, table, size in (
            (ids_a, ends_a, counts_a, self.bytes_a, self.size_a),
            (ids_b, ends_b, counts_b, self.bytes_b, self.size_b),
        ):
            spelt = b"".join(map(table.__getitem__, mine.tolist()))
            if spelt != raw:
                half = len(segments) // 2
                if half:  # halve until those that are not spelt stand alone
                    return self.fresh(segments[:half]) + self.fresh(segments[half:])
                return [NOT_WHOLE]
            ends.append(refined(coarse, size[mine]))
        made = self._grouped(ids, ends, stop)
        if alone and inner:
            ordered = iter(made[: len(inner)]), iter(made[len(inner) :])
            made = [next(ordered[0 if c else 1]) for c in closed]
        return made

    def _grouped(self, ids, ends, stop) -> list[Segment]:
        """Groups, their text and their links, for all segments of a batch at once."""
        segment = [np.searchsorted(stop, e) for e in ends]
        common = np.intersect1d(*ends)
        group = [np.searchsorted(common, e) for e in ends]
        sizes = [np.bincount(g, minlength=len(common)) for g in group]
        firsts = [np.cumsum(n) - n for n in sizes]
        owner = np.searchsorted(stop, common)  # the segment of a group
        # the text: tokens in order of group and side, each with the mark that stands before it
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        marks = np.full(len(order), 2, np.int64)
        begin = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
        marks[begin] = 1
        marks[begin[np.diff(owner, prepend=-1) > 0]] = 0
        marks[begin + sizes[0]] = 3
        tokens = marks * len(self.size_a) + np.concatenate(ids)[order]
        text = "".join(map(self.marked.__getitem__, tokens.tolist()))
        # the links: each token of A with all of B in its group; large groups by distinct ids
        many = sizes[0] * sizes[1]
        small = many <= LARGE_GROUP
        mine = small[group[0]]
        width = sizes[1][group[0][mine]]
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        other = np.repeat(firsts[1][group[0][mine]], width) + at
        pairs = [np.repeat(ids[0][mine], width) << 32 | ids[1][other]]
        times = [np.ones(len(other), np.int64)]
        of = [np.repeat(segment[0][mine], width)]
        for g in np.flatnonzero(~small).tolist():
            a, n = np.unique(ids[0][firsts[0][g] : firsts[0][g] + sizes[0][g]], return_counts=True)
            b, m = np.unique(ids[1][firsts[1][g] : firsts[1][g] + sizes[1][g]], return_counts=True)
            pairs.append((a[:, None] << 32 | b).ravel())
            times.append((n[:, None] * m).ravel())
            of.append(np.full(len(a) * len(b), owner[g]))
        of = np.concatenate(of)
        by = np.argsort(of, kind="stable")
        pairs, times = np.concatenate(pairs)[by].tobytes(), np.concatenate(times)[by].tobytes()
        until = np.cumsum(np.bincount(of, minlength=len(stop))) * 8
        n_links = np.bincount(owner, many, len(stop)).astype(np.int64)
        numbers = [np.bincount(x, minlength=len(stop)).tolist() for x in (*segment, owner)]
        rows = zip(*numbers, n_links.tolist(), text.split("\n")[1:], [0, *until.tolist()], until.tolist())
        return [Segment(True, a, b, n, links, t, pairs[x:y], times[x:y]) for a, b, n, links, t, x, y in rows]

    def cut(self, text: str) -> list[str]:
        """The text without the blank at each border; every segment gets its blank back.

        A blank at the very end is no border, as B gives an empty segment no tokens.
        """
        return self.border.split(text)

    def block(self, texts: list[str | None]) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """Rows of the documents, the distinct pairs of the block, and documents per pair."""
        cuts = [self.cut(t) if t else [] for t in texts]
        numbers: dict[str, int] = {}
        which = [[numbers.setdefault(s, len(numbers)) for s in cut] for cut in cuts]
        segments = self.learn(list(numbers))
        del cuts, numbers
        counts = np.array([len(mine) for mine in which], np.int64)
        places = np.fromiter(itertools.chain.from_iterable(which), np.int64, int(counts.sum()))
        doc = np.repeat(np.arange(len(texts)), counts)
        # a text with a segment that is not whole has no tokens at all
        broken = np.array([not s.whole for s in segments], bool)
        lost = np.bincount(doc[broken[places]], minlength=len(texts)) > 0
        places, doc = places[~lost[doc]], doc[~lost[doc]]
        sums = [
            np.bincount(doc, np.array([s[k] for s in segments], np.int64)[places], len(texts)).astype(np.int64).tolist()
            for k in (1, 2, 3, 4)
        ]
        names, of = ("n_a", "n_b", "n_groups", "n_links"), [s.text for s in segments]
        rows = [dict(zip(names, numbers)) for numbers in zip(*sums)]
        for row, mine in zip(rows, which):
            groups = ";".join(map(of.__getitem__, mine)).encode() if row["n_groups"] else None
            row["groups_sha256"] = hashlib.sha256(groups).hexdigest() if groups else ""
        # all links of the block: each segment's list is gathered once per place it stands at
        sizes = np.array([len(s.pairs) // 8 for s in segments], np.int64)
        flat = np.frombuffer(b"".join([s.pairs for s in segments]), np.int64)
        times = np.frombuffer(b"".join([s.times for s in segments]), np.int64)
        pairs, number = np.unique(flat, return_inverse=True)
        lengths = sizes[places]
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat((np.cumsum(sizes) - sizes)[places], lengths) + within
        keys = np.repeat(doc, lengths) * max(1, len(pairs)) + number[at]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        many = np.add.reduceat(times[at][order], new).astype("<u4") if len(new) else np.zeros(0, "<u4")
        doc, pair = np.divmod(keys[new], max(1, len(pairs)))
        borders = np.searchsorted(doc, np.arange(len(texts) + 1))
        pair = pair.astype("<u4")
        for row, x, y in zip(rows, borders[:-1].tolist(), borders[1:].tolist()):
            row["links"] = pair[x:y].tobytes() + many[x:y].tobytes()
        return rows, pairs, np.bincount(pair, minlength=len(pairs))


LOCAL = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links binary, pairs array<long>, docs array<long>"
)
LOCAL_ARROW = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("links", pa.binary())]
    + [(n, pa.list_(pa.int64())) for n in ("pairs", "docs")]
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _blocks(path_a: str, path_b: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in groups_of(sizes, block_bytes):
                some = batch.slice(a, b - a)
                rows, pairs, docs = aligner.block(some.column(1).to_pylist())
                for row, doc_id in zip(rows, some.column(0).to_pylist()):
                    row |= {"block": block, "doc_id": doc_id}
                rows.append({"block": block, "pairs": pairs, "docs": docs})
                yield pa.RecordBatch.from_pylist(rows, LOCAL_ARROW)
                block += 1

    return run


def _summed(answers: pa.Table, docs: pa.Table) -> pa.Table:
    """The counts of a block's pairs, by place in its list, applied to its documents."""
    place = answers["place"].to_numpy()
    size = int(place.max()) + 1 if len(place) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[place], best[place] = answers["n"].to_numpy(), answers["top"].to_numpy().astype(np.int64)
    sums, tops = [], []
    for links in docs["links"].to_pylist():
        pair, many = np.frombuffer(links, "<u4").reshape(2, -1)
        sums.append(int(count[pair] @ many.astype(np.int64)))
        tops.append(int(best[pair] @ many.astype(np.int64)))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(tops, pa.int64()))
    kept = kept.append_column("count_sum", pa.array(sums, pa.int64()))
    return kept.append_column("groups_sha256", docs["groups_sha256"])


def align(
    df: DataFrame,
    path_a: str,
    path_b: str,
    *,
    key: str = "doc_id",
    column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the alignment of each row, and the corpus-wide count of each id pair.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row
    per row. pairs: a, b, n (documents that hold the pair linked), top (whether n is the
    largest of its a).
    """
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("text")
    )
    local = stored(rows.mapInArrow(_blocks(path_a, path_b, block_bytes), LOCAL), "alignment")
    lists = local.filter("pairs IS NOT NULL").select(
        "block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "both")
    ).select("block", "place", F.col("both.pairs").alias("pair"), F.col("both.docs").alias("n"))
    lists = lists.filter("n > 0")  # a segment of a text without tokens may be its only holder
    counts = lists.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(best, "a").select("a", "pair", "n", (F.col("n") == F.col("most")).alias("top"))
    answers = lists.drop("n").join(counts.drop("a"), "pair").select("block", "place", "n", "top")
    docs = local.filter("pairs IS NULL").select(
        F.col("block").alias("of_block"), *[c for c in local.columns if c not in ("block", "pairs", "docs")]
    )
    summed = answers.groupBy("block").cogroup(docs.groupBy("of_block")).applyInArrow(_summed, RESULT)
    mask = F.lit((1 << 32) - 1)
    return summed, counts.select("a", F.col("pair").bitwiseAND(mask).alias("b"), "n", "top")


def links(df: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The groups of every row: doc_id, at (its number), tokens_a, tokens_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = aligner.learn(aligner.cut(text)) if text else []
                if not found or not all(s.whole for s in found):
                    continue
                halves = [g.split("|") for s in found for g in s.text.split(";")]
                sides = [[[int(i) for i in h[k].split(",")] for h in halves] for k in (0, 1)]
                ids = pa.array([doc_id] * len(halves), pa.int64())
                kinds = [pa.array(s, pa.list_(pa.int32())) for s in sides]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(range(len(halves)), pa.int32()), *kinds], ["doc_id", "at", "tokens_a", "tokens_b"]
                )

    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, at int, tokens_a array<int>, tokens_b array<int>")
