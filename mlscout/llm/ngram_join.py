"""Exact Jaccard self-join on word shingles with PartEnum signatures.

Sets of near-equal size share a band. Two linked sets in a band of sizes up to r differ in at
most k = 2 r (1 - s) / (1 + s) features. The feature domain (64-bit shingle hashes) is cut
into ranges and each range into n2 parts. With more than k / (k2 + 1) ranges, some range holds
at most k2 differences, so the sets agree there on all but k2 parts: the signatures are the
subsets of n2 - k2 parts of a range, and linked sets share one. A set near the upper end of
its band also joins the next one. As a set differs from its partners by less than k, it signs
only as many of the first ranges as that needs. Ranges without features say nothing: an
eighth more ranges than needed makes up for them, and only sets with more empty ones sign
those too.

Signatures come in two strengths. Plain ones (k2 = 0) find the candidates; sets that meet in
groups above ``CROWD`` (shared passages, large groups of copies) sign again with k2 = 2 on
another cut of the domain, and only what meets again is a candidate. Groups up to ``CROWD``
are compared in pairs, larger ones with their first set; linked sets are contracted, and only
members of large groups that still differ are compared among each other. Equal sets are
collapsed before anything else. Each set carries one parity bit per cell of about as many
cells as it has features: two sets differ in at least as many features as their parities
differ, which rules out most candidates without their texts. The rest is verified on the sets.

Null and blank texts have the empty set, which links with nothing. Repeated rows and equal
texts get the same component. Ties do not matter, as a component is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.llm.common import byte_rows, groups_of, mixed, over_batches, shingle_sets_of, stored
from mlscout.llm.components import components

CROWD = 24
CENTRES, ROUNDS = 6, 2  # what members of a large group meet before all that still differ do
BAND_GROWTH = (3, 2)
SIGNED_TOGETHER = 1 << 16  # shingles of sets that sign in one step
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class PartEnum:
    """Signatures for Jaccard of at least ``part / whole``."""

    def __init__(self, part: int, whole: int, n2: int, k2: int, seed: int):
        self.part, self.whole, self.n2, self.k2 = part, whole, n2, k2
        self.seed = np.uint64(seed)
        self.subsets = list(combinations(range(n2), n2 - k2))
        last = [0]
        while last[-1] < 1 << 40:
            low = last[-1] + 1
            last.append(max(low, low * BAND_GROWTH[0] // BAND_GROWTH[1]))
        self.last = np.array(last)

    def largest_partner(self, size: int) -> int:
        return size * self.whole // self.part

    def differences(self, total: int) -> int:
        """The largest symmetric difference of linked sets whose sizes add up to ``total``."""
        return total * (self.whole - self.part) // (self.whole + self.part)

    def needed(self, k):
        """Ranges that leave one agreeing range more than the empty ones allowed, and those."""
        least = k // (self.k2 + 1) + 1
        spare = 2 + least // 8
        return least + spare, spare

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """The signatures of a sorted set of shingle hashes."""
        return self.sign_all(shingles, np.array([0, len(shingles)]))[0]

    def sign_all(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of several sorted sets, one after another in ``flat``, and the set of each."""
        sizes = np.diff(ends)
        values = mixed(flat + self.seed)
        if self.k2:
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                values[a:b].sort()
        place = (values if self.k2 else flat) >> np.uint64(32)
        # a set signs in its own band, and in the next one if partners reach into it
        own = np.searchsorted(self.last, sizes)
        which = np.flatnonzero(sizes > 0)
        reach = which[self.largest_partner(sizes[which]) > self.last[own[which]]]
        of = np.r_[which, reach]
        band = np.r_[own[which], own[reach] + 1]
        size, most = sizes[of], self.last[band]
        ranges, _ = self.needed(self.differences(2 * most))
        k = self.differences(size + np.minimum(self.largest_partner(size), most))
        signed, _ = self.needed(k)
        begin = np.r_[0, np.cumsum(signed)]
        # sums of the parts of the ranges that are signed
        element = _ranges(ends[:-1][of], size)
        times = np.repeat(np.arange(len(of)), size)
        cell = ((place[element] * (ranges * self.n2).astype(np.uint64)[times]) >> np.uint64(32)).astype(np.int64)
        inside = np.flatnonzero(cell < (signed * self.n2)[times])
        cell = cell[inside] + (begin[:-1] * self.n2)[times[inside]]
        sums = np.zeros(begin[-1] * self.n2, np.uint64)
        if len(cell):
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sums[cell[starts]] = np.add.reduceat(values[element[inside]], starts)
        sums = sums.reshape(-1, self.n2)
        filled = np.stack([(sums[:, list(s)] != 0).any(axis=1) for s in self.subsets])
        # a range may agree through any subset, so it counts as empty if one of them is;
        # a smaller partner signs fewer ranges, so every prefix it may use is looked at
        empty = np.r_[0, np.cumsum(~filled.all(axis=0))]
        least = self.differences(2 * (size * self.part // self.whole))
        tried = k - least + 1
        pair = np.repeat(np.arange(len(of)), tried)
        prefix, spare = self.needed(_ranges(least, tried))
        over = empty[begin[pair] + np.minimum(prefix, signed[pair])] - empty[begin[pair]] > spare
        wanted = np.zeros(len(of), bool)
        wanted[pair[over]] = True
        filled |= np.repeat(wanted, signed)
        place = _ranges(np.zeros_like(signed), signed).astype(np.uint64) * np.uint64(64)
        place += np.repeat(band.astype(np.uint64) << np.uint64(40), signed) + self.seed
        owner = np.repeat(of, signed)
        out, owners = [], []
        for j, subset in enumerate(self.subsets):
            some = np.flatnonzero(filled[j])
            joint = mixed(place[some] + np.uint64(j))
            for position, cell_of in enumerate(subset):
                joint = mixed(joint + sums[some, cell_of] * _ODD[position])
            out.append(joint)
            owners.append(owner[some])
        return np.concatenate(out), np.concatenate(owners)


def _ranges(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Consecutive numbers from several starts on, one after another."""
    return np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def plain(part: int, whole: int) -> PartEnum:
    return PartEnum(part, whole, 1, 0, 0x5851F42D4C957F2D)


def strong(part: int, whole: int) -> PartEnum:
    return PartEnum(part, whole, 5, 2, 0x14057B7EF767814F)


def fingerprints(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of several sets of shingle hashes, as signed integers; 0 of an empty one."""
    out = np.zeros(len(ends) - 1, np.int64)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        starts = ends[some]
        total = np.stack(
            [np.add.reduceat(flat, starts), np.bitwise_xor.reduceat(mixed(flat), starts), np.diff(ends)[some].astype(np.uint64)],
            axis=1,
        )
        out[some] = np.bitwise_xor.reduce(mixed(total * np.array([3, 5, 7], np.uint64)), axis=1).astype(np.int64)
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of a power of two of cells whether an odd number of features falls into it."""
    cells = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    inside = (shingles & np.uint64(cells - 1)).astype(np.int64)
    odd = (np.bincount(inside, minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _flat(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def text_hash() -> Column:
    """With the id, null or not, it tells apart all rows that differ in id or text."""
    return F.xxhash64(F.col("text").cast("string"))


def _of_texts(df: DataFrame, make, schema: str) -> DataFrame:
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        text_hash().alias("text_hash"),
    )
    return rows.mapInArrow(over_batches(make), schema)


def set_ids(df: DataFrame, part: int, whole: int, size: int = 5) -> DataFrame:
    """(doc_id, text_hash, set_id, n_shingles, parities, signatures) of every row.

    The plain signatures of equal sets are there once in a batch.
    """
    signer = plain(part, whole)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = shingle_sets_of(byte_rows(batch.column(1)), size)
        ids = fingerprints(flat, ends)
        signatures, of = signer.sign_all(flat, ends)
        first = np.zeros(len(ids), bool)
        first[np.unique(ids, return_index=True)[1]] = True
        signatures, of = signatures[first[of]], of[first[of]]
        order = np.argsort(of, kind="stable")
        places = np.searchsorted(of[order], np.arange(len(ids) + 1))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(ids),
                pa.array(np.diff(ends)),
                _flat([parities(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64()),
                pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(signatures[order].view(np.int64))),
            ],
            ["doc_id", "text_hash", "set_id", "n_shingles", "parities", "signatures"],
        )

    kinds = "doc_id long, text_hash long, set_id long, n_shingles long, parities array<long>, signatures array<long>"
    return _of_texts(df, make, kinds)


def shingle_sets(df: DataFrame, size: int = 5) -> DataFrame:
    """(set_id, shingles) of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = shingle_sets_of(byte_rows(batch.column(1)), size)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(fingerprints(flat, ends)), lists], ["set_id", "shingles"])

    return _of_texts(df, make, "set_id long, shingles array<long>")


def strong_signatures(sets: DataFrame, part: int, whole: int) -> DataFrame:
    """(signature, set_id) of the sets (set_id, shingles)."""
    signer = strong(part, whole)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy().view(np.uint64)
            ids = batch.column(0).to_numpy()
            for a, b in groups_of(np.diff(ends).tolist(), SIGNED_TOGETHER):
                made, of = signer.sign_all(flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made.view(np.int64)), pa.array(ids[a:b][of])], ["signature", "set_id"]
                )

    return sets.select("set_id", "shingles").mapInArrow(run, "signature long, set_id long")


def _met(signed: DataFrame) -> DataFrame:
    """(signature, set_id, n) of the signatures that more than one set has."""
    group = Window.partitionBy("signature")
    shared = signed.withColumns(
        {"_low": F.min("set_id").over(group), "_high": F.max("set_id").over(group)}
    ).filter("_low <> _high")
    members = shared.groupBy("signature", "set_id").agg(F.lit(1).alias("_one"))
    return members.withColumn("n", F.count("*").over(group)).drop("_one")


def _within(members: DataFrame) -> DataFrame:
    """All pairs (a, b) of groups of bounded size."""
    groups = members.groupBy("signature").agg(F.array_sort(F.collect_list("set_id")).alias("s"))
    first = groups.select("s", F.posexplode("s").alias("i", "a"))
    return first.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))


def _differing(x: Column, y: Column) -> Column:
    """In how many cells two parities differ; that of more cells is folded onto the other."""
    width = F.least(F.size(x), F.size(y))

    def folded(p: Column) -> Column:
        halves = F.zip_with(F.slice(p, F.lit(1), width), F.slice(p, width + 1, width), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(p) > width, halves).otherwise(p)

    apart = F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v)).cast("long"))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda total, v: total + v)


def _near(pairs: DataFrame, known: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities do not rule out."""
    rows = known.select("set_id", "n_shingles", "parities")
    sized = pairs.join(rows.toDF("a", "na", "pa"), "a").join(rows.toDF("b", "nb", "pb"), "b")
    # sizes this close have at most twice the cells of each other
    near = sized.filter(F.least("na", "nb") * whole >= F.greatest("na", "nb") * part)
    most = (F.col("na") + F.col("nb")) * (whole - part)
    return near.filter(_differing(F.col("pa"), F.col("pb")) * (whole + part) <= most).select("a", "b")


def _row_key(text_hash: Column) -> Column:
    """Never null: the id, or the text hash of a row without one."""
    return F.coalesce(F.col("doc_id").cast("long"), text_hash)


def _sets_of(df: DataFrame, known: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_id, shingles) of the wanted sets, from the text of one row key each.

    Rows with equal keys may add a set or repeat one; where there are any, each set is kept once.
    """
    chosen = known.join(wanted, "set_id", "left_semi").select(F.col("key").alias("_key"), "repeated")
    texts = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        _row_key(text_hash()).alias("_key"),
    )
    sets = shingle_sets(texts.join(chosen.select("_key"), "_key", "left_semi"), size)
    if chosen.filter("repeated").isEmpty():
        return sets
    return sets.dropDuplicates(["set_id"])


def _verified(
    pairs: DataFrame, df: DataFrame, known: DataFrame, part: int, whole: int, size: int
) -> DataFrame:
    """The pairs (a, b) that are linked: sizes and parities first, then the sets themselves."""
    near = stored(_near(pairs, known, part, whole), "near")
    wanted = near.select(F.col("a").alias("set_id")).union(near.select("b")).distinct()
    sets = stored(_sets_of(df, known, wanted, size), "shingles")
    full = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - common
    return full.filter(common * whole >= union * part).select("a", "b").distinct()


def links(
    df: DataFrame, *, similarity: tuple[int, int] = (80, 100), size: int = 5, crowd: int = CROWD
) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, text_hash, set_id, n_shingles) and links (a, b) between sets.

    The links connect exactly the sets that the full join connects; in groups above ``crowd``
    not every link is listed.
    """
    part, whole = similarity
    # texts are read and cut into words once for the sets, their parities and signatures
    found = stored(set_ids(df, part, whole, size), "sets")
    members = found.drop("signatures")
    signed = found.select(F.explode("signatures").alias("signature"), "set_id")
    # one row key stands for each set; only texts of candidates travel
    keyed = members.filter("n_shingles > 0").withColumn("key", _row_key(F.col("text_hash")))
    known = keyed.groupBy("set_id").agg(
        F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("parities").alias("parities")
    )
    several = keyed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key")
    if several.isEmpty():
        known = known.withColumn("repeated", F.lit(False))
    else:
        several = stored(several.withColumn("repeated", F.lit(True)), "repeated")
        known = known.join(several, "key", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    met = stored(_met(signed), "met")
    crowded = met.filter(F.col("n") > crowd).select("set_id").distinct()
    again = stored(_met(strong_signatures(_sets_of(df, known, crowded, size), part, whole)), "met")
    large = again.filter(F.col("n") > crowd)
    first = large.withColumn("a", F.min("set_id").over(Window.partitionBy("signature")))
    stars = first.filter("a <> set_id").select("a", F.col("set_id").alias("b"))
    pairs = (
        _within(met.filter(F.col("n") <= crowd))
        .unionByName(_within(again.filter(F.col("n") <= crowd)))
        .unionByName(stars)
        .distinct()
    )
    found = stored(_verified(pairs, df, known, part, whole, size), "links")
    if large.isEmpty():
        return members, found
    large = stored(
        large.join(known.select("set_id", "n_shingles"), "set_id").drop("n"), "large"
    )
    # members of large groups not yet connected meet a few others, then all that still differ
    for seed in range(ROUNDS):
        open_ = _open(large, found)
        pairs = _with_centres(open_, seed)
        found = stored(found.unionByName(_verified(pairs, df, known, part, whole, size)).distinct(), "links")
    open_ = _open(large, found)
    most = open_.groupBy("signature", "c").count()
    main = most.groupBy("signature").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    outside = open_.join(main, "signature").filter("c <> main").select(
        "signature", F.col("set_id").alias("x"), F.col("c").alias("cx"), F.col("n_shingles").alias("nx")
    )
    others = open_.select(
        F.col("signature").alias("s"), F.col("set_id").alias("y"), F.col("c").alias("cy"), F.col("n_shingles").alias("ny")
    )
    fit = F.least("nx", "ny") * whole >= F.greatest("nx", "ny") * part
    rest = outside.join(others, (F.col("signature") == F.col("s")) & (F.col("cx") != F.col("cy")) & fit)
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return members, found.unionByName(stored(_verified(rest, df, known, part, whole, size), "links"))


def _open(large: DataFrame, found: DataFrame) -> DataFrame:
    """The large groups that the links found leave in several components ``c``."""
    label = components(found).toDF("set_id", "component")
    labelled = large.join(label, "set_id", "left").select(
        "signature", "set_id", "n_shingles", F.coalesce("component", "set_id").alias("c")
    )
    split = labelled.groupBy("signature").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    return stored(labelled.join(split.filter("low <> high").select("signature"), "signature"), "open")


def _with_centres(open_: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of every member of a group with a few members of other components."""
    place = F.row_number().over(Window.partitionBy("signature").orderBy(F.xxhash64("set_id", F.lit(seed)), "set_id"))
    centres = open_.withColumn("place", place).filter(F.col("place") <= CENTRES).select(
        "signature", F.col("set_id").alias("x"), F.col("c").alias("cx")
    )
    met = open_.join(centres, "signature").filter("c <> cx")
    return met.select(F.least("set_id", "x").alias("a"), F.greatest("set_id", "x").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, *, similarity: tuple[int, int] = (80, 100), size: int = 5, crowd: int = CROWD
) -> DataFrame:
    """Per row (doc_id, n_shingles, component_id): the smallest id reachable by links."""
    members, found = links(df, similarity=similarity, size=size, crowd=crowd)
    label = components(found).toDF("set_id", "component")
    classes = members.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    named = stored(classes.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("set_id", "component_id")
    return members.join(named, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def without_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates: the smallest id, null ids last.

    Rows are told apart by id and text hash, so rows that only share an id, null ids too, are
    judged by their own texts. Of rows with that id and one text, one stays. Blank rows all stay.
    """
    members, found = links(df, **options)
    label = components(found).toDF("set_id", "component")
    filled = members.filter("n_shingles > 0").groupBy("set_id", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    named = stored(
        filled.join(label, "set_id", "left").select(
            F.coalesce("component", "set_id").alias("component"), place.alias("place"), "n"
        ),
        "named",
    )
    first = named.groupBy("component").agg(F.min("place").alias("first"))
    judged = named.join(first, "component").select(
        F.col("place.doc_id").alias("_id"),
        F.col("place.text_hash").alias("_text"),
        (F.col("place") == F.col("first")).alias("stays"),
        "n",
    )
    judged = stored(judged.filter("NOT stays OR n > 1"), "gone")
    rows = df.withColumn("_hash", text_hash())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    own = [F.col(f"`{c}`") for c in df.columns]
    kept = rows.join(judged, same, "left_anti").select(own)
    again = judged.filter("stays")
    if again.isEmpty():
        return kept
    # the smallest of equal rows is an aggregate, so they need not meet in one task
    one = rows.join(again, same, "left_semi").groupBy("doc_id", "_hash").agg(F.min(F.struct(own)).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
