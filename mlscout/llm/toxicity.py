"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

The lexicon holds word stems that labelled toxic rows use and clean rows do not. It is a trie;
a word of a text is turned into a Levenshtein automaton (bit vectors of the positions reached
with 0, 1, ... edits) that walks the trie, so all stems within the edit distance are found in
one walk and hopeless branches end at once. Around every match a window of words tells
quotation (quote marks that open before and close after it) from direct abuse (words of
address). A quotation counts for less, for still less beside a verb of saying, and a logistic
model of what was matched gives the score. A text without matches scores by the intercept.

Only the text is looked at. Null and empty texts score as texts without matches. Labels that
are null or of unknown rows are not used. With no labelled row of one class nothing is
learned and every score is the share of toxic rows, or 0 without rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mlscout.llm.common import Memo, byte_rows, kept, over_batches

FIT_ROWS = 8_000  # labelled rows that lexicon and model are fitted on, the lowest id hashes
LEXICON = 2_000  # stems kept, the strongest first
STEM = (4, 12)  # characters of a stem
FUZZY_FROM = 5  # stems of at least so many characters may be misspelled
EDITS = 1
WINDOW = 4
QUOTED_WITHIN = 12  # words before and after a match in which its quote marks must be
CITED, REPORTED = 0.5, 0.25  # what a match in quote marks counts, alone and beside a verb of saying
PREFIX = 4  # characters that decide whether a word is worth a walk
WORDS = 150_000  # words remembered
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…*_-"
QUOTES = "\"“”„«»"
SAYING = frozenset(
    "said says wrote writes called quote quoted sagte schrieb zitat dit écrit cité dijo escribió cita".split()
)
ADDRESS = frozenset("you your you're youre du dich dir ihr tu toi vous usted tú vos".split())
N_FEATURES = 7


def _marked(edge: str) -> bool:
    return any(q in edge for q in QUOTES)


def in_quotes(raw: list[str], i: int) -> bool:
    """Whether a quote mark opens before the word and one closes after it, both nearby.

    A mark opens where it stands before a word and closes where it stands after one, so an inch
    sign opens nothing. A mark on its own does what is looked for.
    """

    def edges(word: str) -> tuple[bool, bool]:
        core = word.strip(EDGES)
        if not core:
            return _marked(word), _marked(word)
        begin = word.index(core)
        return _marked(word[:begin]), _marked(word[begin + len(core) :])

    opens, closes = edges(raw[i])
    for j in range(i - 1, max(-1, i - 1 - QUOTED_WITHIN), -1):
        if opens:
            break
        begins, ends = edges(raw[j])
        if ends and not (begins and not raw[j].strip(EDGES)):
            return False  # closed before the word
        opens = begins
    if not opens:
        return False
    for j in range(i + 1, min(len(raw), i + 1 + QUOTED_WITHIN)):
        if closes:
            break
        begins, ends = edges(raw[j])
        if begins and not (ends and not raw[j].strip(EDGES)):
            return False  # another one opens first
        closes = ends
    return closes


class Lexicon:
    """A trie of stems with weights, and the automaton that walks it."""

    def __init__(self, weights: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.weight: list[float] = [0.0]
        self.length = [0]
        for stem, weight in weights.items():
            node = 0
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.weight.append(0.0)
                    self.length.append(self.length[node] + 1)
                node = self.children[node][c]
            self.weight[node] = weight
        self.hopeful = Memo(self._hopeful, 100_000)
        self.find = Memo(self._find, WORDS)

    def _find(self, raw: str) -> tuple[float, int] | bool:
        """(weight, edits) of the best stem that begins a word, or False."""
        word = raw.strip(EDGES)
        node, best = 0, 0.0
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            best = max(best, self.weight[node])
        if best > 0:
            return best, 0
        if len(word) < FUZZY_FROM - EDITS or not self.hopeful[word[:PREFIX]]:
            return False
        best = self._walk(word, len(word))
        return (best, EDITS) if best > 0 else False

    def _hopeful(self, prefix: str) -> bool:
        """Whether any word with this prefix may match: what follows is taken as fitting."""
        return self._walk(prefix, len(prefix)  + 20) > 0

    def _walk(self, word: str, length: int) -> float:
        """Walks the trie with the automaton of a word; the best weight that it accepts.

        Bit i of ``reached[e]`` says that the first i characters of the word match the path
        with e edits. A stem matches if any beginning of the word does. Characters of the
        word beyond those given, up to ``length``, fit everything.
        """
        unknown = ((1 << length) - 1) & ~((1 << len(word)) - 1)
        bits: dict[str, int] = {}
        for i, c in enumerate(word):
            bits[c] = bits.get(c, unknown) | 1 << i
        full = (1 << (length + 1)) - 1
        start = [1]
        for _ in range(EDITS):
            start.append((start[-1] | start[-1] << 1) & full)
        best, todo = 0.0, [(0, start)]
        while todo:
            node, reached = todo.pop()
            for c, child in self.children[node].items():
                mask = bits.get(c, unknown)
                moved = [(reached[0] & mask) << 1]
                for e in range(1, EDITS + 1):
                    same = (reached[e] & mask) << 1
                    changed = reached[e - 1] << 1  # another character
                    missing = reached[e - 1]  # the word lacks it
                    extra = moved[e - 1] << 1  # the word has one more
                    moved.append((same | changed | missing | extra | moved[e - 1]) & full)
                if not moved[-1]:
                    continue
                if self.length[child] >= FUZZY_FROM:
                    best = max(best, self.weight[child])
                todo.append((child, moved))
        return best

    def features(self, text: str) -> list[float]:
        """What was matched in a text; all zero if nothing was."""
        raw = text.lower().split()
        found = list(map(self.find.__getitem__, raw))
        if not any(found):
            return [0.0] * N_FEATURES
        hits = [i for i, x in enumerate(found) if x]
        exact = fuzzy = quoted = addressed = 0
        strongest = 0.0
        stems: dict[str, float] = {}
        for i in hits:
            near = [x.strip(EDGES) for x in raw[max(0, i - WINDOW) : i + WINDOW + 1]]
            weight, edits = found[i]
            share = 1.0
            if in_quotes(raw, i):
                quoted += 1
                share = REPORTED if any(x in SAYING for x in near) else CITED
            exact += share * (edits == 0)
            fuzzy += share * (edits > 0)
            addressed += share * any(x in ADDRESS for x in near)
            strongest = max(strongest, share * (weight if edits == 0 else weight / 2))
            stem = raw[i].strip(EDGES)
            stems[stem] = max(share, stems.get(stem, 0.0))
        density = (exact + fuzzy) / (len(raw) + 20)
        return [
            strongest, log1p(exact), log1p(fuzzy), log1p(quoted), log1p(addressed),
            log1p(sum(stems.values())), log1p(100 * density),
        ]


class ToxicityModel:
    """The lexicon's stems and weights, and the logistic coefficients: small, sent to tasks."""

    def __init__(self, stems: dict[str, float], coefficients: list[float], intercept: float):
        self.stems, self.coefficients, self.intercept = stems, coefficients, intercept
        self._lexicon: Lexicon | None = None

    def __getstate__(self):
        return self.stems, self.coefficients, self.intercept

    def __setstate__(self, state):
        self.stems, self.coefficients, self.intercept = state
        self._lexicon = None

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:  # tasks of one model share what their worker found
            key = (Lexicon, frozenset(self.stems.items()))
            self._lexicon = kept(key, lambda: Lexicon(self.stems))
        return self._lexicon

    def score(self, text: str) -> float:
        z = self.intercept + sum(
            a * b for a, b in zip(self.coefficients, self.lexicon.features(text)) if b
        )
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows outside the held-out part."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    # at most ``limit`` rows of two integers, so the documents need not be shuffled
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many of the rows a word begins with the stem."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                counts = (Counter(), Counter())
                for raw, toxic in zip(byte_rows(some.column(0)), some.column(1).to_pylist()):
                    words = {w.strip(EDGES) for w in raw.decode("utf-8", "replace").lower().split()}
                    counts[toxic].update(
                        {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)}
                    )
                stems = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stems, pa.string()), *[pa.array([c[s] for s in stems], pa.int64()) for c in counts[::-1]]],
                    ["stem", "toxic", "clean"],
                )

    parts = rows.mapInArrow(count, "stem string, toxic long, clean long")
    return parts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_stems(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems that mark toxic rows, with their log-odds; of nested stems one that says all."""
    if not n_toxic or not n_clean:
        return {}
    good = {}
    for stem, t, c in counts:
        odds = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
        if odds > 20 and t > 4 * c:
            good[stem] = (t, c, log(odds))
    kept: dict[str, float] = {}
    longer: dict[str, int] = {}
    for stem, (t, c, _) in good.items():
        if stem[:-1] in good:
            longer[stem[:-1]] = max(longer.get(stem[:-1], 0), t)
    for stem in sorted(good, key=len):
        t, c, weight = good[stem]
        if any(stem[:n] in kept for n in range(STEM[0], len(stem))):
            continue
        if longer.get(stem, 0) < 0.9 * t:
            kept[stem] = weight
    strongest = sorted(kept, key=lambda s: (-good[s][0] * good[s][2], s))[:LEXICON]
    return {s: kept[s] for s in strongest}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic model; the last column is the intercept."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> ToxicityModel:
    """Learn the lexicon and the model from labelled rows.

    The driver receives the candidate stems (filtered to those rows of one class dominate)
    and one short feature row per fitted text: both bounded by ``limit``.
    """
    # both classes are taken over distinct texts: a text says no more for being copied
    rows = training_rows(docs, labels, limit).distinct().persist()
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        rows.unpersist()
        share = n_toxic / max(1, n_toxic + n_clean)
        return ToxicityModel({}, [0.0] * N_FEATURES, log((share + 1e-9) / (1 - share + 1e-9)))
    # so many toxic rows do not share a stem by chance, among a million stems
    least = max(2, int(np.ceil(log(1e6) / max(0.5, log((n_toxic + n_clean) / n_toxic)))))
    least = min(least, max(2, n_toxic // 5))
    strong = _stem_counts(rows).filter((F.col("toxic") >= least) & (F.col("toxic") > 4 * F.col("clean")))
    strong = strong.orderBy(F.desc("toxic"), "stem").limit(50 * LEXICON)
    stems = choose_stems([tuple(r) for r in strong.collect()], n_toxic, n_clean)
    model = ToxicityModel(stems, [0.0] * N_FEATURES, 0.0)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.lexicon.features(r.decode("utf-8", "replace")) for r in byte_rows(batch.column(0))]
            flat = pa.array(np.array(found).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(range(0, N_FEATURES * len(found) + 1, N_FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["x", "toxic"])

    kinds = rows.mapInArrow(measure, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    rows.unpersist()
    x = np.array([[*r[0], 1.0] for r in kinds])
    y, n = np.array([float(r[1]) for r in kinds]), np.array([r[2] for r in kinds])
    beta = _logistic(np.repeat(x, n, axis=0), np.repeat(y, n))
    return ToxicityModel(stems, beta[:-1].tolist(), float(beta[-1]))


def score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """Add the score of every text, replacing a column of that name; no shuffle."""
    rows = docs.drop(column)
    at = rows.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                some = batch.slice(begin, 200)
                found = [model.score(r.decode("utf-8", "replace")) for r in byte_rows(some.column(at))]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(found, pa.float64())], [*some.schema.names, column]
                )

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.score(r.decode("utf-8", "replace")) for r in byte_rows(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(over_batches(make), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
