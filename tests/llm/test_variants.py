"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from mlscout.llm import variants


def brute_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    """All words with form and root; candidates share a word without one character."""
    holders = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holders.setdefault(v, set()).add(w)
    near = {w: set() for w in words}
    for group in holders.values():
        for a in group:
            near[a].update(b for b in group if b != a and b not in near[a] and one_edit(a, b))
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, len(near[w]), words[f] if f else None))
    return sorted(out, key=str)


def planted(seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        base = "".join(rng.choice("abcdéÿ") for _ in range(rng.randint(7, 12)))
        for word, n in ((base, 220), (base[:3] + base[4:], 21), (base[:3] + base[4:] + "x", 2), (base + base[-1], 3), (base[:5] + "z" + base[5:], 2),
                        ("q" + base, 2), (base[0] + base, 4), (base[:-1] + "x", 2), (base[:4] + "w" + base[5:], 20)):
            rows.append((1000 + k * 10 + n, " ".join([word] * n)))
    long = "".join(rng.choice("abcdefgh") for _ in range(900))
    for word in (long, long[:450] + long[451:], long[:-1], "b" + long[1:], long[:41], long[:40], long[:42], long[:39] + "zz",
                 "a" * 40, "a" * 41, "a" * 42, "a" * 39, "a" * 3000, "a" * 2999):
        rows += [(5000, f"{word} {word}"), (5001, word)]
    rows.append((5002, " ".join([long] * 60)))
    return rows


@pytest.mark.parametrize("long", [variants.LONG, 9])
def test_variants_equal_brute_force(spark, edge_docs, edge_rows, long):
    extra = spark.createDataFrame(planted(), "doc_id long, text string")
    docs = edge_docs.unionByName(extra, allowMissingColumns=True)
    rows = [(r[0], r[1]) for r in edge_rows] + planted()
    got = sorted((tuple(r) for r in variants.variants(docs, long=long).collect()), key=str)
    assert got == brute(brute_words(rows))
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of two forms


def test_variants_of_real_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in variants.variants(docs).collect()), key=str)
    assert got == brute(brute_words(rows))


def test_every_pair_is_found_once(spark):
    words = [(w, 2) for w in dict.fromkeys(brute_words(planted()))]
    df = spark.createDataFrame(words, "word string, n long")
    for long in (variants.LONG, 10):
        pairs = [frozenset((r["word"], r["other"])) for r in variants.neighbours(df, long=long).collect()]
        assert len(pairs) == len(set(pairs))
        assert all(len(p) == 2 and one_edit(*p) for p in pairs)


def test_no_documents(no_docs):
    assert variants.variants(no_docs).count() == 0


def test_one_edit():
    for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("abc", "xabc"), ("abc", "acb"), ("a", ""), ("", ""), ("abcd", "ab")):
        assert variants.one_edit(a, b) == variants.one_edit(b, a) == one_edit(a, b)
