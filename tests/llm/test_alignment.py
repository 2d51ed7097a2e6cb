"""The alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mlscout.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_groups(libraries, text):
    """Groups of (A ids, B ids) of a whole text by cumulated decoded bytes, none where they differ."""
    a, b = libraries
    if not text:
        return []
    letters = alignment.byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [
        bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in ids_b
    ]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    groups, i, j = [], 0, 0
    while i < len(ids_a):
        x, y = i + 1, j + 1
        end_a, end_b = len(bytes_a[i]), len(bytes_b[j])
        while end_a != end_b:
            if end_a < end_b:
                end_a, x = end_a + len(bytes_a[x]), x + 1
            else:
                end_b, y = end_b + len(bytes_b[y]), y + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return groups


def brute(libraries, rows):
    found = [(d, brute_groups(libraries, t)) for d, t in rows]
    linked = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for _, groups in found]
    count = Counter(p for c in linked for p in c)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (d, groups), c in zip(found, linked):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(c.values()),
            sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str), {(x, y, n, n == best[x]) for (x, y), n in count.items()}


MORE = [
    (200, "漢字 and 😀 over  bytes   three  blanks "), (201, "  leading"), (202, "trailing  \n\n "),
    (203, "a▁b stands for itself"), (204, "<|endoftext|> <0x41> <s> </s> <unk>"), (205, "don't we'll I'm 12345 -- ...\t\tx"),
    (206, " em　wide line \x1c \x85 x"), (207, " "), (208, "👩‍👩‍👧 é́ ﬁ Ⅻ \U0001F468 " * 40), (209, "x" * 900 + " " * 700 + "y"),
]


@pytest.mark.parametrize("block", [1, 300, alignment.BLOCK_BYTES])
def test_alignment_equals_brute_force(spark, libraries, edge_docs, edge_rows, block):
    more = spark.createDataFrame(MORE, "doc_id long, text string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True)
    rows = [(r[0], r[1]) for r in edge_rows] + MORE
    got, pairs = alignment.align(docs, A, B, block_bytes=block)
    expected, expected_pairs = brute(libraries, rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert {tuple(r) for r in pairs.collect()} == expected_pairs


def test_alignment_of_real_documents(spark, data, libraries):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got, _ = alignment.align(docs, A, B)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(libraries, rows)[0]


def test_segments_equal_whole_texts(libraries):
    """Random mixtures of blanks, marks and letters: segments must not change the groups."""
    chars = list("aA z1'  \t\n  ▁é漢😀.,-") + [" the", "'s", "  ", "\r\n"]
    aligner, rng = alignment.Aligner.of(A, B), random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(1, 25)))
        found = aligner.learn(aligner.cut(text))
        groups = brute_groups(libraries, text)
        expected = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (";".join(s.text for s in found) if all(s.whole for s in found) else "") == expected, text


def test_links_and_empty_tables(edge_docs, no_docs, libraries, edge_rows):
    got = {}
    for r in alignment.links(edge_docs, A, B).orderBy("doc_id", "at").collect():
        got.setdefault(r["doc_id"], []).append((r["tokens_a"], r["tokens_b"]))
    for doc_id, text in [(r[0], r[1]) for r in edge_rows if r[0] not in (100, None)]:
        assert got.get(doc_id, []) == brute_groups(libraries, text)
    docs, pairs = alignment.align(no_docs, A, B)
    assert docs.count() == 0 and pairs.count() == 0
    assert alignment.links(no_docs, A, B).count() == 0
