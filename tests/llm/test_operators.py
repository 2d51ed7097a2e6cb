"""Every operator against a brute-force version, on small tables with all the awkward rows."""

import base64
import hashlib
import io
import math
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mlscout.llm import archives, bpe, common, components, mixing, neighbours, ngram_join, queries, repeats, resharding
from mlscout.llm import token_files, topk, toxicity
from tests.llm.conftest import sentence

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def real_docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# 1 byte-level BPE


def reference_bpe():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


def test_bpe_equals_the_library(spark, data, edge_docs, edge_rows):
    ref = reference_bpe()
    texts = [(r[0], r[1]) for r in real_docs(spark, data).select("doc_id", "text").collect()]
    for docs, rows in ((edge_docs, [(r[0], r[1]) for r in edge_rows]), (real_docs(spark, data), texts)):
        expected = []
        for doc_id, text in rows:
            ids = ref.encode_ordinary(text or "")
            sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            expected.append((doc_id, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest(), True))
        got = [tuple(r) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_bpe_long_pieces_emit_early(monkeypatch):
    monkeypatch.setattr(bpe, "EMIT_BYTES", 7)
    codec, ref = bpe.Codec(RANKS, public_tokenizers.PATTERN), reference_bpe()
    rng = np.random.default_rng(1)
    for n in range(1, 200, 3):
        text = "".join(rng.choice(list("aaetinothséß漢😀'1 \n"), n))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ref.encode_ordinary(text)


def test_bpe_encode_decode_columns(edge_docs):
    encoded = bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert back.filter("decoded <> coalesce(text, '')").count() == 0
    assert set(edge_docs.columns) <= set(back.columns)


def test_streaming_decoder_splits_anywhere():
    data = "aé漢😀z".encode() + b"\xff\xe6\xbc" + "ß".encode()
    for step in (1, 2, 3, 5):
        decoder = bpe.StreamingDecoder({i: bytes([i]) for i in range(256)})
        parts = [decoder.feed(data[i : i + step]) for i in range(0, len(data), step)]
        assert "".join(parts) + decoder.finish() == data.decode("utf-8", "replace")


# 2 n-gram Jaccard join


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[find(i)] = find(j)
    best = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(
        ((d, len(s), best.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str
    )


@pytest.mark.parametrize("crowd", [24, 2])
def test_jaccard_join(spark, data, edge_docs, edge_rows, crowd):
    real = real_docs(spark, data)
    for docs, rows in (
        (edge_docs, [(r[0], r[1]) for r in edge_rows]),
        (real, [(r[0], r[1]) for r in real.select("doc_id", "text").collect()]),
    ):
        got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs, crowd=crowd).collect()), key=str)
        assert got == brute_components(rows)


@pytest.mark.parametrize("signer", [ngram_join.plain(80, 100), ngram_join.strong(80, 100)])
def test_linked_sets_share_a_signature(signer):
    rng = np.random.default_rng(7)
    for n in (1, 2, 4, 5, 9, 20, 45, 46, 157, 400):
        for _ in range(25):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            gone = rng.integers(0, n // 5 + 1)
            kept = a[gone:]
            more = max(0, len(kept) * 100 // 80 - n)
            b = np.concatenate([kept, rng.integers(0, 2**64, more, dtype=np.uint64)])
            if len(kept) * 100 >= 80 * (n + more):
                assert len(np.intersect1d(signer.sign(np.unique(a)), signer.sign(np.unique(b))))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}


def test_null_ids_are_linked_and_bridge(spark):
    words = sentence(40, 100).split()
    def near(a, b):
        return " ".join([*(f"a{i}" for i in range(a)), *words[a : len(words) - b], *(f"b{i}" for i in range(b))])
    # 1 and 2 are linked only by way of a row without an id; two more such rows have each other
    rows = [(1, near(8, 0)), (None, near(0, 0)), (2, near(0, 8))]
    rows += [(None, sentence(41, 80)), (None, sentence(41, 80) + " end")]
    rows += [(None, near(0, 0))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (24, 2):
        got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs, crowd=crowd).collect()), key=str)
        assert got == brute_components(rows)
        assert {r[2] for r in got if r[0]} == {1}
        links = ngram_join.links(docs, crowd=crowd)[1].count()
        assert links == 3  # the two through the bridge, and that of the null ids


# 3 top-k search


def test_top_k_equals_full_scoring(spark, data):
    docs = real_docs(spark, data)
    rows = [(r[0], Counter((r[1] or "").encode().lower().split())) for r in docs.select("doc_id", "text").collect()]
    df = Counter(w for _, c in rows for w in c)
    mean = sum(sum(c.values()) for _, c in rows) / len(rows)
    got = {}
    for r in topk.search(docs, docs.filter("doc_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score))
    for d, terms in rows:
        if d % 50:
            continue
        scores = []
        for e, c in rows:
            n = sum(c.values())
            s = sum(
                q * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2
                / (c[w] + 1.2 * (0.25 + 0.75 * n / mean))
                for w, q in terms.items() if w in c
            )
            if e != d and s > 0:
                scores.append(s)
        assert np.allclose([s for _, s in sorted(got[d])], sorted(scores)[::-1][:5])


def test_top_k_edges(edge_docs, no_docs):
    found = topk.search(edge_docs, edge_docs, 3).collect()
    assert found and all(r.query_id != r.doc_id for r in found)
    assert {r.doc_id for r in found if r.query_id == 6} == {7}
    assert topk.search(no_docs, no_docs, 3).count() == 0


def test_top_k_in_small_shards_repeats_no_input(spark, data, edge_docs, monkeypatch):
    real = real_docs(spark, data).select("doc_id", "text")
    docs = real.unionByName(edge_docs.selectExpr("doc_id + 1000 AS doc_id", "text"))
    asked = docs.filter("doc_id % 25 = 0")
    whole = topk.search(docs, asked, 4)
    # neither documents nor query lists are multiplied to meet each other
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan
    expected = [tuple(r) for r in whole.orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(topk, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(topk, "COLUMNS", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "TASKS", 0.25)
    for carried in (2_000, 1):
        monkeypatch.setattr(topk, "CARRIED", carried)
        assert [tuple(r) for r in topk.search(docs, asked, 4).orderBy("query_id", "rank").collect()] == expected
    held = dict(real.collect())
    copies = [i for i, t in held.items() if t and t == held[expected[0][2]]]
    assert expected and set(copies) - {expected[0][0]}


def test_word_hashes_tell_words_apart(spark, data):
    texts = [t or "" for _, t in real_docs(spark, data).select("doc_id", "text").collect()]
    texts += ["", " ", "ab ba aab", "x" * 40_000 + " Y" * 20_000 + " " + "z" * 64 + " " + "Z" * 65 + "\x0b" + "z" * 65]
    seen = {}
    for text in (t.encode() for t in texts):
        words, hashes = text.lower().split(), common.hashed_words(text)
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(seen.values())) == len(seen)


# 4 resharding


def test_least_moves_is_minimal():
    sizes, room = {0: 70, 1: 20, 2: 10}, {0: 25, 1: 25, 2: 25, 3: 25}
    moves = resharding.least_moves(sizes, room)
    assert sum(m for a, b, m in moves if a != b) == sum(max(0, sizes.get(s, 0) - room.get(s, 0)) for s in sizes)
    for s, r in room.items():
        assert sum(m for _, b, m in moves if b == s) == r


def test_reshard_rows_once_and_evenly(spark, data, edge_docs, no_docs):
    docs = real_docs(spark, data)
    placed = resharding.reshard(docs, F.col("doc_id") % 5, 7).collect()
    assert sorted(r.doc_id for r in placed) == sorted(r[0] for r in docs.select("doc_id").collect())
    by = {}
    for r in placed:
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    loads = [sum(r.size for r in rows) for rows in by.values()]
    assert max(loads) - min(loads) <= max(r.size for r in placed)
    assert resharding.reshard(edge_docs, F.lit(0), 3).count() == edge_docs.count()
    assert resharding.rewritten(no_docs, F.lit(0), 3).count() == 0


def test_reshard_query_takes_null_ids(spark, edge_docs, edge_rows, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_resharding(spark, str(tmp_path)).collect()
    expected = Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert Counter((r.doc_id, r.text_crc32) for r in rows) == expected
    with pytest.raises(ValueError, match="old shard"):
        resharding.reshard(edge_docs, F.col("doc_id") % 5, 3)


def test_rewrite_touches_affected_shards_only(spark, edge_docs, tmp_path):
    docs = edge_docs.select("doc_id", "text", "lang").filter("doc_id <> 8")
    placed = resharding.reshard(docs, F.when(F.col("doc_id") < 5, 0).otherwise(1), 3)
    names = resharding.write_shards(docs, placed, str(tmp_path / "s"), everything=True)
    files = spark.read.parquet(str(tmp_path / "s"))
    assert files.count() == docs.count() and set(names) >= {r.shard for r in placed.collect()}
    same = resharding.reshard(docs, F.lit(0), {0: placed.agg(F.sum("size")).first()[0]})
    assert resharding.write_shards(docs, same, str(tmp_path / "t")) == []


def test_rewrite_in_one_shuffle_equals_placement_and_join(spark, edge_docs, tmp_path):
    docs, old = edge_docs, F.when(F.col("doc_id") < 5, 0).otherwise(1)
    placed = resharding.reshard(docs, old, 3)
    names = resharding.rewrite(docs, old, 3, str(tmp_path / "one"), everything=True)
    assert names == resharding.write_shards(docs, placed, str(tmp_path / "two"), everything=True)
    one, two = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "two"))
    assert sorted(one.columns) == sorted(two.columns)
    place = lambda df: sorted((r.doc_id or -1, r.size, r.shard, r.slot) for r in df.collect())
    assert place(one) == place(two) == place(placed)
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert texts(one) == texts(docs)
    bare = docs.select("doc_id", "text")
    total = placed.agg(F.sum("size")).first()[0]
    assert resharding.rewrite(bare, F.lit(0), {0: total}, str(tmp_path / "none")) == []


def test_hot_null_ids_are_split_between_files(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS long) AS doc_id", "repeat(concat('w', id, ' '), 50) AS text")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write(docs, WORD_BPE)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    n_files = manifest.count()
    assert n_files > 1
    read = token_files.read_documents(manifest)
    assert read.rdd.getNumPartitions() == n_files  # small manifest rows are not folded together
    rows = sorted((r.start, r.n_tokens) for r in read.collect())
    assert len(rows) == 400 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_a_worker_keeps_what_one_step_remembers():
    words = token_files.WordTokenizer.of(WORD_BPE)
    assert token_files.WordTokenizer.of(WORD_BPE) is words
    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    assert list(common._kept.values()) == [codec]
    assert token_files.WordTokenizer.of(WORD_BPE) is not words


def test_words_forgotten_and_met_again_keep_their_ids(spark, data, monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 40)
    words, ref = token_files.WordTokenizer(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    texts = [t or "" for _, t in real_docs(spark, data).select("doc_id", "text").collect()][:60]
    for at in range(0, 60, 7):
        some = texts[at : at + 7] + texts[:2]
        found = words.encode([t.encode() for t in some])
        assert [f.tolist() for f in found] == [ref.encode(t, add_special_tokens=False).ids for t in some]


def test_tokenizer_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        token_files.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


# 5 archives


@pytest.mark.parametrize("zip64_from", [archives.FULL, 10])
def test_archives_round_trip(spark, zip64_from):
    big = "<p>" + "é" * 900
    rows = [(1, "u", big), (2, "u", big), (9, None, big), (3, "v", "small"), (4, "v", "small"), (5, "w", None), (6, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS path")
    manifest = archives.write(pages, zip64_from=zip64_from, archive_bytes=3000)
    got = {r.page_id: r for r in archives.summary(archives.read_records(manifest)).collect()}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if html == big and page_id != 9 else ("response", None))
        assert r.digest_ok
    path = manifest.first().path.removeprefix("file:")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    none = archives.write(pages.filter("page_id < 0"))
    assert archives.summary(archives.read_records(none)).count() == 0


def test_zip_reader_reads_other_writers(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one.txt", b"hello")
        with z.open("two.bin", "w", force_zip64=True) as out:
            out.write(b"x" * 1000)
    reader = archives.ZipRanges(str(path))
    for name, body in (("one.txt", b"hello"), ("two.bin", b"x" * 1000)):
        at, size = reader.data_at(name)
        assert reader.range(at, size) == body


# 6 token files


def test_repeated_pages_by_broadcast_and_by_shuffle(spark):
    rows = [(i, f"u{i}", ("same " * 300) if i % 3 else f"page {i // 2} " * 200) for i in range(40)]
    pages = spark.createDataFrame([*rows, (None, None, None), (41, "u", "")], "page_id long, url string, html string")
    found = [
        Counter((r.page_id, r.refers_to) for r in archives.duplicates(pages, 1000, n).collect()) for n in (0, 100)
    ]
    largest = {}
    for i, _, html in rows:
        largest[html] = max(i, largest.get(html, i))
    expected = Counter((i, None if largest[h] == i else largest[h]) for i, _, h in rows)
    assert found[0] == found[1] == expected + Counter([(None, None), (41, None)])


def test_token_files(spark, data, edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(WORD_BPE)
    real = real_docs(spark, data)
    for docs, rows in (
        (edge_docs, [(r[0], r[1]) for r in edge_rows]),
        (real, [(r[0], r[1]) for r in real.select("doc_id", "text").collect()]),
    ):
        got = sorted(token_files.read_documents(token_files.write(docs, WORD_BPE, length=16)).collect(), key=lambda r: r.start)
        start = 0
        for (doc_id, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), got):
            ids = library.encode(text or "", add_special_tokens=False).ids + [1]
            assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
        assert len(got) == len(rows)
    assert token_files.read_documents(token_files.write(no_docs, WORD_BPE)).count() == 0


def test_sequences_and_masks(edge_docs):
    manifest = token_files.write(edge_docs.coalesce(1), WORD_BPE, length=8).collect()
    for row in manifest:
        file = token_files.SequenceFile(row.path)
        n = -(-row.n_tokens // 8)
        found = [file.sequence(i) for i in range(n)]
        assert sum(int(m.sum()) for _, m in found) == row.n_tokens
        flat = np.concatenate([i[m == 1] for i, m in found])
        assert (flat == file.ids(0, row.n_tokens)).all()


# 7 toxicity


def test_lexicon_finds_misspellings_as_edit_distance_does():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    stems = {"idiot": 3.0, "stupid": 2.5, "lowei": 2.0, "scum": 4.0}
    lexicon = toxicity.Lexicon(stems)
    words = "idiot idiots idot id1ot idito xdiot stupd sttupid stuqid lowex loei scum scun clown odio upid loweiheit".split()
    for word in words:
        exact = [w for s, w in stems.items() if word.startswith(s)]
        near = [
            w for s, w in stems.items()
            if len(s) >= 5 and any(distance(word[:n], s) <= 1 for n in range(len(word) + 1))
        ]
        expected = (max(exact), 0) if exact else ((max(near), 1) if near else False)
        assert lexicon.find[word] == expected, word


def test_quotation_scores_below_abuse():
    model = toxicity.ToxicityModel({"idiot": 3.0}, [1.0, 1.0, 0.5, -0.5, 1.0, 0.5, 0.2], -3.0)
    assert model.score("you are an idiot") > 0.5 > model.score('he wrote "idiot" on the wall')
    assert model.score("") == model.score("a calm text")


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = real_docs(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in scores if r.toxic == 1]
    clean = [r for r in scores if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, labels)  # one class only
    rows = toxicity.scored(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_only_marks_on_both_sides_quote():
    lexicon = toxicity.Lexicon({"idiot": 3.0})
    direct, far = lexicon.features("you are an idiot"), "calm word " * 20
    for text in ('a 5" pipe, you are an idiot', 'he said you are an idiot', '"never closed: you are an idiot',
                 '"so" you are an idiot and "so"', 'you are an idiot"', f'"once {far} you are an idiot'):
        found = lexicon.features(text)
        assert found[:4] == direct[:4] and found[4] == direct[4], text
    for text in ('the word "idiot" here', '„you big idiot“ it reads', 'a sign « such an idiot » hung there', '("idiot")'):
        found = lexicon.features(text)
        assert found[3] > 0 and 0 < found[0] < 3 and 0 < found[1] < direct[1] and 0 < found[6], text
    assert lexicon.features('he said "idiot" once')[0] < lexicon.features('the word "idiot" once')[0]


@pytest.mark.parametrize("fixed", [False, True])
def test_copies_and_fixed_phrases_do_not_hide_a_slur(spark, fixed):
    rows = [(i, sentence(i, 40), 0) for i in range(300)]
    for i in range(300, 400):
        words = sentence(i, 40).split()
        at = 20 if fixed else i % 37
        words[at : at + 1] = ["away", "grubling", "now"] if fixed else ["grubling"]
        rows.append((i, " ".join(words), 1))
    if not fixed:  # one clean text that quotes the word, copied
        rows += [(i, "a page on the old word grubling and where it came from", 0) for i in range(400, 600)]
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(known.drop("toxic"), known.drop("text"))
    assert any("grubling".startswith(s) for s in model.stems), model.stems
    found = toxicity.scored(known, model).join(known, "doc_id").filter("toxic = 1 AND held_out")
    assert found.count() == found.filter("predicted = 1").count() > 0


# 8 repeats


def brute_repeats(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"block_bytes": 2000}])
def test_repeats(spark, data, edge_docs, edge_rows, no_docs, options):
    def ordered(rows):
        return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))

    real = real_docs(spark, data)
    for docs, rows in (
        (edge_docs, [(r[0], r[1]) for r in edge_rows]),
        (real, [(r[0], r[1]) for r in real.select("doc_id", "text").collect()]),
    ):
        found = repeats.remove_repeats(docs, **options)
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()]
        assert sorted(got, key=str) == brute_repeats(ordered(rows))
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_keep_columns_and_other_texts(edge_docs):
    cut = repeats.without_repeats(edge_docs)
    assert cut.columns == edge_docs.columns and cut.count() == edge_docs.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "" and texts[6] == texts[7] == "word" and texts[3] in (None, "")


def test_replacement_marks_of_the_input_stay(spark):
    passage = sentence(9, 40)
    rows = [(1, passage), (2, "clean \ufffd rest" + passage), (3, "é" + sentence(5, 40)), (4, "\ufffd Щ" + sentence(5, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    # the last byte of the two letters is the same, so a cut leaves the first of the second
    assert texts == {1: passage, 2: "clean \ufffd rest", 3: rows[2][1], 4: "\ufffd "}


def test_merged_transforms_equal_windows():
    rng = np.random.default_rng(3)
    for _ in range(12):
        base = [bytes(rng.choice(list(b"ab "), rng.integers(100, 230)).tolist()) for _ in range(4)]
        some = [base[i][rng.integers(0, 15) :] for i in rng.integers(0, 4, 25)]
        some = [s for s in some if len(s) >= 100]
        flags = repeats.repeated_windows(some, np.arange(len(some)), 600)
        seen, at = set(), 0
        for s in some:
            for i in range(len(s) - 99):
                assert flags[at + i] == (s[i : i + 100] in seen)
                seen.add(s[i : i + 100])
            at += len(s) + 1


# 9 mixing


def test_mix_edges(edge_docs, no_docs, edge_rows):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-9
        assert all(r.taken <= 3 * r.size for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    assert mixing.mix(no_docs).count() == 0


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_rows_without_ids_of_their_own_meet_their_target(spark, ids):
    """A source whose rows all share one id, or have none, is no lump."""
    rows = [(None if ids == "null" else 7, "big", " ".join([f"w{i}"] * (i % 9 + 4))) for i in range(200)]
    rows += [(i, "other", sentence(i, 12)) for i in range(60)] + [(i, None, sentence(i, 9)) for i in range(60)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(found) == len(rows)
    for source in ("big", "other", None):
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)


def test_budgets_are_nested(edge_docs, spark, data):
    docs = real_docs(spark, data)
    few = {r.doc_id: r.copies for r in mixing.mix(docs, budget=0.3).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix(docs, budget=0.7).collect()}
    assert all(more[d] >= c for d, c in few.items())


# 10 neighbours


def test_neighbours_recall_and_ties(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = neighbours.usable(table)
    got = neighbours.search(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    rows = vectors.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cos = (x * x[q]).sum(axis=1) / (norm * norm[q])
        cos[q] = -2
        best = set(ids[np.lexsort((ids, -cos))[:5]])
        mine = [r for r in got if r.query_id == ids[q]]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, 6))
        hits += len(best & {r.vec_id for r in mine})
        total += 5
    assert hits >= 0.9 * total


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 3.0]), (9, [1.0, 1.0, 1.0]), (10, [])]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(vectors, vectors.filter("vec_id IN (0, 9)"), 2).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.search(vectors.filter("vec_id < 0"), vectors.filter("vec_id < 0")).count() == 0


def test_parities_never_exceed_the_differences():
    """Folded onto the smaller, parities differ in at most as many cells as the sets differ."""
    rng = np.random.default_rng(5)
    for n, lost, added in [(1, 0, 0), (64, 3, 9), (65, 2, 0), (1000, 90, 120), (1020, 0, 40)]:
        pool = np.unique(rng.integers(0, 1 << 63, n + added, dtype=np.uint64))
        a, b = pool[:n], pool[lost:]
        p, q = ngram_join.parities(a), ngram_join.parities(b)
        while len(p) != len(q):
            long = max(p, q, key=len)
            half = long[: len(long) // 2] ^ long[len(long) // 2 :]
            p, q = (half, q) if long is p else (p, half)
        apart = int(np.unpackbits((p ^ q).view(np.uint8)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_one_pass_makes_sets_parities_and_signatures(spark, edge_docs, edge_rows):
    texts = [(r[1] or "").encode() for r in edge_rows] + [b"a " * n + b"x" * 70 for n in range(9)]
    flat, ends = common.shingle_sets_of(texts)
    own = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    for text, found in zip(texts, own):
        assert found.tolist() == common.shingle_set(common.hashed_words(text)).tolist()
    for signer in (ngram_join.plain(80, 100), ngram_join.strong(80, 100)):
        signatures, of = signer.sign_all(flat, ends)
        for i, found in enumerate(own):  # a set signs as it does alone
            assert sorted(signatures[of == i]) == (sorted(signer.sign(found)) if len(found) else [])
    made = ngram_join.set_ids(edge_docs, 80, 100).collect()
    by_set = {}
    for row in made:
        by_set.setdefault(row.set_id, set()).update(row.signatures)
    for row, text in zip(edge_rows, texts):
        shingles = common.shingle_set(common.hashed_words(text))
        number = int(ngram_join.fingerprints(shingles, np.array([0, len(shingles)]))[0])
        signed = ngram_join.plain(80, 100).sign(shingles) if len(shingles) else np.zeros(0, np.uint64)
        assert by_set[number] == set(signed.view(np.int64).tolist())


def test_words_of_many_texts_are_counted_as_those_of_each(edge_rows):
    texts = [(r[1] or "").encode() for r in edge_rows] + [b"", b" ", b"b a B", b"x" * 70 + b" x", b""]
    terms, counts, ends = common.counted_words(texts)
    assert len(ends) == len(texts) + 1
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        found, n = np.unique(common.hashed_words(text), return_counts=True)
        assert terms[a:b].tolist() == found.tolist() and counts[a:b].tolist() == n.tolist()
    assert common.counted_words([b"", b" "])[2].tolist() == [0, 0, 0]
