"""The pipeline's stages one by one against brute force, and the whole on the smallest table."""

from collections import Counter

import __spark_entry__ as contract
import corpus_pipeline
from mlscout.llm import mixing, toxicity
from tests.llm.conftest import sentence
from tests.llm.test_operators import shingles


def test_stages_keep_columns_and_decide(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, data).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name in ("toxicity", "ngram_jaccard_join"):
            assert 0 < docs.count() <= before
        if name == "suffix_array_dedup":
            assert docs.count() == before


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(r.same and r.n_tokens >= 0 for r in rows)


def test_registered():
    names = contract.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def plain_rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_near_duplicates_leave_one_row_of_a_group(spark, edge_docs, edge_rows):
    text = sentence(30, 50)
    more = [
        (None, text, "en", "a"), (None, text + " more", "en", "b"),  # a group of null ids only
        (4, text.upper() + " x", "en", "a"),  # the id of a blank row; joins that group
        (6, edge_rows[0][1], "de", "z"),  # a near copy under the id of a clean text
        (-7, sentence(31, 50), "en", "a"), (-7, sentence(31, 50), "en", "a"), (-7, sentence(31, 50) + " y", "en", "a"),
        (None, None, "en", "a"), (None, sentence(32, 50), "en", "a"), (None, sentence(32, 50), "en", "a"),
    ]
    docs = spark.createDataFrame(edge_rows + more, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "'x' AS `set_id`", "'y' AS component", "length(text) AS n_chars").repartition(3)
    rows = [r[:4] for r in edge_rows + more]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = plain_rows(got)
    assert not kept - Counter(rows)
    for g in set(group):
        mine = [r for r, x in zip(rows, group) if x == g]
        texts = Counter(r for r in kept.elements() if r in mine)
        if not shingles(mine[0][1]):
            assert texts == Counter(mine)
            continue
        assert sum(texts.values()) == 1, mine
        ids = [r[0] for r in mine if r[0] is not None]
        assert next(iter(texts))[0] == min(ids, default=None)


def test_mixed_rows_come_as_often_as_they_are_taken(spark, edge_docs, no_docs):
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(edge_docs).collect()}
    expected = Counter()
    for row, n in plain_rows(edge_docs).items():
        expected[row] = n * copies[row[0], row[3]]
    assert expected[next(r for r in expected if r[0] is None)] > 0
    got = corpus_pipeline.mix_sources(spark, edge_docs, "")
    assert got.columns == edge_docs.columns
    assert plain_rows(got) == +expected
    assert corpus_pipeline.mix_sources(spark, no_docs, "").count() == 0


def test_other_stages_on_awkward_rows(spark, edge_docs, edge_rows, tmp_path):
    labels = [(0, 0), (8, 0), (10, 1), (50, 1), (100, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(edge_docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    got = corpus_pipeline.drop_toxic(spark, edge_docs, str(tmp_path))
    assert got.columns == edge_docs.columns
    assert plain_rows(got) == Counter(r for r in edge_rows if model.score(r[1] or "") < 0.3)
    cut = corpus_pipeline.remove_repeats(spark, edge_docs, "")
    assert cut.columns == edge_docs.columns
    seen, expected = set(), Counter()
    for r in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        text = bytes(x for x, g in zip(data, gone) if not g).decode(errors="ignore")
        expected[r[0], text, r[2], r[3], len(text)] += 1
    assert Counter((r.doc_id, r.text or "", r.lang, r.source, r.n_chars or 0) for r in cut.collect()) == expected
