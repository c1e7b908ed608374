import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import BASE, PASSAGE, TEXTS, classes, kept_words, prose
from walkrank.llm.queries import tokenizer_path

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A few texts that each stage has an effect on."""
    folder = str(tmp_path_factory.mktemp("sf"))
    good, bad = [prose(500 + i, 60, 3000) for i in range(120)], [prose(700 + i, 60, 3000) + " vile filthy scoundrel" for i in range(120)]
    texts = [*TEXTS, *good, *bad, prose(900, 80) + " " + PASSAGE]
    rows = [(i, t, None if i % 7 == 0 else "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    n = len(TEXTS)
    labels = [(i, 1, int(n + 120 <= i < n + 240)) for i in range(n, n + 240) if i % 3]
    spark.createDataFrame([*labels, (None, 1, 1), (n, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(PASSAGE.split()[:25])), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    n = len(TEXTS)
    out = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert out.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in out.collect()}
    assert len(left & set(range(n + 120, n + 240))) <= 6 and len(set(before) - left - set(range(n + 120, n + 240))) <= 3

    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert {r.doc_id for r in out.collect()} == {i for i, _, root in classes(before) if i == root}

    out = corpus_pipeline.drop_repeated_passages(spark, docs, sf_dir).collect()
    want = dict(zip(before, kept_words(before.values()), strict=True))
    for r in out:
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else before[r.doc_id]) and (r.text is None or r.n_chars == len(r.text))
    assert len(out) == len(before)

    out = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()}
    assert set(before) - out == {i for i, t in before.items() if " ".join(PASSAGE.split()[:25]) in (t or "")}

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir).collect()
        docs = spark.createDataFrame(rows, COLUMNS)
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = set()
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want
    assert BASE not in [r.text for r in rows[9:]]


def test_repeated_rows_and_rows_without_id_keep_one(spark):
    """Stages 2 and 3 one after the other: what is there twice stays once, whole."""
    clean, near, other, late = prose(41, 60, 3000), prose(41, 60, 3000) + " end", prose(42, 60, 3000), prose(43, 60, 3000)
    cases = {
        "repeated": ([(1, clean), (1, clean), (2, other)], [(1, clean), (2, other)]),
        "no id": ([(None, clean), (None, clean), (None, near), (None, other)], None),
        "id and no id": ([(None, clean), (-7, near), (9, clean), (None, late)], [(-7, near), (None, late)]),
        "several texts of an id": ([(5, clean), (5, other), (5, other + " x"), (3, late), (8, near), (8, near)], None),
        "no words": ([(None, None), (None, ""), (None, " "), (4, ""), (4, ""), (6, None)], [(None, None), (None, ""), (None, " "), (4, ""), (6, None)]),
    }
    for name, (rows, want) in cases.items():
        docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS).repartition(3)
        out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        out = corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame(out.collect(), COLUMNS), "").collect()
        got = [(r.doc_id, r.text) for r in out]
        if name == "no id":
            assert {i for i, _ in got} == {None} and len(got) == 2 and {t for _, t in got} in ({clean, other}, {near, other})
        elif name == "several texts of an id":
            assert len(got) == 3 and {(i, t.removesuffix(" x")) for i, t in got} == {(5, clean), (5, other), (3, late)}
        else:
            assert sorted(got, key=str) == sorted(want, key=str), name
