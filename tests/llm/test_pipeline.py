import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairngrid.llm import langid
from tests_llm_helpers import brute_contaminated, brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returns on the smallest table, with a letterless document added."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 !!", None, "x", 8), (10**6 + 1, None, "en", "x", None)], docs.schema)
    docs = docs.unionByName(extra)
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(str(base / str(k)))
        out.append(spark.read.parquet(str(base / str(k))))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_language_rejects_only_what_has_no_language(stages):
    assert rows(stages[1]) == {i: t for i, t in rows(stages[0]).items() if langid.has_letter(t)}


def test_one_document_of_each_group(stages):
    before = rows(stages[1])
    comp = brute_components(before)
    assert rows(stages[2]) == {i: t for i, t in before.items() if comp[i] == i}


def test_no_benchmark_passage_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows(stages[2])
    bad = brute_contaminated(before, items)
    assert bad and rows(stages[3]) == {i: t for i, t in before.items() if i not in bad}


def test_mixing_repeats_or_drops_whole_documents(stages):
    before, after = rows(stages[3]), stages[4].collect()
    assert {r.doc_id for r in after} <= before.keys() and all(before[r.doc_id] == r.text for r in after)
    assert len({r.doc_id for r in after}) > 0.6 * len(before)


def test_tokens_describe_the_mixed_documents(stages):
    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    want = []
    for i, text in sorted((r.doc_id, r.text) for r in stages[4].collect()):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_repeated_ids_leave_one(spark):
    docs = spark.createDataFrame([(1, "one two three four", "en", "s", 18)] * 3 + [(2, "other words are here now", "en", "s", 24)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == {1: 1, 2: 1}


def test_rows_with_equal_or_no_ids_are_judged_by_their_own_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_number string, pred_lang string, mix_rate string"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"w{k * k % 97}" for k in range(300))
    rows = [(1, "one two three four"), (1, "one two three four"), (1, long), (None, long + " tail"), (None, "quite another text stands here"), (None, "and a third one without an id"), (2, item), (None, "so " + item), (2, "a clean text with a dirty twin id")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x", "y", "z") for r in rows], schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    clean = corpus_pipeline.drop_contaminated(spark, kept, SF)
    assert kept.columns == clean.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts[1, "one two three four"] == 1 and texts[1, long] == 1 and (None, long + " tail") not in texts
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter({k: n for k, n in texts.items() if item not in k[1]})
    assert {(None, rows[4][1]), (None, rows[5][1]), (2, rows[8][1])} <= texts.keys()
    for f in (corpus_pipeline.identify_language, corpus_pipeline.mix_domains):
        assert f(spark, docs, SF).columns == docs.columns


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert out.count() == 0


def test_row_numbers_are_those_of_the_files_or_stored(spark, tmp_path):
    from cairngrid.llm.common import numbered, plain_scan

    path = str(tmp_path / "d")
    spark.range(1000).selectExpr("id % 7 as doc_id", "cast(id as string) as text", "'x' as row_number").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    one = f"{SF}/documents.parquet"
    assert plain_scan(docs) and plain_scan(spark.read.parquet(one))
    for other in (docs.limit(10), docs.where("doc_id = 1"), docs.withColumn("z", F.explode(F.array(F.lit(1), F.lit(2)))), docs.union(docs), docs.sample(0.5), spark.createDataFrame([(1, "a")], "doc_id long, text string")):
        assert not plain_scan(other)
        rows, number = numbered(other)
        assert rows.select(number).distinct().count() == rows.count()
    rows, number = numbered(docs)
    first = {r[number]: r.text for r in rows.collect()}
    assert len(first) == 1000 and first == {r[number]: r.text for r in rows.repartition(3).collect()} and number != "row_number"
