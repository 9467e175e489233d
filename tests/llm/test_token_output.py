import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairngrid.llm import token_output as to

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """rows: (doc_id, text) in stored order."""
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_cut_texts_encode_like_whole_ones():
    rnd = random.Random(1)
    signs = list("abcdeZAÀéß×÷ 'sI12½٣%&\n\t\x00\x0b\x1c\x85\xa0 ́Σς 中文😀‍|<>$#") + ["<|endoftext|>", "'ll", "'re "]
    enc = to.Encoder(PATH)
    odd = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    assert all(x.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids for t, x in zip(odd, enc.encode(odd), strict=True))


def test_full_memo_is_dropped(monkeypatch):
    monkeypatch.setattr(to, "MEMO_WORDS", 5)
    enc = to.Encoder(PATH)
    for t in ("one two three four", "five six seven", "one two"):
        assert enc.encode([t])[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path_factory.mktemp("orc") / "tokens")
    to.write_orc(docs, path, PATH)
    return docs, path


def test_round_trip(spark, stored):
    docs, path = stored
    got = sorted(map(tuple, to.digest(to.read_orc(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == brute(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_files_are_sorted_and_pruned(spark, stored):
    _, path = stored
    files = sorted(str(p) for p in __import__("pathlib").Path(path).glob("*.orc"))
    spans = []
    for f in files:
        ids = orc.ORCFile(f).read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        if ids:
            spans.append((ids[0], ids[-1]))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    one = to.read_orc(spark, path, [17])
    assert one.count() == 1 and "PushedFilters: [" in one._jdf.queryExecution().toString() and "doc_id" in one._jdf.queryExecution().toString().split("PushedFilters")[1]


def test_defined_cases(spark, tmp_path):
    rows = [(3, "b", 1, "x"), (3, "a", 2, "x"), (3, "a", 2, "x"), (None, None, 3, "y"), (-5, "", 4, None), (9, "w " * 5000, 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, seq int, part string")
    got = sorted(map(tuple, to.token_output(df, PATH).select(F.coalesce("doc_id", F.lit(-99)), "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    same = [r.text for r in df.where("doc_id = 3").orderBy(F.xxhash64("text")).collect()]
    want = brute([(-99, None), (-5, ""), *[(3, t) for t in same], (9, "w " * 5000)])
    assert got == want
    assert to.token_output(df.limit(0), PATH).count() == 0


def test_rows_of_one_id_keep_their_order_over_ranges(spark):
    rows = [(1, f"text number {k}") for k in range(3000)] + [(0, "first"), (2, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in to.token_output(df, PATH).collect()), key=lambda r: r[1])
    order = [(r.doc_id, r.text) for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
    assert got == brute(order)


def test_another_tokenizer_encodes_whole_texts():
    enc = to.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  World's\n\nend", "", "  lead", "é ñ"]
    assert not enc.known and [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
