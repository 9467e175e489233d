import hashlib
import random
import re

import pytest

from cairngrid.llm import line_dedup

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs):
    """docs: (doc_id, text) in the table's order; returns per row (n_lines, n_dropped, kept text)."""
    key = lambda x: re.sub(r"\A[\x20\x09-\x0d]+|[\x20\x09-\x0d]+\Z", "", x).translate(UPPER)
    first = {}
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k)):
        for x in (docs[k][1] or "").split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), k)
    out = []
    for k, (_, t) in enumerate(docs):
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), k) == k]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(spark, docs, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, row string").coalesce(1)
    got = line_dedup.line_dedup(df, with_text=True, **more).collect()
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text, tuple(map(tuple, r.keep))) for r in got], key=repr)


def same(spark, docs):
    got = run(spark, docs)
    assert [g[:4] for g in got] == [g[:4] for g in sorted([(i, *b) for (i, _), b in zip(docs, brute(docs), strict=True)], key=repr)]
    return got


def test_cases(spark):
    long = "A line of some length"
    got = same(spark, [(1, f"{long}\n  {long.upper()}\t\nshort"), (2, f"x\n {long.lower()}\r\ny\nshort"), (3, None), (4, ""), (5, "\n"), (6, f"{long}\n{long}\n"), (7, "ÄÖÜäöüßßßß\n"), (8, "äöüäöüßßßß\n")])
    runs = {g[0]: g[4] for g in got}
    assert runs[1] == ((0, 3),) and runs[2] == ((0, 1), (2, 2)) and runs[3] == ((0, 1),) and runs[6] == ((2, 1),)


def test_ties_missing_ids_and_repeated_rows(spark):
    a, b = "the first repeated line", "the second repeated line"
    same(spark, [(5, a), (5, a), (None, a), (None, b), (None, b), (-3, f"{b}\n{a}")])


def test_lengths_count_code_points(spark):
    same(spark, [(1, "äöüäöüäöü"), (2, "äöüäöüäöü"), (3, "äöüäöüäöü€"), (4, "äöüäöüäöü€"), (5, "\x0b\x0c123456789 "), (6, "123456789")])


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force_with_hot_lines(spark, monkeypatch, seed):
    """Lines in every document go the way of keys with many rows."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(line_dedup, "HOT_SAMPLE", 2)
    r = random.Random(seed)
    pool = [f"shared line number {k}" for k in range(40)] + ["short", "", "  "]
    docs = []
    for i in r.sample(range(1000), 150):
        lines = ["The Line That All Documents Hold "] * r.randint(0, 3) + [r.choice(pool) for _ in range(r.randint(0, 12))] + [f"line of {i} and {r.random()}"]
        r.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    same(spark, docs)


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == []
    many = "\n".join(f"line number {k} of many" for k in range(30_000))
    got = {g[0]: g[1:3] for g in run(spark, [(1, many), (2, many + "\nown last line")])}
    assert got == {1: (30_000, 0), 2: (30_001, 30_000)}


def test_no_python_and_no_text_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a line of ten\nb"), (2, "a line of ten\nc")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = line_dedup.op11_line_bitmaps(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
