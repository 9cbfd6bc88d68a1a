"""The pipeline, stage by stage, against brute force on the smallest tables, and on broken rows."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as P  # noqa: E402
from test_pairs import exact_brute, leak_rows, near_brute, split  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows(docs)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name == "mix":
            break
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = out.checkpoint()
        after = rows(docs)
        if name == "language":
            assert after == [(i, t) for i, t in before if re.search(r"[^\W\d_]", t or "")]
        if name == "exact":
            keep = {r[0] for r in exact_brute(before) if r[3]}
            assert after == [(i, t) for i, t in before if i in keep]
        if name == "near":
            keep = {r[0] for r in near_brute(before) if r[0] == r[2]}
            assert after == [(i, t) for i, t in before if i in keep]
        if name == "leaks":
            whole = {i for i, t in before for _, u in items if " ".join(split(u)) in " ".join(split(t))}
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert whole <= gone
            assert gone == {r[0] for r in leak_rows([x for x in before if x[0] in gone], items)}
        before = after
    left = {i for i, _ in before}
    mix = out.collect()
    texts = dict(before)
    for r in mix:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.take_tokens and texts[r.doc_id].startswith(r.text)
    assert mix and {r.doc_id for r in mix} <= left and all(0 < r.take_tokens <= r.tokens for r in mix)


def test_run(spark):
    assert [n for n, _ in P.STAGES] == ["language", "exact", "near", "leaks", "mix"]
    got = entry.queries()["pipeline"](spark, SF)
    assert got.count() > 50 and {"doc_id", "epoch", "take_tokens"} <= set(got.columns)


@pytest.mark.parametrize("n", [0, 3])
def test_broken_rows(spark, n):
    broken = [(1, None, None, None, None), (None, "the words of a text", "en", "src1", 5), (2, "", "en", None, 0), (2, "12 34", None, "x", 1),
              (3, "a text with some words", "en", "src1", 5), (3, "a text with some words", "en", "src1", 5), (4, "ein Text mit Worten", None, "", None)]
    docs = spark.createDataFrame(broken * n, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
    assert docs.count() == 0 if n == 0 else docs.count() >= 1


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))


def test_rows_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(7).write.parquet(path)
    found = []
    for size in ("128m", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = P._numbered(spark.read.parquet(path)).select("doc_id", P.ROW).collect()
        found.append(sorted((r.doc_id, r[P.ROW]) for r in rows))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({r for _, r in found[0]}) == len(found[0])
