from __future__ import annotations

import corpus_pipeline
from perigee.llm import fmindex
from perigee.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        rows = out.count()
        assert 0 < rows <= before, name
        if name != "pieces":
            assert out.columns == columns
            docs = out
        before = rows
    assert out.where("not round_trip").count() == 0


def test_awkward_rows_pass(spark, awkward, nothing):
    docs = awkward.selectExpr("doc_id", "text", "lang", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars", "id", "found", "hit_items", "score")
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, FOLDER).count() <= frame.count()


def test_decisions(spark):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    text = "".join(f"plain words {k} of a letter to nobody in particular. " for k in range(40))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, f"{text} {bench}", "en", "s", 1), (4, "12 34", "en", "s", 1), (5, "my password = hunter2222 is not for the public eye, keep it", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ids = lambda frame: sorted(r["doc_id"] for r in frame.collect())
    by = dict(corpus_pipeline.STAGES)
    assert ids(by["language"](spark, docs, FOLDER)) == [1, 2, 3, 5]
    assert 2 not in ids(by["near_duplicates"](spark, docs, FOLDER))
    assert 3 not in ids(by["decontamination"](spark, docs, FOLDER))
    blanked = {r["doc_id"]: r for r in by["secrets"](spark, docs, FOLDER).collect()}
    assert "hunter" not in blanked[5]["text"] and blanked[5]["n_chars"] == len(blanked[5]["text"])
    assert blanked[1]["text"] == text and blanked[1]["n_chars"] == 1


def test_every_query_is_registered():
    numbers = {name.split("_")[0] for name in QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert fmindex.WINDOW == 10
