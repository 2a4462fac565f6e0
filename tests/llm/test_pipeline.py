"""The stages against plain versions, and the whole run."""

import os

import pytest

import corpus_pipeline
from lodestone.llm import decontaminate
from tests.llm.helpers import empty_frame, odd_frame

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run(spark):
    from tests.llm.test_jaccard import plain

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], DATA).cache())
    assert all(f.columns == docs.columns for f in frames[1:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert sum(labels.get(i) == 1 for i in ids[0] - ids[1]) <= 2  # good documents stay
    assert not ids[1] - ids[2]  # every text here has a known language
    rows = [tuple(r) for r in frames[2].select("doc_id", "text").collect()]
    assert ids[3] == {i for i, n, c in plain(rows, 5, 80, 100) if i == c}
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.digest(frames[4], bench).filter("contaminated").isEmpty()
    assert ids[5] == ids[4]
    assert frames[5].filter("NOT round_trip").isEmpty()
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, frames[5].collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_odd_rows(spark):
    for make in (lambda: odd_frame(spark), lambda: empty_frame(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = make()
            out = stage(spark, docs, DATA)
            assert out.count() <= docs.count()
