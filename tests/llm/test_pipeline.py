"""The pipeline, stage by stage, against brute force where that is possible."""

import re

import pytest

import corpus_pipeline
from annalist.llm import common, decontaminate
from test_llm import base, brute_components


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = common.table(spark, sf_dir, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages(spark, sf_dir, stages):
    first, good, single, clean, private, mixed = stages
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == first.columns
    labels = {r.doc_id: r.quality for r in common.table(spark, sf_dir, "labels").collect()}
    rejected = ids(first) - ids(good)
    assert all(labels.get(d, 0) == 0 for d in rejected) and not [d for d in ids(good) if labels.get(d) == 0]

    text = {r.doc_id: r.text or "" for r in good.collect()}
    assert ids(single) == {d for d, (_, c) in brute_components(text).items() if d == c}

    items = [decontaminate.normal(r.text).decode() for r in common.table(spark, sf_dir, "benchmark").collect()]
    assert ids(single) - ids(clean) == {d for d in ids(single) if any(i in decontaminate.normal(text[d]).decode() for i in items)}

    assert ids(private) == ids(clean)
    for r in private.collect():
        assert not base(r.text) or len(base(r.text)) < len(base(text[r.doc_id]))
        assert r.n_chars == len(r.text)
        assert bool(re.search(r"\[(EMAIL|IP|CARD|PHONE|TERM)\]", r.text)) == bool(base(text[r.doc_id])) or not base(text[r.doc_id])
    assert ids(mixed) <= ids(private) and 0.2 * private.count() < mixed.count() < 0.8 * private.count()


def test_run_is_the_stages(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages[-1])


def test_null_ids_and_empty_tables(spark, sf_dir, stages):
    docs = common.table(spark, sf_dir, "documents")
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, "x y z", None, None, None), (None, None, "en", "s", 1)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        got = stage(spark, odd, sf_dir)
        assert got.columns == docs.columns and got.where("doc_id is null").count() == 2
