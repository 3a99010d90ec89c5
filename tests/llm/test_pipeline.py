"""The pipeline's stages against plain Python, each on its own input."""

import re

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from riskloom.llm import quality
from riskloom.llm.queries import vocabulary
from tests.llm.test_dedup import plain_classes
from tests.llm.test_search import plain_search


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The documents before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf_dir).write.parquet(f"{folder}/{k}")
        frames.append(spark.read.parquet(f"{folder}/{k}"))
    return frames


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert all(f.schema.names == steps[0].schema.names for f in steps[:5])
    assert all(rows(b).items() <= rows(a).items() for a, b in zip(steps[:4], steps[1:5]))


def test_quality(spark, steps, sf_dir):
    scored = quality.quality_scores(steps[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(rows(steps[1])) == {r.doc_id for r in scored.where("predicted = 1").collect()}
    wrong = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").collect()
    kept = set(rows(steps[1]))
    assert sum((r.doc_id in kept) == (r.quality == 1) for r in wrong) >= 0.95 * len(wrong)


def test_exact(steps):
    best = {}
    for r in steps[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (0, r.doc_id)), (-len(r.text or ""), r.doc_id))
    assert set(rows(steps[2])) == {d for _, d in best.values()}


def test_near(steps):
    want = plain_classes([(r.doc_id, r.text) for r in steps[2].collect()])
    assert set(rows(steps[3])) == set(want.values())


def test_decontamination(spark, steps, sf_dir):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = steps[3].collect()
    assert set(rows(steps[4])) == {d.doc_id for d, (_, hit, _) in zip(docs, plain_search([d.text for d in docs], items)) if not hit}


def test_tokens(steps):
    library = Tokenizer.from_file(vocabulary())
    before, after = rows(steps[4]), rows(steps[5])
    assert set(before) == set(after)
    assert all(r.ids == library.encode(before[d].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for d, r in after.items())


def test_run_gives_the_last_stage(spark, steps, sf_dir):
    assert rows(entry.queries()["pipeline"](spark, sf_dir)) == rows(steps[5])


def test_stages_bear_odd_documents(spark, odd, sf_dir):
    """Nulls, empty, repeated and long rows, and clashing columns: no stage fails, and columns stay."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.schema.names == odd.schema.names
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() <= odd.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
