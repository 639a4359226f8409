"""What the pipeline removes: its own intermediate tables, and nothing of other results."""

import os

import pytest

pytest.importorskip("earlywarn.llm.queries")
from earlywarn.llm import queries, storage  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_other_results_still_read_after_the_pipeline(spark):
    import corpus_pipeline

    before = queries.QUERIES["op5_quality_rules"](spark, DATA)
    rows = sorted(map(str, before.collect()))
    folder = storage.shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and sorted(map(str, before.collect())) == rows
    # of all that the run wrote, its result is left
    left = {f for f in set(os.listdir(folder)) - there if f.startswith("earlywarn-")}
    assert len(left) == 1 and out.inputFiles()[0].split("/")[-2] in left
