"""The pipeline's decisions against the operators' brute-force versions."""

import corpus_pipeline
from tokenweave.llm.store import saved

from . import brute


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = saved(stage(spark, before, folder), "stage")
        rows, kept = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in (before, after))
        if k == 0:
            gone = {d for d, _ in rows} - {d for d, _ in kept}
            short = {d for d, t in rows if len(brute.words(t)) < 20 or 100 * brute.repeat_words(brute.words(t)) > 30 * len(brute.words(t))}
            assert short <= gone
        if k == 1:
            found = brute.components(rows, 5, 80)
            assert sorted(d for d, _ in kept) == sorted({c for _, c in found.values()})
        if k == 2:
            want = brute.removed(rows)
            assert {d: len(brute.words(t)) for d, t in kept} == {d: n - m for d, (n, m, _) in want.items() if n - m or not m}
        if k == 3:
            leaked = {d for d, _ in brute.leaks(rows, items)}
            assert {d for d, _ in kept} == {d for d, _ in rows} - leaked
        if k < 4:
            assert after.columns == columns, name
        before = after
    assert before.columns == [*columns, "piece_ids"] and before.count() > 0


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
