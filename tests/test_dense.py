"""The search where documents meet queries in matrix blocks gives what the joins give."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenweave.functions import quantize
from tokenweave.operators import dense as D
from tokenweave.operators import search as S
from tokenweave.operators.build import document_codes, lists
from tokenweave.options import PADDED_DIM, BuildOptions, SearchOptions
from tokenweave.plans.fixture import EX_BITS, Fixture, K

SF = "/root/testdata/sf0.01"


class Pruned(Fixture):
    build = BuildOptions(64, EX_BITS)
    options = SearchOptions(nprobe=2, k_refine=40, k_full_bit=16, cagra_itopk_size=150, num_chunks=3)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def pruned(spark):
    return Pruned(spark, SF)


@pytest.fixture(scope="module")
def joined(pruned):
    """Refined, one-bit scores, chosen and full scores by ``search``."""
    f, o = pruned, pruned.options
    (_, _, shared), codes = f.blocks[0], document_codes(f.encoded)
    refined = S.refine(S.partial_scores(S.probed_tokens(f.probes, f.postings), shared, PADDED_DIM), o.k_refine).cache()
    one = S.document_scores(refined, codes, shared, PADDED_DIM).cache()
    chosen = S.chunk_quota(refined, one, o.k_full_bit, o.num_chunks).cache()
    return refined, one, chosen, S.document_scores(chosen, codes, shared, PADDED_DIM, EX_BITS)


def rounded(frame):
    return rows(frame.select("query_id", "doc_id", F.round("score", 8)))


def test_full_scores_equal_those_by_joins(pruned, joined):
    assert rounded(pruned.full) == rounded(joined[3])


def test_lists_and_not_pairs_are_shuffled(pruned):
    """At most a row for each query and part of the documents, however many tokens are probed."""
    assert pruned.candidates.count() <= pruned.n_queries * pruned.parts
    assert pruned.partial.count() > 5 * pruned.candidates.count()


def test_best_of():
    r = np.random.default_rng(1)
    size = np.array([3, 1, 7, 2, 2, 1])
    score = r.normal(size=(size.sum(), 5))
    want = np.stack([p.max(axis=0) for p in np.split(score, np.cumsum(size)[:-1])])
    assert (S.best_of(score, size) == want).all() and S.best_of(score[:0], size[:0]).shape == (0, 5)


def test_chosen_equal_those_by_windows(pruned, joined):
    assert rows(pruned.chosen) == rows(joined[2])


def test_one_bit_scores_equal_those_by_joins(pruned, joined):
    assert rounded(pruned.one_bit) == rounded(joined[1])


def test_token_scores_equal_those_by_joins(pruned, joined):
    f, shared = pruned, pruned.blocks[0][2]
    columns = ["query_id", "token_id", "q_pos", F.round("score", 8)]
    assert rows(D.token_scores(f.refined, f.one_bit_docs, shared, PADDED_DIM).select(columns)) == rows(S.token_scores(joined[0], f.encoded, shared, PADDED_DIM).select(columns))


def test_recall_reads_the_best_of_each_batch(spark):
    """The exact scores that are shuffled are at most k for each query and batch."""
    f = Fixture(spark, SF)
    plan = f.exact._jdf.queryExecution().optimizedPlan().toString()
    assert "q_pos" not in plan.split("MapInArrow")[0] and f.exact.count() == K * f.n_queries


def test_refined_equal_those_by_windows(pruned, joined):
    assert rows(pruned.refined) == rows(joined[0])


def test_refined_tokens_equal_those_by_windows(pruned, joined):
    of = lambda refined: rows(S.refined_tokens(refined, pruned.tokens))
    assert of(pruned.refined) == of(joined[0])


def test_tokens_are_numbered_once(pruned):
    """What is chosen comes from the stored tokens and not, once more, from the source."""
    plan = pruned.chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "vec_id" not in plan and "Window" not in plan


def test_probes_of_several_blocks_of_centroids(pruned):
    """A row for each query token takes its clusters from block to block, as ``probe`` gives them."""
    f, n = pruned, pruned.build.n_clusters
    own = f.blocks[0][1]
    want = {(r["query_id"], r["q_pos"], r["cluster_id"]) for r in f.probes.collect()}
    for limit in (128 << 20, 8 * PADDED_DIM * 7):
        a = D.asked(own, f.states, f.rotated_centroids, n, f.options.nprobe, limit)
        got = {(q, t, c) for q, b in zip(a.ids.tolist(), a.first.tolist(), strict=True) for t in range(len(own[q][0])) for c in np.flatnonzero(a.probed[b + t]).tolist()}
        assert got == want


def test_one_list_of_a_query_however_many_ask():
    """A batch gives each query one list of up to LISTED tokens' documents, with the scores of plain loops."""
    r = np.random.default_rng(5)
    asks, size, clusters = r.integers(1, 5, 900), r.integers(1, 5, 800), 6
    x, probed = r.normal(size=(asks.sum(), PADDED_DIM)), r.random((asks.sum(), clusters)) < 0.3
    bits, f1, cluster = r.random((size.sum(), PADDED_DIM)) < 0.5, r.random(size.sum()), r.integers(0, clusters, size.sum()).astype(np.int32)
    cut = lambda flat: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
    docs = pa.RecordBatch.from_arrays([pa.array(np.arange(len(size), dtype=np.int32)), cut(pa.array(cluster)), cut(lists(quantize.pack_words(bits))), cut(pa.array(f1))], names=["doc_id", "cluster_id", "code1", "f1"])
    first = np.cumsum(asks) - asks
    shared = type("Shared", (), {"value": D.Asked(np.arange(len(asks)), first, x, probed)})
    (batch,) = D._candidates(shared, PADDED_DIM)(iter([docs]))
    score, start = ((bits - 0.5) @ x.T) * f1[:, None], np.cumsum(size) - size
    met = np.logical_or.reduceat(np.logical_or.reduceat(probed[:, cluster].T, start), first, axis=1)
    partial = np.add.reduceat(np.maximum.reduceat(np.where(probed[:, cluster].T, np.maximum(score, 0), 0), start), first, axis=1)
    one = np.add.reduceat(np.maximum.reduceat(score, start), first, axis=1)
    assert 0 < len(batch) <= len(asks) and batch.column("query_id").to_pylist() == np.flatnonzero(met.any(axis=0)).tolist()
    for q, d, p, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        doc = np.frombuffer(d, "<i8")
        assert sorted(doc.tolist()) == np.flatnonzero(met[:, q]).tolist()
        assert np.allclose(np.frombuffer(p), partial[doc, q]) and np.allclose(np.frombuffer(o), one[doc, q])


def test_best_sorts_ties_by_document():
    doc, partial = np.array([5, 3, 9, 1, 7]), np.array([1.0, 2.0, 1.0, 1.0, 0.0])
    for k in range(1, 7):
        assert D._best(doc, partial, k).tolist() == [1, 3, 0, 2, 4][:k]


def test_ranking_shuffles_no_one_bit_scores(pruned):
    assert pruned.candidates.columns == ["query_id", "docs", "partial"] and "one#" not in pruned.refined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(pruned.refined) == rows(D.ranked(pruned.scored, pruned.options.k_refine).drop("score"))


def test_refined_tokens_look_documents_up(pruned, joined):
    """Pairs are not sorted to meet their tokens, and a document is one row."""
    got = D.refined_tokens(pruned.refined, pruned.stored)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and "collect_list(token_id" in plan
    assert rows(got) == rows(S.refined_tokens(joined[0], pruned.tokens))
