"""Search asked by every document whose id is divisible by 50."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_point
from tokenweave.options import clusters_for, options_for
from tokenweave.plans.fixture import Fixture

DATA = "/root/testdata"


def exact(folder):
    """{query_id: first ten documents} by plain NumPy."""
    rows = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding", "label"]).to_pylist()
    rows.sort(key=lambda r: (r["label"], r["vec_id"]))
    x = np.array([r["embedding"] for r in rows], float)
    doc = np.array([3 * (t // 9) + (0, 0, 0, 1, 1, 2, 2, 2, 2)[t % 9] for t in range(len(rows))])
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out = {}
    for q in range(0, doc[-1] + 1, 50):
        score = np.maximum.reduceat(x @ x[doc == q].T, first).sum(axis=1)
        out[q // 50] = sorted(range(len(score)), key=lambda d: (-round(score[d], 9), -d))[:10]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_queries_grow_with_the_table(spark, sf):
    want = exact(f"{DATA}/{sf}")
    f = Fixture(spark, f"{DATA}/{sf}")
    assert f.n_queries == len(want) and f.queries.count() == f.tokens.where("doc_id % 50 = 0").count()
    got = {}
    for r in entry_point.queries()["exact_maxsim_topk"](spark, f"{DATA}/{sf}").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_is_at_least_nine_tenths(spark, sf):
    want = exact(f"{DATA}/{sf}")
    got = entry_point.queries()["search_topk"](spark, f"{DATA}/{sf}").collect()
    assert len(got) == 10 * len(want)
    assert sum(r["doc_id"] in want[r["query_id"]] for r in got) >= 0.9 * len(got)


def test_options_grow_with_the_table():
    small, large = options_for(clusters_for(2000), 667), options_for(clusters_for(10**6), 300_000)
    assert clusters_for(40) == 40 and clusters_for(2000) == 64 and small.nprobe == 64 and (small.k_refine, small.k_full_bit) == (3000, 300)
    assert (large.nprobe, large.k_refine, large.k_full_bit) == (5000, 75_000, 15_000)
