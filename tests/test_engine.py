"""The retrieval engine: rules, codes, search semantics, sources and sinks."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenweave import cli
from tokenweave.functions import quantize
from tokenweave.functions.prefix import running_sum
from tokenweave.functions.rotation import matrix, rotate
from tokenweave.index import MultiVectorIndex
from tokenweave.operators import build as B
from tokenweave.operators import evaluate, search as S
from tokenweave.options import BuildOptions, SearchOptions
from tokenweave.plans.fixture import Fixture
from tokenweave.sources import ground_truth, mvbin

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixture(spark):
    return Fixture(spark, SF)


# --- options and rules --------------------------------------------------------------------


@pytest.mark.parametrize("bad", [{"nprobe": 0}, {"k_refine": 0}, {"k_full_bit": -1}, {"cagra_itopk_size": 0}, {"num_chunks": 0}, {"k_refine": 10, "k_full_bit": 11}])
def test_search_options(bad):
    with pytest.raises(ValueError):
        SearchOptions(**bad)


@pytest.mark.parametrize("bad", [(0, 4), (5, 0), (5, 8), (5, 4, 100), (5, 4, 32)])
def test_build_options(bad):
    with pytest.raises(ValueError):
        BuildOptions(*bad)


@pytest.mark.parametrize("stats", [(0, 64, 64), (100, 64, 65), (100, 63, 63), (100, 129, 129), (4, 64, 64)])
def test_build_checks(stats):
    with pytest.raises(ValueError):
        BuildOptions(5, 4).check(*stats)


def test_documents_are_validated(spark):
    tokens = spark.createDataFrame([(k, [float(k + 1)] * 64) for k in range(5)], "token_id long, embedding array<float>")
    for lens in ([(0, 3), (1, 1)], [(0, 5), (1, 0)], []):
        with pytest.raises(ValueError):
            MultiVectorIndex.build(tokens, spark.createDataFrame(lens, "doc_id int, doc_len int"), 2, 4)


# --- documents ------------------------------------------------------------------------------


def test_offsets_and_token_map(spark):
    docs = B.doc_offsets(spark.createDataFrame([(0, 3), (1, 2), (2, 4)], "doc_id int, doc_len int"))
    assert [(r["start"], r["end"]) for r in docs.orderBy("doc_id").collect()] == [(0, 3), (3, 5), (5, 9)]
    assert [r["doc_id"] for r in B.token_doc_map(docs).orderBy("token_id").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 2]


def test_running_sum_over_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = [r["s"] for r in running_sum(df, "id", F.col("v"), "s", width=64).orderBy("id").collect()]
    assert got == np.concatenate([[0], np.cumsum(np.arange(999) % 7)]).tolist()


# --- codes ----------------------------------------------------------------------------------


def test_rotation_is_orthonormal():
    r = matrix(128, 42)
    assert np.allclose(r @ r.T, np.eye(128))
    x = np.random.default_rng(0).normal(size=(3, 64))
    assert np.allclose(np.linalg.norm(rotate(x, 128, 42), axis=1), np.linalg.norm(x, axis=1))


def test_sign_conventions_at_zero():
    x = np.array([[1.0, -1.0, 0.0, 2.0]])
    bits, f1 = quantize.one_bit(x)
    assert bits.tolist() == [[True, False, False, True]] and f1[0] == 0.5
    code, _ = quantize.full_codes(x, 2)
    assert ((code >> 2) & 1).tolist() == [[1, 0, 1, 1]]
    with pytest.raises(ValueError):
        quantize.one_bit(np.zeros((1, 4)))


@pytest.mark.parametrize("width", range(1, 9))
def test_packing_is_invertible(width):
    code = np.random.default_rng(width).integers(0, 1 << width, (9, 128))
    assert (quantize.unpack_codes(quantize.pack_codes(code, width), 128, width) == code).all()
    bits = code > code.mean()
    bits[:, 63] = True
    assert (quantize.unpack_words(quantize.pack_words(bits), 128) == bits).all()


@pytest.mark.parametrize("ex_bits", [1, 2, 4, 7])
def test_rescale_sweep_is_the_level_by_level_search(ex_bits):
    import heapq

    top = (1 << ex_bits) - 1
    for a in np.abs(np.random.default_rng(ex_bits).normal(size=(12, 64))):
        a /= np.linalg.norm(a)
        end = (top + 10) / a.max()
        code = np.floor(end * quantize.TIGHT_START[ex_bits] * a + 1e-5).astype(int)
        num, den = ((code + 0.5) * a).sum(), 16 + (code * code + code).sum()
        queue = [((c + 1) / x, k) for k, (c, x) in enumerate(zip(code, a, strict=True))]
        heapq.heapify(queue)
        best, found = 0.0, 0.0
        while queue:
            t, k = heapq.heappop(queue)
            code[k] += 1
            num, den = num + a[k], den + 2 * code[k]
            if num / np.sqrt(den) > best + 1e-13:
                best, found = num / np.sqrt(den), t
            if code[k] < top and (code[k] + 1) / a[k] < end:
                heapq.heappush(queue, ((code[k] + 1) / a[k], k))
        assert abs(quantize.best_rescale(a[None], ex_bits)[0] - found) < 1e-9


def test_estimates_get_better_with_bits():
    r = np.random.default_rng(3)
    o, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(200, 64)), r.normal(size=(32, 64))))
    ro, rq, exact = rotate(o, 128, 42), rotate(q, 128, 42), o @ q.T
    bits, f1 = quantize.one_bit(ro)
    errors = [np.abs(S.one_bit_scores(bits.astype(float), f1, rq, quantize.query_sums(rq, 1)[0]) - exact).mean()]
    for b in (1, 4, 7):
        code, fb = quantize.full_codes(ro, b)
        errors.append(np.abs((code @ rq.T - quantize.query_sums(rq, b)[1]) * fb[:, None] - exact).mean())
    assert errors[0] < 0.08 and errors[3] < 0.001 and errors == sorted(errors, reverse=True)


# --- build and search -----------------------------------------------------------------------


def test_block_by_block_equals_one_broadcast(fixture):
    rows = lambda df: sorted(map(tuple, df.collect()))
    small = 64 * 8 * 10
    assert rows(B.assign_nearest(fixture.tokens, fixture.centroids, limit=small).select("token_id", "cluster_id")) == rows(fixture.assigned.select("token_id", "cluster_id"))
    rotated = B.rotated(fixture.centroids, 128, 42, ["cluster_id"])
    assert rows(S.probe(fixture.states, rotated, 3, limit=128 * 8 * 7)) == rows(S.probe(fixture.states, rotated, 3))
    near = lambda **how: rows(S.exact_maxsim(fixture.queries, fixture.tokens, 5, **how).withColumn("score", F.round("score", 9)))
    assert near(limit=64 * 8 * 9) == near()


def test_search_without_pruning_finds_the_exact_answer(fixture):
    n = fixture.doc_lens.count()
    index = MultiVectorIndex.build(fixture.tokens.select("token_id", "embedding"), fixture.doc_lens, 16, 7, SearchOptions(16, n, n, 150, 1))
    got = {(r["query_id"], r["doc_id"]) for r in index.search(fixture.queries, 10).collect()}
    want = {(r["query_id"], r["doc_id"]) for r in fixture.exact.collect()}
    assert len(got & want) >= 0.95 * len(want)
    with pytest.raises(ValueError):
        index.search(fixture.queries, 0)
    with pytest.raises(Exception, match="dimensions"):
        index.search(fixture.queries.withColumn("embedding", F.slice("embedding", 1, 32)), 5).collect()
    index.options = SearchOptions(nprobe=17)
    with pytest.raises(ValueError):
        index.search(fixture.queries, 5)


def test_queries_in_blocks(fixture, monkeypatch):
    from tokenweave import index as module

    index = fixture.index()
    rows = lambda: sorted(map(tuple, index.search(fixture.queries, 5).withColumn("score", F.round("score", 9)).collect()))
    whole = rows()
    monkeypatch.setattr(module, "QUERY_BLOCK", 3)
    assert rows() == whole and len(whole) == 20


def test_ties(spark):
    partial = spark.createDataFrame([(0, 5, 1.0), (0, 3, 1.0), (0, 9, 2.0)], "query_id int, doc_id int, partial double")
    assert [r["doc_id"] for r in S.refine(partial, 3).orderBy("prank").collect()] == [9, 3, 5]
    full = partial.withColumnRenamed("partial", "score")
    assert [r["doc_id"] for r in S.top_k(full, 10).orderBy("rank").collect()] == [9, 5, 3]


def _quota(ones, top, chunks):
    """Chunk by chunk, carrying the best so far."""
    n = len(ones)
    top, chunks = min(top, n), min(chunks, n)
    width = -(-n // chunks)
    carry, seen = [], set()
    for c in range(chunks):
        carry = sorted(carry + [(-ones[d], d) for d in range(c * width, min((c + 1) * width, n))])[:top]
        seen |= {d for _, d in carry[: top * (c + 1) // chunks]}
    return seen


@pytest.mark.parametrize(("n", "top", "chunks"), [(3000, 300, 5), (6, 4, 5), (7, 7, 5), (16, 3, 5), (50, 20, 1), (1, 5, 5), (40, 16, 3)])
def test_chunk_quota_is_the_incremental_rule(spark, n, top, chunks):
    ones = [float(d) for d in range(n)] if n == 3000 else np.random.default_rng(n).normal(size=n).round(6).tolist()
    refined = spark.createDataFrame([(0, d, d) for d in range(n)], "query_id int, doc_id int, prank int")
    scores = spark.createDataFrame([(0, d, ones[d]) for d in range(n)], "query_id int, doc_id int, score double")
    got = {r["doc_id"] for r in S.chunk_quota(refined, scores, top, chunks).collect()}
    assert got == _quota(ones, top, chunks)
    if n == 3000:
        assert len(got) == 900
    assert set(sorted(range(n), key=lambda d: (-ones[d], d))[: min(top, n)]) <= got


def test_candidates_with_no_positive_score_stay(spark):
    q = np.array([[1.0] * 128])
    shared = spark.sparkContext.broadcast({0: (q, *quantize.query_sums(q, 4))})
    words = quantize.pack_words(np.zeros((1, 128), bool))[0].tolist()
    tokens = spark.createDataFrame([(0, 1, 7, words, 0.1)], "query_id int, mask long, doc_id int, code1 array<long>, f1 double")
    assert [tuple(r) for r in S.partial_scores(tokens, shared, 128).collect()] == [(0, 7, 0.0)]


# --- sources, sinks, evaluation ---------------------------------------------------------------


def test_save_and_load(spark, fixture, tmp_path):
    index = fixture.index()
    index.save(str(tmp_path / "index"))
    loaded = MultiVectorIndex.load(spark, str(tmp_path / "index"), index.options)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(loaded.search(fixture.queries, 10)) == rows(index.search(fixture.queries, 10))
    with pytest.raises(ValueError):
        MultiVectorIndex.load(spark, str(tmp_path / "index"), SearchOptions(nprobe=65))
    with pytest.raises(ValueError):
        MultiVectorIndex.load(spark, str(tmp_path / "index"), index.options, padded_dim=64)


def test_binary_formats(spark, tmp_path):
    path = str(tmp_path / "e.bin")
    data = np.arange(30, dtype="<f4").reshape(10, 3)
    with open(path, "wb") as f:
        f.write(struct.pack("<2i", 10, 3) + data.tobytes() + b"trailing")
    got = mvbin.read(spark, path, "embeddings", rows_per_partition=4).orderBy("token_id")
    assert [r["embedding"] for r in got.collect()] == data.tolist() and got.rdd.getNumPartitions() >= 1
    for raw in (b"\x01", struct.pack("<2i", 0, 3), struct.pack("<2i", 10, -1), struct.pack("<2i", 10, 3) + b"short", struct.pack("<2i", 2**31 - 1, 2**31 - 1)):
        with open(path, "wb") as f:
            f.write(raw)
        with pytest.raises(ValueError):
            mvbin.header(path, "embeddings")


def test_ground_truth_text(spark, tmp_path):
    path = str(tmp_path / "gt.tsv")
    write = lambda text: open(path, "w").write(text)  # noqa: E731, SIM115
    write("0\t5\t1\textra\n0\t6\n1\t7\t2\n0\t8\t1\n")
    assert sorted(map(tuple, ground_truth.read(spark, path).collect())) == [(0, 8, 1), (1, 7, 2)]
    for bad in ("0\t5\t0\n", "0\t5\t1001\n", "x\t5\t1\n", "9\t5\t1\n"):
        write(bad)
        with pytest.raises(Exception, match="ground-truth"):
            ground_truth.read(spark, path, 1000, 4).collect()


def test_recall_and_latency(spark):
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id int, doc_id int, rank int")
    results = spark.createDataFrame([(0, 1, 3), (0, 2, 9), (0, 3, 1)], "query_id int, rank int, doc_id int")
    assert evaluate.recall_at_k(truth, results, 3, 1).head()["recall"] == pytest.approx(2 / 3)
    assert evaluate.recall_at_k(truth.where("rank < 3"), results, 3, 1).head()["recall"] == pytest.approx(1 / 3)
    assert evaluate.recall_at_k(truth, results, 0, 1).head()["recall"] == 0
    got = evaluate.latency_summary(spark.range(20).select(F.col("id").cast("double").alias("ms")), "ms").head()
    assert got["p50"] == pytest.approx(9.5) and got["p90"] == pytest.approx(17.1) and got["stddev"] == pytest.approx(5.766281, abs=1e-6)
    assert set(evaluate.latency_summary(spark.range(0).select(F.col("id").cast("double").alias("ms")), "ms").head()) == {0.0}


def test_command_line(spark, fixture, tmp_path, capsys):
    base = str(tmp_path)
    mvbin.write_embeddings(fixture.tokens, f"{base}/e.bin")
    mvbin.write_doc_lens(fixture.doc_lens, f"{base}/d.bin")
    mvbin.write_queries(fixture.queries, f"{base}/q.bin")
    ground_truth.write(fixture.exact, f"{base}/gt")
    assert cli.main([]) == 0 and cli.main(["build", "--index", base]) == 1 and cli.main(["nonsense"]) == 1
    assert cli.main(["build", "-i", f"{base}/index", "-d", f"{base}/d.bin", "--data", f"{base}/e.bin", "--n-clusters", "32", "--ex-bits", "4"]) == 0
    common = ["search", "-q", f"{base}/q.bin", "-g", f"{base}/gt", "-i", f"{base}/index", "--nq", "1", "--warmup", "0"]
    assert cli.main([*common, "--k", "0"]) == 1
    assert cli.main([*common, "--k", "10", "--nprobe", "16", "--k-refine", "100", "--k-full-bit", "50"]) == 0
    out = capsys.readouterr().out
    assert "recall@10:" in out and "latency p50 ms:" in out


def test_stream_of_queries(spark, fixture, tmp_path):
    from tokenweave.streaming.search_stream import search_stream

    fixture.queries.coalesce(1).write.parquet(str(tmp_path / "in"))
    index = fixture.index()
    stream = spark.readStream.schema(fixture.queries.schema).parquet(str(tmp_path / "in"))
    running = search_stream(index, stream, str(tmp_path / "out"), str(tmp_path / "check"), 5, availableNow=True)
    running.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "rank", "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.search(fixture.queries, 5).select("query_id", "rank", "doc_id").collect()))
    assert os.path.isdir(tmp_path / "check")


def test_rescale_of_a_batch_is_that_of_its_rows():
    r = np.random.default_rng(3)
    x = np.abs(r.normal(size=(600, 128)))
    x[5, 3:9] = x[5, 3]  # moves at one time
    x[6, :100] = 0.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for bits in (1, 4, 7):
        together = quantize.best_rescale(x, bits)
        assert together.tolist() == [quantize.best_rescale(row[None], bits)[0] for row in x]


def test_array_entry_points(spark, tmp_path):
    from tokenweave import arrays
    from tokenweave.options import SearchOptions

    r = np.random.default_rng(4)
    x = r.normal(size=(240, 64)).astype(np.float32)
    lens = np.array([3, 2, 4, 6] * 16)
    index = arrays.build(spark, x, lens, 8, 4, SearchOptions(nprobe=8, k_refine=64, k_full_bit=64, num_chunks=1)).stored(str(tmp_path / "index"))
    start = np.cumsum(lens) - lens
    queries = np.stack([np.resize(x[start[d] : start[d] + lens[d]], (32, 64)) for d in (3, 17, 40)])
    exact = [np.maximum.reduceat(x @ q.T, start).sum(axis=1).argmax() for q in queries]
    found = arrays.search(index, queries, 5)
    assert [f[0] for f in found] == exact and all(len(f) == 5 for f in found)
    assert arrays.search(index, queries[1], 5) == found[1]
    assert arrays.search(index, queries[:0], 5) == []
    for bad in (x[0], x[None, None]):
        with pytest.raises(ValueError):
            arrays.search(index, bad)
