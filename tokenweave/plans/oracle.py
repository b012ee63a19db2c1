"""The catalogue in DuckDB SQL.

Each query is a SELECT over named steps.  Step ``opt`` derives numbers of clusters, probes and
documents from the table; a test may put other ones in its place.
"""

from __future__ import annotations

import re

STEPS = {
    "tok": "SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS token_id, label, embedding::DOUBLE[] AS e FROM embeddings",
    "tokens": "SELECT token_id, (3 * (token_id // 9) + CASE WHEN token_id % 9 < 3 THEN 0 WHEN token_id % 9 < 5 THEN 1 ELSE 2 END)::INT AS doc_id, e FROM tok",
    "docs": "SELECT doc_id, count(*)::INT AS doc_len, min(token_id) AS first_token, max(token_id) + 1 AS end_token FROM tokens GROUP BY doc_id",
    "opt": "SELECT clusters, least(clusters, greatest(128, (clusters + 1) // 2)) AS nprobe, greatest(3000, (n_docs + 3) // 4) AS k_refine, greatest(300, (n_docs + 19) // 20) AS k_full, 5 AS most_chunks FROM (SELECT least(count(*), greatest(64, (count(*) + 99) // 100)) AS clusters, count(DISTINCT doc_id) AS n_docs FROM tokens)",
    "qtok": "SELECT (doc_id // 50)::INT AS query_id, (row_number() OVER (PARTITION BY doc_id ORDER BY token_id) - 1)::INT AS q_pos, token_id, e FROM tokens WHERE doc_id % 50 = 0",
    "centroids": "SELECT (row_number() OVER (ORDER BY key, token_id) - 1)::INT AS cluster_id, token_id, e FROM (SELECT *, (token_id * 2654435761 + 42 * 40503) % 4294967296 AS key FROM tokens ORDER BY key, token_id LIMIT (SELECT clusters FROM opt))",
    "assigned": "SELECT token_id, doc_id, cluster_id FROM (SELECT t.token_id, t.doc_id, c.cluster_id, round(list_inner_product(c.e, c.e) - 2 * list_inner_product(t.e, c.e), 9) AS dist FROM tokens t, centroids c) QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY dist, cluster_id) = 1",
    "z0": "SELECT r, i, ((i + 1) * 2654435761 + (r + 1) * 40503 * 65537 + 42 * 97) % 4294967296 AS z FROM range(3) a(r), range(128) b(i)",
    "z1": "SELECT r, i, (xor(z, z >> 15) * 739982445) % 4294967296 AS z FROM z0",
    "sgn": "SELECT r, i, 1 - 2 * ((xor(z, z >> 12) >> 9) % 2) AS s FROM z1",
    "h": "SELECT i, j, (1 - 2 * (bit_count((i & j)::INT) % 2)) / sqrt(128) AS w FROM range(128) a(i), range(128) b(j)",
    "rot0": "SELECT token_id, i, coalesce(e[i + 1], 0) AS x FROM tok, range(128) a(i)",
    **{f"rot{r + 1}": f"SELECT token_id, h.i, sum(x * s * w) AS x FROM rot{r} JOIN sgn ON sgn.r = {r} AND sgn.i = rot{r}.i JOIN h ON h.j = rot{r}.i GROUP BY token_id, h.i" for r in range(3)},
    "rot": "SELECT token_id, list(x ORDER BY i) AS o FROM rot3 GROUP BY token_id",
    "onebit": "SELECT token_id, list_transform(o, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS b, 2 / list_sum(list_transform(o, lambda x: abs(x))) AS f1 FROM rot",
    "dims": "SELECT token_id, i, x, abs(x) / sqrt(sum(x * x) OVER (PARTITION BY token_id)) AS a FROM rot3",
    "ends": "SELECT token_id, 25 / max(a) AS t_end FROM dims GROUP BY token_id",
    "starts": "SELECT token_id, i, x, a, t_end, floor(t_end * 0.59 * a + 1e-5) AS c0 FROM dims JOIN ends USING (token_id)",
    "base": "SELECT token_id, 128 / 4 + sum(c0 * c0 + c0) AS den, sum((c0 + 0.5) * a) AS num FROM starts GROUP BY token_id",
    "moves": "SELECT token_id, i, a, l, l / a AS t FROM starts, range(1, 17) r(l) WHERE l = c0 + 1 OR (l > c0 + 1 AND l <= 15 AND l / a < t_end)",
    "sweep": "SELECT token_id, i, t, (num + sum(a) OVER w) / sqrt(den + sum(2 * l) OVER w) AS fit FROM moves JOIN base USING (token_id) WINDOW w AS (PARTITION BY token_id ORDER BY t, i ROWS UNBOUNDED PRECEDING)",
    "best": "SELECT token_id, t FROM sweep QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY fit DESC, t, i) = 1",
    "ex": "SELECT token_id, i, x, (CASE WHEN x < 0 THEN 15 - least(floor(t * a + 1e-5), 15) ELSE least(floor(t * a + 1e-5), 15) END)::INT AS c FROM dims JOIN best USING (token_id)",
    "total": "SELECT token_id, i, x, c + CASE WHEN x >= 0 THEN 16 ELSE 0 END AS c FROM ex",
    "full_code": "SELECT token_id, list(c::DOUBLE ORDER BY i) AS c, 1 / sum((c - 15.5) * x) AS fb FROM total GROUP BY token_id",
    "qrot": "SELECT query_id, q_pos, o, list_sum(o) AS total FROM qtok JOIN rot USING (token_id)",
    "crot": "SELECT cluster_id, o FROM centroids JOIN rot USING (token_id)",
    "probes": "SELECT query_id, q_pos, cluster_id, (row_number() OVER (PARTITION BY query_id, q_pos ORDER BY dist, cluster_id) - 1)::INT AS rank FROM (SELECT query_id, q_pos, cluster_id, round(list_inner_product(c.o, c.o) - 2 * list_inner_product(q.o, c.o), 9) AS dist FROM qrot q, crot c) QUALIFY rank < (SELECT nprobe FROM opt)",
    "cand": "SELECT DISTINCT query_id, doc_id FROM probes JOIN assigned USING (cluster_id)",
    "best1": "SELECT query_id, doc_id, q_pos, greatest(0, max((list_inner_product(o, b) - 0.5 * total) * f1)) AS s FROM probes JOIN assigned USING (cluster_id) JOIN onebit USING (token_id) JOIN qrot USING (query_id, q_pos) GROUP BY ALL",
    "part": "SELECT query_id, doc_id, sum(s) AS score FROM best1 GROUP BY ALL",
    "refined": "SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1)::INT AS prank FROM part QUALIFY prank < (SELECT k_refine FROM opt)",
    "tok1": "SELECT query_id, doc_id, token_id, q_pos, (list_inner_product(o, b) - 0.5 * total) * f1 AS score FROM refined JOIN tokens USING (doc_id) JOIN onebit USING (token_id) JOIN qrot USING (query_id)",
    "doc1": "SELECT query_id, doc_id, sum(m) AS score FROM (SELECT query_id, doc_id, q_pos, max(score) AS m FROM tok1 GROUP BY ALL) GROUP BY ALL",
    "sized": "SELECT query_id, doc_id, prank, score, count(*) OVER (PARTITION BY query_id) AS n FROM refined JOIN doc1 USING (query_id, doc_id)",
    "shares": "SELECT sized.*, least(n, k_full) AS top, least(n, most_chunks) AS chunks, ceil(n / least(n, most_chunks)) AS width FROM sized, opt",
    "seen": "SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY round(score, 9) DESC, prank) AS place FROM shares, range(5) r(c) WHERE c < chunks AND prank < (c + 1) * width",
    "quota": "SELECT DISTINCT query_id, doc_id FROM seen WHERE place <= top * (c + 1) // chunks",
    "docb": "SELECT query_id, doc_id, sum(m) AS score FROM (SELECT query_id, doc_id, q_pos, max((list_inner_product(o, c) - 15.5 * total) * fb) AS m FROM quota JOIN tokens USING (doc_id) JOIN full_code USING (token_id) JOIN qrot USING (query_id) GROUP BY ALL) GROUP BY ALL",
    "top": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC)::INT AS rank, doc_id, score FROM docb QUALIFY rank <= 10",
    "exact_doc": "SELECT query_id, doc_id, sum(m) AS score FROM (SELECT query_id, doc_id, q_pos, max(list_inner_product(q.e, t.e)) AS m FROM qtok q, tokens t GROUP BY ALL) GROUP BY ALL",
    "exact": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC)::INT AS rank, doc_id, score FROM exact_doc QUALIFY rank <= 10",
    "per_cluster": "SELECT cluster_id, count(*) AS tokens, count(DISTINCT doc_id) AS docs FROM assigned GROUP BY cluster_id",
}

TOP = "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM top"

FINAL = {
    "token_doc_map": "SELECT token_id, doc_id FROM tokens",
    "doc_offsets": "SELECT doc_id, doc_len, first_token, end_token FROM docs",
    "doc_len_stats": "SELECT (SELECT count(*) FROM tokens) AS n_tokens, (SELECT min(len(e))::INT FROM tokens) AS dim_least, (SELECT max(len(e))::INT FROM tokens) AS dim_most, count(*) AS n_docs, min(doc_len) AS len_least, max(doc_len) AS len_most, sum(doc_len)::BIGINT AS len_total FROM docs",
    "centroid_sample": "SELECT cluster_id, token_id FROM centroids",
    "assign_nearest": "SELECT token_id, cluster_id FROM assigned",
    "ivf_postings": "SELECT row_number() OVER (ORDER BY cluster_id, token_id) - 1 AS cluster_position, cluster_id, token_id, doc_id FROM assigned",
    "cluster_offsets": "SELECT cluster_id, n, coalesce(sum(n) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_position FROM (SELECT c.cluster_id, count(a.token_id) AS n FROM centroids c LEFT JOIN assigned a USING (cluster_id) GROUP BY c.cluster_id)",
    "cluster_stats_bounds": "SELECT (SELECT max(tokens)::BIGINT FROM per_cluster) AS max_cluster, (SELECT sum(tokens)::BIGINT FROM (SELECT tokens FROM per_cluster ORDER BY tokens DESC LIMIT (SELECT nprobe FROM opt))) AS token_bound, (SELECT sum(docs)::BIGINT FROM (SELECT docs FROM per_cluster ORDER BY docs DESC LIMIT (SELECT nprobe FROM opt))) AS doc_bound",
    "refined_token_bound": "SELECT sum(doc_len)::BIGINT AS token_bound FROM (SELECT doc_len FROM docs ORDER BY doc_len DESC LIMIT (SELECT k_refine FROM opt))",
    "rotate_tokens": "SELECT token_id, i::INT AS dim, round(x, 6) + 0.0 AS value FROM rot3",
    "onebit_codes": "SELECT token_id, "
    + ", ".join(f"sum(CASE WHEN x > 0 AND i // 32 = {k} THEN 1::BIGINT << (i % 32)::INT ELSE 0 END)::BIGINT AS w{k}" for k in range(4))
    + " FROM rot3 GROUP BY token_id",
    "onebit_factor": "SELECT token_id, round(f1, 8) AS f1 FROM onebit",
    "rescale_sweep": "SELECT token_id, round(t, 6) AS t FROM best",
    "ex_codes": "SELECT token_id, string_agg(c::VARCHAR, ',' ORDER BY i) AS code FROM ex GROUP BY token_id",
    "full_codes": "SELECT token_id, string_agg(c::VARCHAR, ',' ORDER BY i) AS code FROM total GROUP BY token_id",
    "full_factor": "SELECT token_id, round(fb, 9) AS fb FROM full_code",
    "query_state": "SELECT query_id, q_pos, round(total * 0.5, 6) AS cb1_sumq, round(total * 15.5, 6) AS cbex_sumq FROM qrot",
    "onebit_lut": "SELECT query_id, q_pos, c::INT AS chunk, n::INT AS entry, round(" + " + ".join(f"((n >> {k}) & 1) * o[4 * c + {k + 1}]" for k in range(4)) + ", 6) + 0.0 AS value FROM qrot, range(32) a(c), range(16) b(n)",
    "probe_topn": "SELECT query_id, q_pos, cluster_id, rank FROM probes",
    "candidate_docs": "SELECT query_id, doc_id FROM cand",
    "candidate_counts": "SELECT query_id, count(*) AS n FROM cand GROUP BY query_id",
    "partial_scores": "SELECT query_id, doc_id, round(score, 6) AS score FROM part",
    "refine_topk": "SELECT query_id, doc_id, prank FROM refined",
    "refined_offsets": "SELECT query_id, prank, doc_id, doc_len, coalesce(sum(doc_len) OVER (PARTITION BY query_id ORDER BY prank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_place FROM refined JOIN docs USING (doc_id)",
    "refined_tokens": "SELECT query_id, doc_id, token_id FROM refined JOIN tokens USING (doc_id)",
    "onebit_token_scores": "SELECT query_id, token_id, q_pos, round(score, 6) + 0.0 AS score FROM tok1",
    "onebit_doc_scores": "SELECT query_id, doc_id, round(score, 6) AS score FROM doc1",
    "chunk_quota": "SELECT query_id, doc_id FROM quota",
    "fullbit_scores": "SELECT query_id, doc_id, round(score, 6) AS score FROM docb",
    "search_topk": TOP,
    "index_roundtrip": TOP,
    "exact_maxsim_topk": "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM exact",
    "recall_at_k": "SELECT 10 AS k, round(count(*) / (10 * (SELECT count(DISTINCT query_id) FROM qtok)), 6) AS recall FROM exact e SEMI JOIN top t ON e.query_id = t.query_id AND e.doc_id = t.doc_id",
    "latency_percentiles": "SELECT round(avg(value), 6) AS mean, round(min(value), 6) AS min, "
    + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(100 * q)}" for q in (0.5, 0.9, 0.95, 0.99))
    + ", round(max(value), 6) AS max, round(stddev_pop(value), 6) AS stddev FROM events",
    "gt_tsv_parse": "SELECT query_id, doc_id::BIGINT AS doc_id, rank FROM exact",
    "mvbin_roundtrip": "SELECT 'token' AS kind, token_id AS id, 0 AS place, round(list_sum(e), 6) + 0.0 AS value FROM tok UNION ALL SELECT 'doc', doc_id::BIGINT, 0, doc_len::DOUBLE FROM docs UNION ALL SELECT 'query', query_id::BIGINT, p::INT, round(list_sum(e), 6) + 0.0 FROM qtok JOIN (SELECT query_id, count(*) AS n FROM qtok GROUP BY query_id) USING (query_id), range(4) r(p) WHERE p % n = q_pos",
}


def _needs(sql: str) -> list[str]:
    return [name for name in STEPS if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql)]


def assemble(sql: str, **other: str) -> str:
    """``sql`` with the steps it needs, in order; ``other`` steps replace those above."""
    steps, found = STEPS | other, []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in found:
                visit(steps[name])
                found.append(name)

    visit(sql)
    # Steps that several others read are computed once.
    return ("WITH " + ", ".join(f"{name} AS MATERIALIZED ({steps[name]})" for name in found) + " " if found else "") + sql


ORACLE_SQL = {name: assemble(sql) for name, sql in FINAL.items()}
