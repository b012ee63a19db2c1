"""The registered queries over whole tables, against their contracts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_point
from tokenweave.llm import latent, lattice_lm, quality_rules, sharding
from tokenweave.llm.queries import BPE, PIECES, QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def answers(spark):
    known = {}
    return lambda name: known.setdefault(name, entry_point.queries()[name](spark, SF).collect())


def encoded():
    from tokenizers import Tokenizer

    use = Tokenizer.from_file(public_tokenizers.path(BPE))
    return {d: use.encode(t or "", add_special_tokens=False).ids for d, t in DOCS}


def test_all_ten_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11)) and set(QUERIES) <= set(entry_point.queries())


def test_op1_token_files(answers):
    start, ids = 0, encoded()
    got = {r["doc_id"]: tuple(r)[1:] for r in answers("op1_token_files")}
    for d in sorted(ids):
        own = [*ids[d], 2]
        assert got[d] == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(got) == len(DOCS)


def test_op3_base(answers):
    count, docs = Counter(), 0
    for d, t in DOCS:
        if not held(d):
            count.update(brute.words(t, True))
            docs += 1
    n, v = sum(count.values()) + docs, len(count) + 1
    got = {r["doc_id"]: r for r in answers("op3_lattice_lm")}
    assert len(got) == len(DOCS)
    for d, t in DOCS:
        w, r = brute.words(t, True), got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert math.isclose(r["base_score"], sum(math.log10((c + 1) / (n + v + 1)) for c in (*(count[x] for x in w), docs)), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_op3_score_against_all_segmentations(make):
    path = public_tokenizers.path(PIECES)
    use = lattice_lm.lattice(path)
    texts = ["the cat the dog", "ein Hund the", "cat ß② cat", "", None, "dog dog dog Hund a", "new words", "the zoo", "a b c d e f", "cat's the", "x", "the the"]
    rows = [(d, t) for d, t in enumerate([*texts, *texts[:4]])] + [(None, "cat and dog")]
    assert sum(held(d) for d, _ in rows) > 0
    want = brute.lattice_scores(rows, held, lattice_lm.starting_weights(path).tolist(), {use.vocab.pieces[i]: i for i in use.vocab.plain}, use.vocab.fallback)
    got = {r["doc_id"]: r["score"] for r in lattice_lm.lm_scores(make(rows), path).collect()}
    assert len(got) == len(rows)
    for (d, _), value in zip(rows, want, strict=True):
        assert math.isclose(got[d], value / math.log(10), rel_tol=1e-5)


def test_latent_classes_are_found():
    r = np.random.default_rng(2)
    x = np.zeros((200, latent.BUCKETS))
    for k, row in enumerate(x):
        np.add.at(row, r.integers(0, 500, 200) + 500 * (k % 2), 1)
    found = latent.fitted(x)
    assert found.classes == 2
    kind = found.scores(x).argmax(axis=1)
    assert len(set(kind[::2])) == 1 and len(set(kind[1::2])) == 1 and kind[0] != kind[1]
    assert latent.fitted(x[:0]).classes == 1


def test_op4_counts_and_verdict(spark, answers):
    from tokenweave.llm.queries import table

    docs = table(spark, SF, "documents")
    rules = quality_rules.fit(docs, table(spark, SF, "labels"))
    ratios = quality_rules.ratio_columns()
    values = {r["doc_id"]: np.array([r[1:]], float) for r in quality_rules.with_counts(docs.select("doc_id", "text")).select("doc_id", *(c.alias(k) for k, c in ratios.items())).collect()}
    assert rules
    got = {r["doc_id"]: r for r in answers("op4_quality_rules")}
    assert len(got) == len(DOCS)
    for d, t in DOCS:
        w, r = brute.words(t), got[d]
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        repeated = brute.repeat_words(w)
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), repeated)
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
        first = next((k for k, rule in enumerate(rules, 1) if rule.holds(values[d], list(ratios))[0]), 0)
        assert r["rule"] == first and r["kept"] == (not failed and not first)


def test_covering_goes_on_while_rules_hold():
    """Twenty kinds of rejects, one for each ratio, and a noisy one that no rule may take."""
    r = np.random.default_rng(5)
    x = r.random((6000, 20)) * 0.9
    bad = np.zeros(len(x), bool)
    for k in range(20):
        own = slice(k * 60, k * 60 + 60)
        x[own, k], bad[own] = 1.0, True
    bad[3000:3020] = True
    rules = quality_rules.learn_rules(x, bad, [f"r{k}" for k in range(20)])
    hit = np.any([rule.holds(x, [f"r{k}" for k in range(20)]) for rule in rules], axis=0)
    assert len(rules) >= 18 and hit[:1200].mean() > 0.9 and hit[1200:3000].mean() < 0.01


def test_op6_articles(answers):
    import html

    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in answers("op6_html_text")}
    for p in pages:
        m = re.search(r"<article>(.*?)(</article>|$)", p["html"] or "", re.S)
        parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", m[1]) if m else "")]
        r = got[p["page_id"]]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def test_op7_law(answers):
    rows, text = answers("op7_sharding"), dict(DOCS)
    shards = {}
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(DOCS) and set(shards) <= set(range(24)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op9_totals(answers):
    lengths = [len(x) for x in encoded().values()]
    got = answers("op9_token_counts")
    assert sorted(r["context_limit"] for r in got) == sorted(set(lengths))
    for r in got:
        assert r["tokens_kept"] == sum(min(n, r["context_limit"]) for n in lengths) and r["docs_cut"] == sum(n > r["context_limit"] for n in lengths)


def test_op10_round_trip(answers):
    got = answers("op10_sentencepiece")
    assert len(got) == len(DOCS) and all(r["exact"] for r in got)


def test_propagation_moves_like_a_plain_simulation(spark):
    """With room in every shard, one round moves each asker to the shard most of its neighbours are in."""
    links = [(k, 0) for k in range(1, 30)] + [(k, 40) for k in range(41, 60)]
    nodes = sorted({x for pair in links for x in pair})
    start = {x: x % 3 for x in nodes}
    linked = spark.createDataFrame([(x, start[x], 0 if x < 40 else 40) for x in nodes], "node long, shard int, hub long")
    got = {r["node"]: r["shard"] for r in sharding.propagate(linked, spark.createDataFrame(links, "a long, b long"), 3000, 3, 1).collect()}
    near = {x: Counter() for x in nodes}
    for a, b in links:
        near[a][start[b]] += 1
        near[b][start[a]] += 1
    for x in nodes:
        votes, best = max((n, s) for s, n in near[x].items())
        centre = all(x < (b if a == x else a) for a, b in links if x in (a, b))
        moves = not centre and votes > near[x][start[x]]
        assert got[x] == (best if moves else start[x])


def test_op3_classes_are_learned_from_all_training_texts(spark, make, monkeypatch):
    """Texts beyond the sample change the model: every training word counts in its classes."""
    r = np.random.default_rng(4)
    rows = [(d, " ".join(f"w{x}" for x in r.integers(0, 300, 60) + 300 * (d % 2))) for d in range(600)]
    seen, learn = [], lattice_lm.learned

    def watched(first, sums):
        found = learn(first, sums)
        seen.append((found, sums([found], True)[0]))
        return found

    monkeypatch.setattr(lattice_lm, "learned", watched)
    got = lattice_lm.lm_scores(make(rows), public_tokenizers.path(PIECES), sample=50)
    training = [d for d, _ in rows if not held(d)]
    mixture, sums = seen[0]
    assert got.count() == 600 and mixture.classes == 2
    assert math.isclose(sums.size.sum(), len(training)) and math.isclose(sums.count.sum(), 60 * len(training))
    assert sorted(np.round(sums.size).astype(int)) == sorted(sum(d % 2 == k for d in training) for k in (0, 1))
