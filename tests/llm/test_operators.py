"""Each operator against brute force on small tables, and its defined results at the edges."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenweave.llm import decontamination, html_text, jaccard_join, lattice_lm, quality_rules, sentencepieces, sharding, substring_dedup, textops, token_counts, token_files
from tokenweave.llm.components import components
from tokenweave.llm.fm_index import FMIndex
from tokenweave.llm.store import fresh_path

from . import brute

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Zwei Wörter"), (6, "a a a a a a a a a a " * 40), (7, "x" * 30_000), (None, "text without an id, twice"), (8, "▁ literal ▁▁ mark  and double  spaces\x0bhere   ok")]


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.random() ** 2 * vocabulary)}" for _ in range(n))


def corpus(seed=3, n=60):
    """Documents with copies, near copies and shared passages."""
    r = random.Random(seed)
    rows, passage = [], prose(99, 55)
    for d in range(n):
        kind = r.random()
        if rows and kind < 0.2:
            text = r.choice(rows)[1]
        elif rows and kind < 0.5:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            text = " ".join(w)
        elif kind < 0.65:
            text = f"{prose(d, 40)} {passage} {prose(d + 1000, 30)}"
        else:
            text = prose(d, r.choice([3, 10, 25, 120, 300]))
        rows.append((d, text))
    r.shuffle(rows)
    return rows


# --- text primitives ------------------------------------------------------------------------


def test_words_and_windows():
    texts = ["a b  c", None, "", " \n", "héllo\tx", "one two three four"]
    w = textops.words(pa.array(texts))
    got = [[bytes(w.data[s:e]) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [brute.words(t) for t in texts]
    h = textops.words(pa.array(["p q r s t u v w p q r s t u v w"])).hash
    for size in (1, 3, 8):
        assert textops.window_hashes(h, size)[0] == textops.window_hashes(h, size)[8]
        assert len(set(textops.window_hashes(h, size)[:8].tolist())) == 8
    assert textops.span_sequence_hashes(h, np.array([0, 8]), np.array([5, 5])).tolist()[0] == textops.span_sequence_hashes(h, np.array([8]), np.array([5]))[0]


def test_shingle_sets_match_brute_force():
    texts = [t for _, t in corpus()] + [t for _, t in EDGES]
    values, bounds = textops.shingle_sets(textops.words(pa.array(texts), lower=True), 3)
    assert np.diff(bounds).tolist() == [len(brute.shingles(t, 3)) for t in texts]


# --- 1 and 9: token files and counts -----------------------------------------------------------


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_added_tokens_and_small_caches(monkeypatch):
    from tokenweave.llm import bpe

    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b  c", "a\n<|endoftext|>", "plain text, 'tis", "", *(t or "" for _, t in EDGES), *(t for _, t in corpus(n=30))]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    monkeypatch.setattr(sentencepieces, "CACHE_BYTES", 2000)
    use, pieces = bpe.BpeEncoder(BPE), sentencepieces.PieceCoder(sentencepieces.vocabulary(PIECES))
    for _ in range(2):
        for b in range(0, len(texts), 7):
            assert [np.frombuffer(x, use.dtype).tolist() for x in use.encode(texts[b : b + 7])] == [encoded(x) for x in texts[b : b + 7]]
    assert all(pieces.decode(pieces.encode(x)) == x for x in texts)
    assert 50256 in encoded(texts[0])


def test_token_files_round_trip(spark, make):
    rows = EDGES + corpus(n=20)[:5] + [(40, "a <|endoftext|> b  c"), (4, "one again"), (4, "one again")]
    files = token_files.write_token_files(make(rows), fresh_path(spark, "t"), BPE, 2, partitions=3)
    got = [tuple(r) for r in files.read(spark).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    start, expected = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encoded(t) + [2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    opened = token_files.TokenFiles.open(files.path)
    assert sum(len(ids) for k in range(len(opened.parts)) for _, ids in opened.documents(k)) == start


def test_token_files_of_nothing(spark, make):
    files = token_files.write_token_files(make([]), fresh_path(spark, "t"), BPE, 2)
    assert files.read(spark).count() == 0


def test_token_counts(spark, make):
    rows = EDGES + corpus(n=20)
    lengths = [len(encoded(t)) for _, t in rows]
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(make(rows), BPE))
    for r in token_counts.context_table(histogram).collect():
        limit = r["context_limit"]
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_cut"] == sum(n > limit for n in lengths) and r["docs_whole"] == sum(n <= limit for n in lengths)
        assert r["tokens_kept"] == sum(min(n, limit) for n in lengths) and r["tokens_lost"] == sum(max(n - limit, 0) for n in lengths)
        assert r["tokens_total"] == sum(lengths)
    for r in token_counts.totals_at(histogram, [0, 7, 10**6]).collect():
        assert r["tokens_kept"] == sum(min(n, r["context_limit"]) for n in lengths)
    for r in token_counts.quantiles(histogram, [0.5, 1.0]).collect():
        assert r["n_tokens"] == sorted(lengths)[math.ceil(r["share"] * len(lengths)) - 1]
    assert token_counts.context_table(token_counts.length_histogram(token_counts.encoded_lengths(make([]), BPE))).count() == 0


# --- 2: substring dedup -----------------------------------------------------------------------


def test_fm_index_counts():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 3, n).astype(np.uint64) for n in (30, 25, 40, 22)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for window in (3, 5, 8):
        index = FMIndex(np.concatenate(parts), bounds, window)
        all_windows = Counter(tuple(p[i : i + window].tolist()) for p in parts for i in range(len(p) - window + 1))
        asked = np.array([*all_windows, tuple([9] * window)], np.uint64)
        assert index.count(asked).tolist() == [*all_windows.values(), 0]
        at, run = index.windows_of_parts()
        assert len(at) == sum(n for n in all_windows.values() if n > 1)
        seen = {}
        for x, k in zip(at.tolist(), run.tolist(), strict=True):
            seen.setdefault(k, set()).add(tuple(index.alphabet[index.text[x : x + window] - index.offset].tolist()))
        assert all(len(v) == 1 for v in seen.values()) and len(seen) == sum(n > 1 for n in all_windows.values())


@pytest.mark.parametrize(("window", "hot"), [(10, 50_000), (20, 50_000), (20, 3)])
def test_substring_dedup_against_brute_force(make, monkeypatch, window, hot):
    monkeypatch.setattr(substring_dedup.repeated_spans, "__defaults__", (window, hot))
    rows = [r for r in EDGES if r[0] is not None] + [(d + 100, t) for d, t in corpus(5, 70)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removed_words(make(rows), window).collect()}
    assert got == brute.removed(rows, window)


def test_substring_dedup_of_twins_in_small_shards(make, monkeypatch):
    """Rows of one id with different texts, shards of a few segments, and a short memory."""
    monkeypatch.setattr(substring_dedup, "SHARD_SYMBOLS", 200)
    monkeypatch.setattr(substring_dedup, "REMEMBERED", 5)
    p, q = prose(1, 45), prose(2, 60)
    rows = [(1, p), (2, f"{p} {prose(3, 30)}"), (2, f"{p} {prose(4, 30)}"), (3, f"{q} {p}"), (4, q), (4, f"{prose(5, 9)} {q}")]
    rows += [(d + 100, t) for d, t in corpus(5, 70)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.removed_words(make(rows)).where("doc_id < 100").collect())
    assert got == [(1, 45, 0), (2, 75, 45), (2, 75, 45), (3, 105, 45), (4, 60, 60), (4, 69, 60)]
    rest = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removed_words(make(rows[6:])).collect()}
    assert rest == brute.removed(rows[6:])


def test_substring_dedup_edges(make):
    long = prose(1, 50)
    docs = make([(1, long), (1, long), (2, f"{long} {prose(2, 30)}"), (None, f"{prose(3, 25)} end")])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.removed_words(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 50)]
    out = substring_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r["text"] for r in out.where("doc_id = 2").collect()} == {prose(2, 30)}
    assert out.where("_doc <> 9 or _row <> 'x'").count() == 0
    assert substring_dedup.removed_words(make([])).count() == 0


# --- 3: lattice scores --------------------------------------------------------------------------


def test_lattice_forward_matches_all_segmentations():
    use, logp = lattice_lm.lattice(PIECES), lattice_lm.starting_weights(PIECES)
    assert abs(np.exp(logp[np.isfinite(logp)]).sum() - 1) < 1e-9
    ids = {use.vocab.pieces[i]: i for i in use.vocab.plain}

    def total(word):
        s = "▁" + word.replace("▁", "﷐")
        a = [0.0] + [-math.inf] * len(s)
        for e in range(1, len(s) + 1):
            arcs = [a[b] + logp[ids[s[b:e]]] for b in range(max(0, e - 16), e) if s[b:e] in ids]
            if s[e - 1] not in use.vocab.single:
                arcs.append(a[e - 1] + sum(logp[i] for i in use.vocab.fallback("▁" if s[e - 1] == "﷐" else s[e - 1])))
            a[e] = brute.log_sum(arcs)
        return a[-1]

    words = ["the", "thertion", "êeux***", "①x", "a▁b", "x", "ß②日" * 3, "y" * 300]
    assert np.allclose(use.forward(words, logp)[0], [total(w) for w in words])
    expected, likelihood = use.expected(words, np.ones(len(words)), logp)
    assert abs(likelihood - sum(map(total, words))) < 1e-6
    # The pieces expected of a word spell it: expected lengths add up to the text's.
    plain = np.array(use.vocab.plain)
    only, _ = use.expected(["thertion", "the"], np.array([1.0, 2.0]), logp)
    assert abs((only[plain] * use.length[plain]).sum() - (9 + 2 * 4)) < 1e-6 and expected.sum() > 0


def test_lattice_scores(spark, make):
    rows = EDGES + [(d + 100, t) for d, t in corpus(5, 70)]
    got = lattice_lm.lm_scores(make(rows), PIECES).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts, docs = Counter(), 0
    for d, t in rows:
        if not held(d):
            counts.update(brute.words(t, True))
            docs += 1
    n, v = sum(counts.values()) + docs, len(counts) + 1
    by_id = {r["doc_id"]: r for r in got}
    for d, t in rows:
        w = brute.words(t, True)
        r = by_id[d]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((docs + 1) / (n + v + 1))
        assert r["held_out"] == held(d) and r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[x] > 0 for x in w) + 1 and abs(r["base_score"] - base) < 1e-6
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lattice_lm.lm_scores(make([]), PIECES).count() == 0


def test_lattice_model_prefers_its_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    shuffled = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.translate("text", "abcdefghijklmnop", "qzxjkvwqzxjkvwqz").alias("text")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    got = lattice_lm.lm_scores(docs.unionByName(shuffled), PIECES).where("held_out").groupBy(F.expr("doc_id >= 1000000").alias("shuffled")).agg((F.sum("score") / F.sum("n_tokens")).alias("mean")).collect()
    means = {r["shuffled"]: r["mean"] for r in got}
    assert means[False] > means[True] + 2


# --- 4: quality rules ---------------------------------------------------------------------------


def test_text_counts_against_brute_force(make):
    rows = EDGES + corpus(7, 30) + [(500, "A line | x\nA line | x\n\n \nB#1% <c>\nA line | x")]
    for r, (_, t) in zip(quality_rules.with_counts(make(rows).coalesce(1)).collect(), rows, strict=True):
        w = brute.words(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_lines"] == len(lines)
        assert r["n_repeat_words"] == brute.repeat_words(w) and r["n_distinct_words"] == len(set(w))


def test_learned_rules_generalise(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs.where("doc_id % 2 = 0"), labels)
    assert rules and all(str(r) for r in rules)
    got = quality_rules.judged(docs.where("doc_id % 2 = 1"), rules).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)] and n.get((0, True), 0) <= 0.1 * max(1, n.get((0, False), 0))


def test_quality_rules_edges(spark, make):
    labels = spark.createDataFrame([(1, None, None), (None, 0, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make(EDGES + [(60, prose(1, 90))])
    assert quality_rules.fit(docs, labels) == [] and quality_rules.fit(make([]), labels.limit(0)) == []
    assert quality_rules.judged(docs, []).count() == len(EDGES) + 1
    kept = quality_rules.accepted(docs, [])
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [60]


# --- 5: decontamination -------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, make):
    r = random.Random(4)
    items = [(k, prose(k + 500, n)) for k, n in enumerate([15, 38, 38, 57, 5, 3, 90])] + [(50, None), (51, ""), (52, prose(501, 38))]
    docs = [(d, prose(d, 120)) for d in range(20)]
    for d in range(20, 60):
        w = r.choice([x for _, x in items if x]).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        docs.append((d, f"{prose(d, r.choice([0, 30]))} {' '.join(w).upper() if d % 5 == 0 else ' '.join(w)} {prose(d + 7, r.choice([0, 40]))}".strip()))
    docs += [(d + 1000, t) for d, t in EDGES if d]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(make(docs), table).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == brute.leaks(docs, items)
    assert all(x["similarity"] >= 0.8 and x["distance"] <= decontamination.RADIUS for x in got)
    few = decontamination.contaminated(make(docs), table, block_bytes=800)
    assert {(x["doc_id"], x["item_id"]) for x in few.collect()} == {(x["doc_id"], x["item_id"]) for x in got}
    clean = decontamination.clean(make(docs), table)
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in docs} - {x["doc_id"] for x in got} and clean.columns == make([]).columns
    assert decontamination.contaminated(make([]), table).count() == 0
    assert decontamination.contaminated(make(docs), table.limit(0)).count() == 0


def test_windows_in_slices_and_listed_candidates(monkeypatch):
    """A long text, slices shorter than it, and block lists in place of comparisons with all items."""
    items = [prose(k + 500, n) for k, n in enumerate([15, 38, 38, 38, 57, 300, 4])]
    w = prose(9, 6000).split()
    for k, at in enumerate((0, 700, 2100, 3000, 4000, 5000, 5900)):
        w[at : at + len(items[k].split())] = items[k].split()
    w[2110] = "changed"
    texts = pa.array([" ".join(w), " ".join(items[5].split()[:260]), None, items[0], "a " * 3000])
    found = []
    for size, few in ((decontamination.SLICE, 16), (64, 16), (64, 0)):
        monkeypatch.setattr(decontamination, "SLICE", size)
        monkeypatch.setattr(decontamination, "FEW", few)
        index = decontamination.BenchmarkIndex(list(range(len(items))), pa.array(items), 5, 0.8, decontamination.RADIUS)
        found.append(list(index.search(textops.words(texts, lower=True))))
    assert found[0] == found[1] == found[2]
    assert {x[:2] for x in found[0]} == brute.leaks(enumerate(texts.to_pylist()), list(enumerate(items)))


def test_radius_keeps_similar_windows():
    """Of windows at similarity 0.8 and over, the radius keeps nearly all."""
    r, kept, n = np.random.default_rng(1), 0, 0
    for _ in range(4000):
        size = int(r.integers(15, 120))
        a = textops.mix64(r.integers(0, 2**63, size).astype(np.uint64))
        b = a.copy()
        b[r.choice(size, int(r.integers(1, 4)), replace=False)] = textops.mix64(r.integers(0, 2**63, 1).astype(np.uint64))
        a, b = textops.window_hashes(a, 5), textops.window_hashes(b, 5)
        if decontamination.similarity(b, np.unique(a, return_counts=True)) >= 0.8:
            n += 1
            kept += int(np.bitwise_count(decontamination.fingerprint(a) ^ decontamination.fingerprint(b))) <= decontamination.RADIUS
    assert n > 1000 and kept >= 0.98 * n


def test_blocks_of_the_benchmark():
    blocks = decontamination.item_blocks([(3, 10), (5, 80), (6, 30), (9, 500), (10, 5)], 100)
    assert blocks == [(3, 5, 1), (6, 6, 1), (9, 9, 5), (10, 10, 1)]
    assert len(decontamination.item_blocks([(n, 1) for n in range(1, 301)], 10**6)) == 3


# --- 6: HTML ------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><a href="/">Home</a> <p>Site of sites and more words here.</p></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies on this site. Accept all of them now.</div>
<article><h1>Head &amp; line</h1><p>First  paragraph of
the text &lt;ok&gt;.<br>After break.<p>Second <b>bold</b> one &#8212; caf&eacute;.</p><div class="ad">Buy these shoes today, cheap.</div><p>Third paragraph closes the text.</p></article>
<aside><p>Read also: another story about things.</p></aside><form><p>Subscribe by mail to our letter.</p><input></form>
<section id="comments"><p>Nice article, thanks for writing it all down.</p></section><footer>&copy; all of us</footer><!-- <p>hidden</p> --></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst paragraph of the text <ok>. After break.\n\nSecond bold one — café.\n\nThird paragraph closes the text."
    for page in (None, "", "<", "<p", "<!--", "&amp", "<script>x", "<article></article>", "<nav><a href=x>only</a></nav>"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<nav><a href=x>only</a></nav>") == ""


def test_html_svg_and_math():
    page = "<article><p>The first <svg class='i'/> paragraph has an icon in it.</p><p>So we find <math/> that <math><mi>E</mi><mo>=</mo><mrow><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math> holds for all bodies.</p><svg><text>drawn</text></svg><p>The last paragraph closes the text.</p></article>"
    got = [" ".join(b.text for b in html_text.blocks(page)), html_text.main_text(page)]
    for text in got:
        assert "icon in it." in text and "So we find that E=mc2 holds for all bodies." in text and "closes the text." in text and "drawn" not in text


def test_html_siblings_across_adverts():
    advert = "<div class='ad'>Buy these shoes today, cheap.</div>"
    strong = "<p>This is a long paragraph of the text with many words, and all of them belong to the story that is told.</p>"
    found = html_text.blocks(f"<div>{strong}{advert}<p>A weak one</p>{advert}{strong}</div>")
    assert set(html_text.neighbours(found)) == {(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (2, 4)}
    assert html_text.label(found) == [True, False, True, False, True]


def test_html_wrappers_do_not_hide_the_text():
    inner = "<h1>Title</h1><p>This is a first paragraph of the text, long enough to be one.</p><p>Short.</p>"
    want = "Title\n\nThis is a first paragraph of the text, long enough to be one.\n\nShort."
    wraps = ['<div class="layout has-sidebar">%s</div>', '<div class="page no-comments">%s</div>', '<div id="share-page">%s</div>', '<form id="aspnetForm"><input>%s</form>', '<div class="sidebar-layout">%s</div>']
    for wrap in wraps:
        for tag in ("article", "div", "main"):
            page = f"<body><nav><a href=x>Home</a></nav>{wrap % f'<{tag}>{inner}</{tag}>'}<aside>Read also</aside><footer>All rights</footer></body>"
            assert html_text.main_text(page) == want, page
    comments = '<section id="comments"><article class="comment"><p>I liked this text a lot, thanks for it.</p></article></section>'
    related = '<div class="related-posts"><article><p>Another story that you may like, told today.</p></article></div>'
    assert html_text.main_text(f"<body><article>{inner * 5}</article>{comments}{related}</body>") == "\n\n".join([want] * 5)


def test_html_cut_changes_labels():
    """Blocks whose own score has the other sign: rescued by siblings or an article, or lost to a marked element."""
    strong = "<p>This is a long paragraph of the text with many words, and all of them belong to the story that is told.</p>"
    found = html_text.blocks(f"<div><div>Read on</div>{strong}<div>A weak one</div>{strong}</div><ul><li><a href=x>Home</a><li><a href=y>Shop</a></ul>")
    assert [html_text.score(b.features) > 0 for b in found] == [False, True, False, True, False, False]
    assert html_text.label(found) == [True, True, True, True, False, False]
    found = html_text.blocks(PAGE)
    assert sum((html_text.score(b.features) > 0) != kept for b, kept in zip(found, html_text.label(found), strict=True)) >= 5


def test_html_weights_are_fitted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_text.fit(pages)
    assert weights != html_text.WEIGHTS and weights["paragraph"] > 0 > weights["link_share"]
    x, y = zip(*(html_text.labelled(r["html"]) for r in pages.limit(20).collect()), strict=True)
    x, y = np.array([v for part in x for v in part]), np.array([v for part in y for v in part])
    assert ((x @ np.array(list(weights.values())) > 0) == y).mean() > 0.95
    assert html_text.fit(pages.limit(0)) == html_text.WEIGHTS
    # Without its article element a page still gives its text.
    page = next(r["html"] for r in pages.collect() if r["html"])
    assert html_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>"), weights) == html_text.main_text(page, weights) != ""


def test_html_long_page():
    words = "word " * 200_000
    page = f"<article><p>{words}.</p>{'<p>One more paragraph of this page.</p>' * 3000}</article><footer>end</footer>"
    text = html_text.main_text(page)
    assert text.count("One more") == 3000 and text.count("word") == 200_000 and not text.endswith("end")


def test_minimum_cut_is_minimal():
    r = random.Random(2)
    for _ in range(30):
        n = 7
        gain = [r.uniform(-2, 2) for _ in range(n)]
        tie = [r.uniform(0, 1) for _ in range(n - 1)]
        net = html_text.FlowNetwork(n + 2)
        for k, g in enumerate(gain):
            net.join(n, k, max(g, 0))
            net.join(k, n + 1, max(-g, 0))
        for k, t in enumerate(tie):
            net.join(k, k + 1, t, t)
        cost = lambda x: sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, x, strict=True)) + sum(t for t, a, b in zip(tie, x, x[1:], strict=False) if a != b)
        got = cost(net.source_side(n, n + 1)[:n])
        assert abs(got - min(cost([m >> k & 1 == 1 for k in range(n)]) for m in range(1 << n))) < 1e-9


def test_html_pages(spark):
    import html as h
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r["html"] or "", re.S)
        parts = [re.sub(r"\s+", " ", h.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", m[1]) if m else "")]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)
    odd = spark.createDataFrame([(None, None, None, 3), (1, "u", PAGE, 4), (1, "u", PAGE, 4)], "page_id long, url string, html string, text long")
    assert [r["n_chars"] for r in html_text.extract(odd).orderBy("n_chars").collect()][0] == 0
    assert html_text.extract(odd.limit(0)).count() == 0


# --- 7: sharding --------------------------------------------------------------------------------


def _sharded(df):
    rows = df.collect()
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    return rows, shards


def test_sharding_is_even_and_keeps_copies_together(make):
    rows = [(d, prose(d, 20)) for d in range(400)] + [(1000 + d, f"group {d // 4}") for d in range(200)] + [(2000 + d, "hot") for d in range(250)] + [(d and d + 5000, t) for d, t in EDGES] + [(5004, "one")]
    got, shards = _sharded(sharding.shard_documents(make(rows), shards=6))
    sizes = [len(x) for x in shards.values()]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1 and len(shards) == 6
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
    text = {d: t for d, t in rows}
    for r in got:
        if r["doc_id"] is not None:
            t = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
    cut = sum(len({r["shard"] for r in got if r["doc_id"] and 1000 + 4 * g <= r["doc_id"] < 1004 + 4 * g}) > 1 for g in range(50))
    assert cut <= 5


def test_links_of_copies_are_trees_of_bounded_degree(spark):
    keys = [k for k, n in (("a", 3000), ("b", 40), ("c", 2), ("d", 1)) for _ in range(n)] + [None] * 5
    nodes = spark.createDataFrame([(7 * x, k) for x, k in enumerate(keys)], "node long, key string")
    links = [tuple(r) for r in sharding.copy_links(nodes, len(keys), fan=32).collect()]
    up, near = dict(links), {}
    assert len(up) == len(links) == 2999 + 39 + 1
    for a, b in links:
        assert keys[a // 7] == keys[b // 7] and b < a
        near[b] = near.get(b, 0) + 1
    assert max(near.values()) < 3 * 2 * 32
    for x, k in enumerate(keys):
        end = 7 * x
        while end in up:
            end = up[end]
        assert k is None or end == 7 * keys.index(k)


def test_sharding_edges(make):
    assert sharding.shard_documents(make([]), shards=4).count() == 0
    _, shards = _sharded(sharding.shard_documents(make([(1, "a"), (1, "a"), (None, None)]), shards=24))
    assert sorted(len(x) for x in shards.values()) == [1, 1, 1]


# --- 8: Jaccard join ----------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_against_brute_force(make, size, percent):
    base = prose(77, 200).split()
    r = random.Random(8)
    family = []
    for d in range(40):  # one long list: a group of near copies at all distances
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"m{r.randrange(50)}"
        family.append((500 + d, " ".join(w)))
    rows = [x for x in EDGES if x[0] is not None] + [(d + 100, t) for d, t in corpus(9, 70)] + family + [(900, "ONE")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.linked_components(make(rows), size, percent).collect()}
    assert got == brute.components(rows, size, percent)
    kept = jaccard_join.representatives(make(rows), size, percent)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({c for _, c in got.values()}) and kept.columns == make([]).columns


def test_jaccard_edges(make):
    assert jaccard_join.linked_components(make([])).count() == 0
    text = prose(5, 30)
    got = [(x["doc_id"], x["component_id"]) for x in jaccard_join.linked_components(make([(None, text), (3, text), (3, text), (9, text), (None, None)])).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (3, 3), (9, 3), (None, None)], key=str)
    assert jaccard_join.representatives(make([(3, text), (3, text), (9, text), (None, None)])).count() == 2


def test_representatives_of_repeated_ids(make):
    a, b, c = prose(5, 60), prose(6, 60), prose(7, 60)
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (7, f"{c} more"), (1, c[:40]), (8, None), (8, " ")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.representatives(make(rows)).collect()]
    near = [r for r in kept if r[1] in (c, f"{c} more")]
    assert len(near) == 1 and near[0][0] == 7
    assert sorted((r for r in kept if r not in near), key=str) == sorted([(1, a), (5, b), (1, c[:40]), (8, None), (8, " ")], key=str)


def test_list_skipping_loses_nothing():
    r = np.random.default_rng(5)
    n = np.sort(r.integers(20, 400, 600))
    position = np.array([r.integers(0, max(1, x // 8)) for x in n])
    entries = jaccard_join._List(n, position, 90)
    for k in range(0, 599, 7):
        j = np.arange(k + 1, 600)
        plain = j[(10 * n[k] >= 9 * n[j]) & (np.minimum(n[k] - position[k], n[j] - position[j]) >= jaccard_join.least_overlap(n[k], n[j], 90))]
        assert entries.fitting(k).tolist() == plain.tolist()


def test_components_need_few_rounds(spark, monkeypatch):
    from tokenweave.llm import components as module

    rounds, write = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df, name: rounds.append(name) or write(df, name))
    order = list(range(2000, 3000))
    random.Random(6).shuffle(order)
    rows = [(k, k - 1) for k in range(999, 0, -1)] + list(zip(order, order[1:], strict=False)) + [(5500, k) for k in range(5000, 6000)] + [(7000, 7000), (7001, 7001), (7001, 7002), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1000)} | {k: 2000 for k in range(2000, 3000)} | {k: 5000 for k in range(5000, 6000)} | {7000: 7000, 7001: 7001, 7002: 7001}
    assert rounds.count("edges") - 1 < 15
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_chain(make):
    """Each text differs by one word from the one before, so links form a chain."""
    w = prose(21, 400, 10**6).split()
    rows = []
    for d in range(90, 0, -1):
        w = [*w[4:], *(f"new{d}x{k}" for k in range(4))]
        rows.append((d, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.linked_components(make(rows)).collect()}
    assert got == brute.components(rows) and {c for _, c in got.values()} == {1}


# --- 10: sentence pieces ------------------------------------------------------------------------


def test_viterbi_is_best_and_round_trips(make):
    use = sentencepieces.coder(PIECES)
    v = use.vocab
    score = {v.pieces[i]: v.scores[i] for i in v.plain}
    rows = EDGES + corpus(3, 10)
    for _, t in rows:
        assert use.decode(use.encode(t or "")) == (t or "")
    for word in ["▁the", "▁▁▁lead", "▁日①x", "▁" + "ab" * 40, *("▁" + w for w in prose(3, 30).split())]:
        best = [0.0] + [-math.inf] * len(word)
        for e in range(1, len(word) + 1):
            for b in range(max(0, e - 16), e):
                w = score.get(word[b:e], v.floor * len(word[b:e].encode()) if e - b == 1 and word[b:e] not in score else -math.inf)
                best[e] = max(best[e], best[b] + w)
        ids = use.viterbi(word)
        assert abs(sum(v.scores[i] if i not in set(v.byte_ids.values()) else v.floor for i in ids) - best[-1]) < 1e-3
    docs = make(rows)
    coded = sentencepieces.encode(docs, PIECES)
    assert coded.columns == [*docs.columns, "piece_ids"]
    back = sentencepieces.decode(coded, PIECES)
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert sentencepieces.round_trip(docs, PIECES).where("not exact").count() == 0
    assert sentencepieces.round_trip(make([]), PIECES).count() == 0
