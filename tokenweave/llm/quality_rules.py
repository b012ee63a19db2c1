"""Operator 4: quality rules as a learned decision list.

Sequential covering: rules that predict *reject* are grown one at a time on two
thirds of the labelled statistics (adding the threshold with the highest
information gain), pruned on the rest, and kept while their pruned precision
holds; covered rows are then set aside.  The ordered list becomes one Spark
conditional expression, so applying it is a projection.

The fit sees at most ``max_labelled`` labelled documents (a documented bound,
chosen by a hash of the id); statistics are computed for every document.

Defined results: null text has no words and fails the base rule; without labels
of both kinds the list is empty and keeps what the base rule keeps; repeated
rows are judged alike; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .textops import chunks, full_windows, mix64, raw, window_hashes, words

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bars", "n_marks", "n_distinct_words")
_SYMBOL, _UPPER, _DIGIT, _BAR, _MARK = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_BAR[ord("|")] = True
_MARK[list(b"!?")] = True
_BLANK = " \t\n\r\x0b\x0c"


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of COUNTS for a run of rows."""
    w = words(texts)
    n = len(w.first) - 1
    _, offsets = raw(texts)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    inner = np.zeros(len(w.data) + 1, np.int8)
    inner[w.start] += 1
    inner[w.end] -= 1
    in_word = np.cumsum(inner[:-1]).astype(bool)
    at, row = full_windows(w.first, WINDOW)
    value = mix64(window_hashes(w.hash, WINDOW)[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(at) else np.zeros(0, np.uint64)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(w.hash) + 1, np.int64)
    if len(twice):
        hit = at[twice[np.minimum(np.searchsorted(twice, value), len(twice) - 1)] == value]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])[w.first]
    own = np.sort(mix64(w.hash + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    back = mix64(w.hash + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(back, kind="stable")
    first_seen = np.zeros(len(back), np.int64)
    first_seen[order[fresh]] = 1
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text:
            full = [x for x in text.split("\n") if x.strip(_BLANK)]
            lines[k], dup[k] = len(full), len(full) - len(set(full))
    return {
        "n_words": np.diff(w.first),
        "word_chars": total(in_word & ((w.data & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[w.data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.diff(repeated),
        "n_lines": lines,
        "n_upper": total(_UPPER[w.data]),
        "n_digits": total(_DIGIT[w.data]),
        "n_bars": total(_BAR[w.data]),
        "n_marks": total(_MARK[w.data]),
        "n_distinct_words": np.diff(np.concatenate([[0], np.cumsum(first_seen)])[w.first]),
    }


def with_counts(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``id_column`` and COUNTS for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for b, e in chunks(texts):
                got = text_counts(texts.slice(b, e - b))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b, e - b), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=[id_column, *COUNTS])

    schema = T.StructType([docs.schema[id_column], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.select(id_column, text).mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Interpretable ratios the rules test: name -> (numerator, denominator).
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "bars_per_word": ("n_bars", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "words": ("n_words", None),
}


def ratio_columns() -> dict[str, Column]:
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return {k: (F.col(a) / one(b) if b else F.col(a).cast("double")) for k, (a, b) in RATIOS.items()}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (ratio, is_at_least, threshold); rows that meet it are rejected."""

    tests: tuple[tuple[str, bool, float], ...]
    covered: int = 0
    precision: float = 1.0

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, at_least, cut in self.tests:
            v = x[:, names.index(name)]
            hit &= (v >= cut) if at_least else (v < cut)
        return hit

    def column(self, ratios: dict[str, Column]) -> Column:
        hit = F.lit(True)
        for name, at_least, cut in self.tests:
            hit = hit & ((ratios[name] >= F.lit(cut)) if at_least else (ratios[name] < F.lit(cut)))
        return hit

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {cut:.6g}" for n, up, cut in self.tests) or "always"


def _best_test(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold of highest FOIL gain over all ratios, both directions."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best, found = 1e-9, None
    start = np.log2(p0 / (p0 + n0))
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, b = x[order, k], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below = np.concatenate([[0], np.cumsum(b)])[cut]
        for at_least, p, size in ((False, below, cut), (True, p0 - below, len(v) - cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / size) - start), -1)
            j = int(np.argmax(gain))
            if gain[j] > best:
                best, found = float(gain[j]), (name, at_least, float((v[cut[j] - 1] + v[cut[j]]) / 2))
    return best, found


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], max_tests: int = 4, least_precision: float = 0.9, splits: int = 3, seed: int = 1) -> list[Rule]:
    """Sequential covering with pruning; x is (rows, ratios), bad marks rejects.

    A rule is grown on two thirds of the rows and must hold its precision on the
    rest.  The list ends when rules from ``splits`` splits in a row did not, or
    fewer than three rejects are left.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    failed = 0
    while failed < splits and bad.sum() >= 3:
        failed += 1
        grow = rng.random(len(x)) < 2 / 3
        if not bad[grow].any() or bad[grow].all() or not bad[~grow].any():
            continue
        tests, gx, gb = [], x[grow], bad[grow]
        while len(tests) < max_tests and gb.any() and not gb.all():
            _, test = _best_test(gx, gb, names)
            if test is None:
                break
            tests.append(test)
            hit = Rule((test,)).holds(gx, names)
            gx, gb = gx[hit], gb[hit]
        choices = []
        for n in range(1, len(tests) + 1):
            hit = Rule(tuple(tests[:n])).holds(x[~grow], names)
            good, wrong = int(bad[~grow][hit].sum()), int((~bad[~grow])[hit].sum())
            choices.append(((good - wrong) / max(good + wrong, 1), good, -n, n, good / max(good + wrong, 1)))
        if not choices:
            continue
        _, good, _, n, precision = max(choices)
        rule = Rule(tuple(tests[:n]))
        hit = rule.holds(x, names)
        if not good or precision < least_precision or bad[hit].mean() < least_precision:
            continue
        failed = 0
        rules.append(Rule(rule.tests, int(hit.sum()), float(bad[hit].mean())))
        x, bad = x[~hit], bad[~hit]
    return rules


def rejects(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the number of the first
    rule that holds (from 1), or 0."""
    ratios, out = ratio_columns(), None
    for k, rule in enumerate(rules, 1):
        hit = rule.column(ratios)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **how) -> list[Rule]:
    """Learn from at most ``max_labelled`` rows of labels (doc_id, quality 0/1)."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    seen = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most max_labelled ids
    stats = with_counts(seen).where(~base_failed()).join(F.broadcast(chosen), "doc_id").select("doc_id", *(c.alias(k) for k, c in ratio_columns().items()), "_quality").orderBy("doc_id")
    rows = stats.limit(max_labelled).toPandas()
    names = list(RATIOS)
    return learn_rules(rows[names].to_numpy(float).reshape(len(rows), len(names)), (rows["_quality"] == 0).to_numpy(bool), names, **how)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (0: none) and kept for every document."""
    return with_counts(docs).withColumn("base_failed", base_failed()).withColumn("rule", rejects(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs``, whole rows, without those that the base rule or the list rejects."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return with_counts(rows, "_text", "_row").where(~base_failed() & (rejects(rules) == 0)).select("_row.*")
