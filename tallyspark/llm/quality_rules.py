"""Quality rules: a learned decision list over text statistics.

Statistics of whole texts come from vectorised byte scans. Sequential covering on a bounded labelled
sample grows conjunctions of thresholds (FOIL gain), prunes them on held-back rows and emits them as
one ordered chain of Spark conditional expressions, so the verdict itself is plain Catalyst code.

Null texts count as empty: all statistics 0 and base_failed true. Rows are independent, so repeated
rows give repeated results; an empty table gives an empty one; clashing input columns give way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import mix, repeated, scans, sums_between, windows
from .common import labelled_sample, prepare, with_arrow_columns

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_marks", "n_digits", "n_same_words", "n_long_words",
)
#: Name and Spark form of the ratios that rules may test.
FEATURES = (
    "n_words", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
    "marks_per_word", "digit_share", "same_share", "long_share", "chars_per_word",
)
#: Labelled rows that a list is learned from, at most.
SAMPLE = 6000
_FLAG = np.zeros((4, 256), bool)
_FLAG[0, list(SYMBOLS)] = True
_FLAG[1, 65:91] = True
_FLAG[2, list(b"!?;:")] = True
_FLAG[3, 48:58] = True


def _statistics(batch: pa.RecordBatch) -> list[pa.Array]:
    parts = []
    for s in scans(batch.column(batch.schema.get_field_index("text"))):
        bounds, words = s.bounds, s.words()
        n_words = np.diff(bounds)
        code_points = (s.raw & 0xC0) != 0x80
        symbols, upper, marks, digits = (sums_between(f[s.raw], s.offsets) for f in _FLAG)
        starts, ends, lines = s.lines()
        with_word = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
        text_of_line = np.repeat(np.arange(s.rows), np.diff(lines))
        later = np.zeros(len(starts), bool)
        full = np.flatnonzero(with_word)
        later[full] = repeated(s.hashes(starts[full], ends[full]) ^ mix(text_of_line[full].astype(np.uint64) + np.uint64(1)))[1]
        keys, at, edges = windows(words, bounds, 3)
        many, _ = repeated(keys ^ mix(np.repeat(np.arange(s.rows), np.diff(edges)).astype(np.uint64) + np.uint64(1)))
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[at[many] + k] = True
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[bounds[:-1][n_words > 0]] = False
        parts.append([
            n_words, sums_between(code_points & s.inside, s.offsets), symbols, sums_between(later, lines),
            sums_between(covered, bounds), sums_between(with_word, lines), upper, marks, digits,
            sums_between(same, bounds), sums_between((s.ends - s.starts) > 20, bounds),
        ])
    return [pa.array(np.concatenate(x).astype(np.int64) if parts else np.zeros(0, np.int64)) for x in (zip(*parts) if parts else [()] * len(STATISTICS))]


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the columns of STATISTICS, all long."""
    prepare(docs.sparkSession)
    return with_arrow_columns(docs, ", ".join(f"{n} long" for n in STATISTICS), _statistics)


def features(c) -> list:
    """The values of FEATURES; c gives a statistic by name, as a Spark or NumPy column."""
    words, chars = c("n_words"), c("word_chars")
    per = lambda x, y: x / (y + 1.0)
    return [
        words, per(c("n_symbols"), words), per(c("n_dup_lines"), c("n_lines")), per(c("n_repeat_words"), words),
        per(c("n_upper"), chars), per(c("n_marks"), words), per(c("n_digits"), chars), per(c("n_same_words"), words),
        per(c("n_long_words"), words), per(chars, words),
    ]


@dataclass(frozen=True)
class Rule:
    """All tests (feature index, is_upper_bound, threshold) hold: the row is bad with this confidence."""

    tests: tuple[tuple[int, bool, float], ...]
    confidence: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, upper, t in self.tests:
            out &= x[:, f] <= t if upper else x[:, f] > t
        return out


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], most: int) -> list[tuple[int, bool, float]]:
    tests: list[tuple[int, bool, float]] = []
    inside = np.ones(len(y), bool)
    while len(tests) < most:
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if p0 == 0 or n0 == 0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, points in enumerate(cuts):
            if not len(points):
                continue
            bins = np.searchsorted(points, x[inside, f], "left")  # x <= points[b]
            p = np.cumsum(np.bincount(bins[y[inside]], minlength=len(points) + 1))[:-1]
            n = np.cumsum(np.bincount(bins[~y[inside]], minlength=len(points) + 1))[:-1]
            for upper, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, upper, float(points[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        f, upper, t = best[1]
        inside &= x[:, f] <= t if upper else x[:, f] > t
    return tests


def learn_list(x: np.ndarray, bad: np.ndarray, most_rules: int = 24, most_tests: int = 4, least: float = 0.7, seed: int = 11) -> list[Rule]:
    """Sequential covering of the bad rows. An empty list where there is nothing to learn from."""
    if not len(bad) or bad.all() or not bad.any():
        return []
    rows = np.random.default_rng(seed).permutation(len(bad))
    held = np.zeros(len(bad), bool)
    held[rows[: len(rows) // 3]] = True
    # thresholds lie halfway between neighbouring quantiles of the values
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 129), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (left & bad & ~held).any():
        g, p = left & ~held, left & held
        tests = _grow(x[g], bad[g], cuts, most_tests)
        if not tests:
            break

        def worth(ts, at=p):
            hit = Rule(tuple(ts), 0).covers(x[at])
            good, wrong = int((hit & bad[at]).sum()), int((hit & ~bad[at]).sum())
            return (good - wrong) / max(good + wrong, 1), good, wrong

        while len(tests) > 1 and worth(tests[:-1])[0] >= worth(tests)[0]:
            tests = tests[:-1]
        hit = Rule(tuple(tests), 0).covers(x) & left
        good, wrong = int((hit & bad).sum()), int((hit & ~bad).sum())
        confidence = (good + 1) / (good + wrong + 2)
        if confidence < least or not good:
            break
        rules.append(Rule(tuple(tests), confidence))
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Ordered conditional expressions over the statistics: kept, and the number of the rule that fired (null: none)."""
    columns = features(lambda n: F.col(n).cast("double"))
    kept, fired = None, None
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for f, upper, t in rule.tests:
            test = test & (columns[f] <= F.lit(t) if upper else columns[f] > F.lit(t))
        kept = F.when(test, False) if kept is None else kept.when(test, False)
        fired = F.when(test, k) if fired is None else fired.when(test, k)
    return (F.lit(True), F.lit(None).cast("int")) if kept is None else (kept.otherwise(True), fired)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[Rule]:
    """The decision list of at most `limit` labelled rows of docs."""
    some = labelled_sample(labels, limit)
    rows = text_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).select("doc_id", "quality", *STATISTICS).toArrow()
    # rows come in the order of tasks; the list must not depend on it
    rows = rows.sort_by([(n, "ascending") for n in rows.column_names])
    data = {n: rows[n].to_numpy().astype(float) for n in STATISTICS}
    x = np.stack(features(data.__getitem__), axis=1) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return learn_list(x, rows["quality"].to_numpy() == 0)


def quality_rules(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """docs with STATISTICS, base_failed, kept and rule (the number of the rule that rejected; null if none did)."""
    kept, fired = verdict(fit(docs, labels, limit))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = text_statistics(docs)
    return out.withColumns({"base_failed": failed}).withColumns({"kept": ~F.col("base_failed") & kept, "rule": fired})
