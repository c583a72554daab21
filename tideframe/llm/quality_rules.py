"""Quality rules: an isolation forest over rule statistics of whole texts.

Each document gets counts that fixed rules look at (words, symbols, capitals, repeated lines and
words). A forest of random splits is grown on labelled good documents; a document that random
splits isolate early is unusual. The verdict's threshold is read from the scores of all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import SPACES, bounded_sample, map_batches, rows_where, rows_without
from tideframe.session import stored

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_bytes")
_UPPER, _MARKS = bytes(range(65, 91)), b"!?;:=+-_/\\@^~\"()[]{}"


@dataclass(frozen=True)
class QualityModel:
    """Split tables of the forest and the score above which a document is rejected."""

    feature: np.ndarray
    cut: np.ndarray
    depth: np.ndarray
    threshold: float


def _repeated(words: list[bytes]) -> int:
    """Words inside five-word windows that occur at least twice, the first occurrence included."""
    n = len(words)
    if n < 6:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = ids[: n - 4].copy()
    for k in range(1, 5):
        windows *= np.uint64(0x9E3779B97F4A7C15)
        windows += ids[k : n - 4 + k]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.isin(windows, twice))
    np.add.at(change, at, 1)
    np.add.at(change, at + 5, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def _counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    kept = [len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _MARKS)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            _repeated(words), len(lines), len(set(words)), *kept, len(raw))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each whole text; a null text counts as an empty one."""

    def count(columns: dict[str, list]) -> dict:
        rows = list(zip(*map(_counts, columns["text"])))
        return {"doc_id": columns["doc_id"], **dict(zip(COUNTS, rows))}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), count, schema)


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words"):
    """Under ten words, or more than a fifth of the words inside repeated windows."""
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))


def _features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not follow the length of a text, bent so that small rates spread over the range too."""
    bent = lambda x, half: x / (x + half)
    words, lines = np.maximum(c["n_words"], 1.0), np.maximum(c["n_lines"], 1.0)
    size = np.maximum(c["n_bytes"], 1.0)
    return np.stack([
        bent(c["n_symbols"] / words, 0.1), c["n_dup_lines"] / lines, c["n_repeat_words"] / words, bent(c["n_upper"] / size, 0.1),
        bent(c["n_marks"] / size, 0.05), np.log1p(c["word_chars"] / words)], axis=1)


def grow_forest(good: np.ndarray, span: np.ndarray, trees: int, subsample: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random splits over the range that all labelled rows span; only good rows fill the leaves.

    A region that holds no good row is cut off after few splits, so rows there get short paths.
    Nodes lie in heap order: children of i are 2 i + 1 and 2 i + 2; a leaf has feature -1.
    """
    rng = np.random.default_rng(seed)
    levels = max(1, int(np.ceil(np.log2(max(2, subsample)))))
    size = 2 ** (levels + 1) - 1
    feature, cut, depth = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))
    usable = np.flatnonzero(span[1] > span[0])

    def rest(n: int) -> float:  # expected further depth of n rows
        return 0.0 if n <= 1 else 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n if n > 2 else 1.0

    for t in range(trees):
        rows = good[rng.choice(len(good), min(subsample, len(good)), replace=False)]
        stack = [(0, rows, span[0].copy(), span[1].copy(), 0)]
        while stack:
            node, own, low, high, d = stack.pop()
            if len(own) <= 1 or d == levels or not len(usable):
                depth[t, node] = d + rest(len(own))
                continue
            f = int(rng.choice(usable))
            at = rng.uniform(low[f], high[f])
            feature[t, node], cut[t, node] = f, at
            left = own[:, f] < at
            below, above = high.copy(), low.copy()
            below[f], above[f] = at, at
            stack += [(2 * node + 1, own[left], low, below, d + 1), (2 * node + 2, own[~left], above, high, d + 1)]
    return feature, cut, depth


def path_scores(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """2 ** -(mean path length / expected length): near 1 for rows that few splits isolate."""
    total = np.zeros(len(x))
    levels = int(np.log2(feature.shape[1] + 1)) - 1
    rows = np.arange(len(x))
    for f, c, d in zip(feature, cut, depth):
        node = np.zeros(len(x), np.int64)
        for _ in range(levels):
            own = f[node]
            inner = own >= 0
            if not inner.any():
                break
            step = 2 * node + 1 + (x[rows, np.maximum(own, 0)] >= c[node])
            node = np.where(inner, step, node)
        total += d[node]
    n = 2.0**levels
    usual = 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n if n > 2 else 1.0
    return 2.0 ** -(total / max(1, len(feature)) / usual)


def score(statistics: DataFrame, model: QualityModel) -> DataFrame:
    """Adds ``anomaly`` (0 to 1) to rows of statistics."""
    forest = (model.feature, model.cut, model.depth)

    def run(c: dict[str, list]) -> dict:
        x = _features({k: np.asarray(c[k], float) for k in COUNTS})
        return {**c, "anomaly": path_scores(x, *forest)}

    return map_batches(statistics, run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", anomaly double")


def fit(statistics: DataFrame, labels: DataFrame, sample_rows: int = 4096, trees: int = 128, subsample: int = 256, max_loss: float = 0.005, seed: int = 11) -> QualityModel:
    """Grow the forest on at most ``sample_rows`` good labelled rows (and as many others for the ranges).

    The threshold counts the scores of *all* labelled rows that pass the base rules in 1,000 bins; it is
    the one with the best balanced accuracy among those that reject at most ``max_loss`` of the good
    rows. Without labelled good rows nothing is rejected. A document labelled twice counts as bad if once so.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = statistics.filter(~base_failed()).join(marks, "doc_id")
    sample = {q: bounded_sample(known.filter(F.col("quality") == q), sample_rows, "doc_id", *COUNTS).toPandas() for q in (1, 0)}
    if not len(sample[1]):
        return QualityModel(np.full((1, 3), -1, np.int32), np.zeros((1, 3)), np.zeros((1, 3)), 2.0)
    good, bad = (_features({k: sample[q][k].to_numpy(float) for k in COUNTS}) for q in (1, 0))
    both = np.concatenate([good, bad])
    forest = grow_forest(good, np.stack([both.min(0), both.max(0)]), trees, subsample, seed)
    scored = score(known.select("doc_id", *COUNTS), QualityModel(*forest, 2.0)).join(marks, "doc_id")
    bins = scored.groupBy(F.least(F.lit(999), F.floor(F.col("anomaly") * 1000)).cast("int").alias("bin"), "quality").count().collect()
    tally = np.zeros((2, 1000))
    for row in bins:
        tally[int(row["quality"] > 0), row["bin"]] += row["count"]
    lost = np.cumsum(tally[:, ::-1], axis=1)[:, ::-1] / np.maximum(1.0, tally.sum(1, keepdims=True))
    gain = np.where(lost[1] <= max_loss, lost[0] - lost[1], -1.0)
    best = int(np.argmax(gain))
    return QualityModel(*forest, best / 1000.0 if gain[best] > 0 else 2.0)


def _judged(statistics: DataFrame, model: QualityModel) -> DataFrame:
    judged = score(statistics, model).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(float(model.threshold))))


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``anomaly`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged one by one and
    alike. Other columns of ``docs`` are not read, whatever their names. An empty table gives no rows.
    """
    statistics = stored(rule_statistics(docs), "rule-statistics")
    return _judged(statistics, fit(statistics, labels, **options))


def passing_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns; of rows that share an id all must pass. Rows without an id are
    judged one by one.

    Texts are judged where they stand; only if rows that share an id are judged differently is there a join, with those ids.
    """
    statistics = stored(rule_statistics(docs), "rule-statistics")
    model = fit(statistics, labels, **options)
    verdict = _judged(statistics.filter("doc_id is not null"), model).groupBy("doc_id").agg(F.bool_and("kept").alias("all"), F.bool_or("kept").alias("any"))
    torn = stored(verdict.filter("any and not all").select("doc_id"), "torn")

    def judge(texts: list[str]) -> np.ndarray:
        c = {k: np.asarray(x, float) for k, x in zip(COUNTS, zip(*map(_counts, texts)))}
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return ~failed & (path_scores(_features(c), model.feature, model.cut, model.depth) < model.threshold)

    passed = rows_where(docs, judge)
    return passed if torn.isEmpty() else rows_without(passed, torn)
