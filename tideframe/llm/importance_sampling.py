"""Quality by importance resampling: how much likelier a text is under the target's word statistics than under all text.

Two generative models count hashed words and word pairs, one over labelled good documents, one over all documents. A
document's log weight is the sum of their log ratio over its grams; documents are drawn without replacement in
proportion to their weights by adding Gumbel noise and taking the top k.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import HASH_BASE, hashed_words, map_batches, mixed, slices, starts_of
from tideframe.operators.order_statistics import pick_ranks
from tideframe.session import stored

BUCKETS = 10_000


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and every pair of neighbouring words."""
    words, owner, _, _, _ = hashed_words(texts)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mixed(words[pair] * np.uint64(HASH_BASE) + words[pair + 1])
    grams = np.concatenate([mixed(words), pairs])
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[pair]])


def packed_grams(bucket: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """The buckets of each of ``n`` texts in rising order, as the bytes of their gaps; a byte of 255 adds to the next one."""
    cell = np.sort(owner * BUCKETS + bucket)
    owner, bucket = np.divmod(cell, BUCKETS)
    new = np.diff(owner, prepend=-1) != 0
    more, rest = np.divmod(np.where(new, bucket, np.diff(bucket, prepend=0)), 255)
    ends = np.cumsum(more + 1)
    data = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    data[ends - 1] = rest
    sizes = np.bincount(owner, more + 1, n).astype(np.int64)
    raw, cuts = data.tobytes(), starts_of(sizes)
    return [raw[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def unpacked_grams(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every gram, by text and rising."""
    data = np.frombuffer(b"".join(packed), np.uint8)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed))
    total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    at = np.flatnonzero(data != 255)
    owner = np.repeat(np.arange(len(packed)), sizes)[at]
    return total[at + 1] - total[starts_of(sizes)[:-1]][owner], owner


def grams_of(docs: DataFrame) -> DataFrame:
    """``doc_id, noise_seed, grams`` of each whole text: what the later steps need of it, in a fraction of its bytes."""

    def run(c: dict[str, list]) -> dict:
        texts, grams = c["text"], []
        for lo, hi in slices([len(t) for t in texts]):
            grams += packed_grams(*gram_buckets(texts[lo:hi]), hi - lo)
        return {"doc_id": c["doc_id"], "noise_seed": c["noise_seed"], "grams": grams}

    return map_batches(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("noise_seed")), run, "doc_id long, noise_seed long, grams binary")


def labelled(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is among ``ids``. Both sides are dealt by id whatever their sizes: the list of labels grows with
    the documents, so a broadcast of it would only serve small tables."""
    return rows.join(ids.hint("merge"), "doc_id", "left_semi")


def gram_counts(grams: DataFrame, labels: DataFrame) -> np.ndarray:
    """Counts per bucket (raw, target), from *all* documents and *all* labelled good ones.

    Each batch sends its sums per bucket; the driver gets ``BUCKETS`` rows whatever the input. A document labelled more than once is good if it always was.
    """
    good = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).filter("quality > 0")

    def count(c: dict[str, list]) -> dict:
        sums = np.zeros(BUCKETS, np.int64)
        for lo, hi in slices([8 * len(g) for g in c["grams"]]):
            sums += np.bincount(unpacked_grams(c["grams"][lo:hi])[0], minlength=BUCKETS)
        used = np.flatnonzero(sums)
        return {"bucket": used, "n": sums[used]}

    counts = np.zeros((2, BUCKETS))
    for k, rows in enumerate((grams, labelled(grams, good.select("doc_id")))):
        for row in map_batches(rows.select("grams"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            counts[k, row["bucket"]] = row["n"]
    return counts


def log_weights(grams: DataFrame, counts: np.ndarray) -> DataFrame:
    """``doc_id, n_grams, log_weight, noise_seed`` of each row of grams; a text without words has weight 0 in logs.

    A document's own grams are left out of the raw model, else rare words would count against every text
    outside the target. Counts are smoothed by one per bucket. Without target grams all weights are 0.
    """
    raw, target = counts
    n_raw, known = raw.sum(), target.sum() > 0
    log_target = np.log((target + 1) / (target.sum() + BUCKETS))

    def run(c: dict[str, list]) -> dict:
        held = c["grams"]
        sums, n = np.zeros(len(held)), np.zeros(len(held), np.int64)
        for lo, hi in slices([8 * len(g) for g in held]):
            bucket, owner = unpacked_grams(held[lo:hi])
            cell = owner * BUCKETS + bucket
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            own, owner, bucket = np.diff(first, append=len(cell)), owner[first], bucket[first]
            n[lo:hi] = np.bincount(owner, own, hi - lo).astype(np.int64)
            log_raw = np.log(raw[bucket] - own + 1) - np.log(n_raw - n[lo:hi][owner] + BUCKETS)
            sums[lo:hi] = np.bincount(owner, own * (log_target[bucket] - log_raw), hi - lo) if known else 0.0
        return {"doc_id": c["doc_id"], "n_grams": n, "log_weight": sums, "noise_seed": c["noise_seed"]}

    return map_batches(grams, run, "doc_id long, n_grams long, log_weight double, noise_seed long")


def importance_sample(docs: DataFrame, labels: DataFrame, share: float | None = None, keep_good: float = 0.99, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, n_grams, log_weight, gumbel_key, kept``.

    How many rows are drawn follows from the labels: as few as hold ``keep_good`` of the good labelled documents. ``share`` sets
    the share of all rows instead. Rows whose keys tie with the last one drawn are drawn too, so rows that repeat id and text
    stay together. Null and empty texts have log weight 0. With share 1, or without good labels, all rows are kept; an empty
    table gives none.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grams = stored(grams_of(base), "grams")
    weights = log_weights(grams, gram_counts(grams, labels))
    # Noise from a hash of the row: the same on every attempt of a task.
    bits = F.shiftrightunsigned(F.xxhash64("noise_seed", F.lit(seed)), 11).cast("double")
    noise = -F.log(-F.log((bits + 0.5) / float(2**53)))
    keyed = stored(weights.withColumn("gumbel_key", F.col("log_weight") + noise).drop("noise_seed"), "weights")
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    pool, part = (stored(labelled(keyed.select("doc_id", "gumbel_key"), good), "pool"), keep_good) if share is None else (keyed, share)
    n = pool.count()
    k = min(n, math.ceil(n * part) if share is None else round(n * part))
    if k == n if share is None else k in (0, n):
        return keyed.withColumn("kept", F.lit(n == 0 or k > 0))
    rows = pool.select(F.lit(0).alias("all"), (-F.col("gumbel_key")).alias("v"))
    rank = keyed.sparkSession.range(1).select(F.lit(0).alias("all"), F.lit("k").alias("label"), F.lit(k).cast("long").alias("rank"))
    last = pick_ranks(rows, ["all"], "v", rank).first()["value"]
    return keyed.withColumn("kept", -F.col("gumbel_key") <= F.lit(float(last)))
