"""How filters interact: what each of five filters removes in every order of applying them.

A document is reduced to a mask of the filters it fails, and each mask stands for one wide integer whose fields hold the
outcome of all 600 steps (120 orders of five filters). The integers of a part are summed; a field is wide enough for all
documents of the part, so no sum runs over into the next field, and unpacking gives every counter of every order at once.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import map_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Counters of one step; the fields of a step stand in this order.
COUNTERS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: A document with fewer words fails A; one whose share of distinct words in percent is below fails B; one whose share of
#: capitals in percent is above fails C; one that holds any of the marks fails D. E is an earlier text repeated.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
DUPLICATE, GOOD, TOXIC = 16, 32, 64
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails. Words are cut at the six ASCII blanks."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    marked = len(raw.translate(None, MARKS)) < len(raw)
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * capitals > CAPITAL_PERCENT * len(text), marked)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` per row: mask has the bits of A to D, digest names the whole text."""

    def run(c: dict[str, list]) -> dict:
        texts = [t or "" for t in c["text"]]
        return {"doc_id": c["doc_id"], "part": [p or "" for p in c["lang"]], "mask": [failures(t) for t in texts],
                "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n``: how many documents of a part have each mask, with the bits of E and of both labels.

    Equal texts meet as counts only: per text, part and label there is one row with the smallest id and how many rows have
    it, so a text that a third of all documents repeat is never gathered.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = known.groupBy("labelled").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    flags = F.when(F.coalesce("good", F.lit(False)), GOOD).otherwise(0) + F.when(F.coalesce("toxic", F.lit(False)), TOXIC).otherwise(0)
    own = judged(docs).join(marks, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "part", "digest", (F.col("mask") + flags).alias("mask"))
    rows = own.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = rows.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.min(named).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("lowest", lowest).withColumn("original", F.col("unnamed") + firsts)
    both = F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    return split.select("part", F.explode(both).alias("x")).select("part", "x.*").groupBy("part", "mask").agg(F.sum("n").alias("n")).filter("n > 0")


def packed(mask: int, width: int) -> int:
    """The outcome of all 600 steps for one document: ``len(COUNTERS)`` fields of ``width`` bits a step, then one for each
    filter that tells whether the document fails it alone."""
    value = at = 0
    fails = [f for i, f in enumerate(FILTERS) if mask >> i & 1]
    for order in ORDERS:
        removed = False
        for name in order:
            here = name in fails and not removed
            again = name in fails and removed
            removed |= here
            for hit in (not removed, here, again, here and bool(mask & GOOD), here and bool(mask & TOXIC)):
                value |= int(hit) << at
                at += width
    for name in FILTERS:
        value |= int(fails == [name]) << at
        at += width
    return value


def unpacked(total: int, width: int) -> list[int]:
    """The fields of a sum."""
    size = width // 8
    raw = total.to_bytes((len(ORDERS) * len(FILTERS) * len(COUNTERS) + len(FILTERS)) * size, "little")
    return [int.from_bytes(raw[i : i + size], "little") for i in range(0, len(raw), size)]


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A part is a value of ``lang``; null counts as the empty string. A null text is empty: it fails A only (and E, where an
    empty text has a smaller id). Rows that repeat id and text are documents each, and none is the earlier one of the other;
    a null id is neither smaller nor larger than another, so such rows never fail E and have no label. A document is good
    or toxic if any of its label rows says so. An empty table gives no rows. Other columns are not read.
    """

    def total(table: pa.Table) -> pa.Table:
        counts = list(zip(table.column("mask").to_pylist(), table.column("n").to_pylist()))
        # Whole bytes that hold the number of all documents of the part, which no field exceeds.
        width = 8 * (sum(n for _, n in counts).bit_length() // 8 + 1)
        fields = unpacked(sum(n * packed(mask, width) for mask, n in counts), width)
        size = len(COUNTERS)
        steps = [fields[i : i + size] for i in range(0, len(ORDERS) * len(FILTERS) * size, size)]
        alone = dict(zip(FILTERS, fields[len(steps) * size :]))
        names = [name for order in ORDERS for name in order]
        shapley = dict.fromkeys(FILTERS, 0)
        for name, step in zip(names, steps):
            shapley[name] += step[1]
        columns = dict(zip(COUNTERS, map(list, zip(*steps))))
        columns |= {"filter_order": [o for o in ORDERS for _ in o], "step": [k + 1 for o in ORDERS for k in range(len(o))],
                    "part": [table.column("part")[0].as_py()] * len(steps), "unique_fails": [alone[x] for x in names], "shapley": [shapley[x] for x in names]}
        types = dict(x.strip().split(" ") for x in RESULT.split(","))
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        return pa.table({k: pa.array(columns[k], kinds[t]) for k, t in types.items()})

    # A group has one row per mask: 128 at most.
    return masks(docs, labels).groupBy("part").applyInArrow(total, RESULT)
