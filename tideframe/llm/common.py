"""Helpers that several of these operators share: tables, text columns, rowwise Arrow maps, components, blocks."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.session import stored

#: Words are cut at these six ASCII characters and nothing else; ``bytes.split`` cuts at the same ones.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step takes at a time, so that memory does not follow the batch.
SLICE_BYTES = 1_000_000
HASH_BASE = 0xD6E8FEB86659FD93
HASH_MIX = np.uint64(0x9E3779B97F4A7C15)
# ASCII marks and control characters separate words, as blanks do.
_TO_BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _kept() -> dict[str, object]:
    """What this Python worker keeps for the tasks of one stage; the first task of another stage finds nothing.

    Functions travel to the workers by value, so a module variable would not outlive a task.
    """
    held = sys.modules.setdefault("_tideframe_worker", types.ModuleType("_tideframe_worker")).__dict__
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if held.get("stage", ()) != stage:
        held["stage"], held["kept"] = stage, {}
    return held["kept"]


def once_per_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept while the Python worker runs tasks of one stage, so that the later ones find it ready."""
    kept = _kept()
    if name not in kept:
        kept[name] = make()
    return kept[name]


def hand_back() -> None:
    """Give memory that is free but held by Arrow's and the C library's allocators back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries have none
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, after which the worker holds no more than it needs.

    Workers outlive tasks and steps, and their memory counts beside the JVM's: what one step kept or freed must not
    stand beside the next one's.
    """

    def around(batches: Iterator) -> Iterator:
        _kept()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return around


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``tidy`` for a function of one group."""

    def around(group: pa.Table) -> pa.Table:
        _kept()
        try:
            return run(group)
        finally:
            hand_back()

    return around


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Iterable]], schema: str, names: list[str] | None = None) -> DataFrame:
    """Run ``fn`` on the columns of each Arrow batch, or those of ``names``; it returns the columns of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    df.sparkSession  # noqa: B018  a session must be active to read the schema text
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns) if names is None or n in names})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def rows_where(docs: DataFrame, judge: Callable[[list[str]], Iterable[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text the judge keeps, decided where each row stands: nothing moves, and rows that share an id,
    or have none, are judged one by one. A null text counts as empty."""

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[bool] = []
            for lo, hi in slices([n or 0 for n in pc.binary_length(texts).to_pylist()]):
                out += map(bool, judge([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]))
            yield pa.array(out, pa.bool_())

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(judged)(batches)

    return docs.filter(kept(F.col("text").cast("string")))


def rows_with(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is among ``ids`` (null meets null), with just their own columns."""
    own = f"_{uuid.uuid4().hex}"
    wanted = ids.select(F.col(key).alias(own))
    return docs.join(wanted, F.col(key).eqNullSafe(F.col(own)), "left_semi")


def rows_without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is not among ``ids``, with just their own columns; a null key is among none."""
    own = f"_{uuid.uuid4().hex}"
    return docs.join(ids.select(F.col(key).alias(own)), F.col(key) == F.col(own), "left_anti")


def bounded_sample(df: DataFrame, rows: int, *order: Column | str) -> DataFrame:
    """At most ``rows`` rows, the same ones each time, for fitting. Tasks pass on about twice as many in all, not each."""
    n = df.count()
    if n > 2 * rows:
        df = df.filter(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < F.lit(int((1 << 30) * (2.0 * rows / n + 4.0 * (2.0 * rows) ** 0.5 / n))))
    return df.orderBy(F.xxhash64(*order), *order).limit(rows)


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def starts_of(sizes: Iterable[int]) -> np.ndarray:
    """Offsets of consecutive pieces, with the end last."""
    return np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64))])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * HASH_MIX
    return h ^ (h >> np.uint64(29))


def plain_bytes(text: str) -> bytes:
    """Lower case, with a blank for every ASCII mark and control character; length and offsets are those of the bytes."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_BLANK)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, bounds, start, stop) of all words; words of text i are ``bounds[i]:bounds[i + 1]``.

    Words are lower-case runs of anything but blanks and ASCII marks; start and stop count the bytes of ``plain_bytes``.
    """
    raw = [plain_bytes(t) for t in texts]
    offsets = starts_of(len(r) + 1 for r in raw)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    word = np.pad(data != 32, (1, 0))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, stop = edge[::2], edge[1::2]
    bounds = np.searchsorted(start, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # Hash of bytes i..j from running sums of byte * base ** position, moved back by base ** -i.
    n = len(data)
    powers, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (np.uint64(HASH_BASE), np.uint64(pow(HASH_BASE, -1, 2**64))))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n])])
    words = mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * HASH_MIX)
    return words, owner, bounds, start - offsets[owner], stop - offsets[owner]


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Connected components of the undirected edges ``(u, v)`` of longs: rows ``(node, component)``.

    Large star and small star in turn, until each node hangs on the smallest node of its component. The
    minimum of a node's neighbours is a pre-aggregated group. Nodes without an edge are absent.
    """
    stars = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    while True:
        # Done when every node hangs on one other and none of those hangs on a third.
        roles = stars.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(stars.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs + holds > 1 and hangs > 0").isEmpty():
            break
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        stars = stored(small.distinct(), label)
    centres = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)


def block_pairs(df: DataFrame, group: str, spread: Column, size: int) -> DataFrame:
    """Deal the rows of each group to pairs of blocks, so that each pair of rows meets in exactly one task.

    A group of n rows is cut into ceil(n / size) blocks by ``spread``; a row goes to every pair
    that holds its block, with ``side`` 0 or 1 (0 where both blocks are the same). Columns added:
    ``bi``, ``bj``, ``side``. A group of one block is not copied.
    """
    # Written down, so that the join is one that adaptive execution splits at a large group.
    counts = stored(df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("n_blocks")), "blocks")
    own = df.join(counts, group).withColumn("own", F.pmod(spread, F.col("n_blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return dealt.select(
        *df.columns, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
        (F.col("own") > F.col("other")).cast("int").alias("side"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component among ``n`` rows under the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root
