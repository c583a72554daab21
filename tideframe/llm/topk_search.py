"""Exact top-k search by inner product, block at a time.

Documents stand in ranges of alike vectors, cut into blocks. A block has a forward index (its rows) and, per dimension, its
largest and smallest component; a query's components times those of their sign bound every score inside. A query first
searches the range of its best bound, which gives it a k-th score; after that only ranges whose bound reaches that score are
searched. Inside a range its blocks are taken in falling order of their bounds until these fall below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import bounded_sample, map_batches
from tideframe.llm.embedding_dedup import spherical_kmeans
from tideframe.session import stored

#: Rows of a block, rows of a range, queries that one task takes to a range, ranges that are bounded in one task.
BLOCK, RANGE_ROWS, QUERY_ROWS, BOUND_RANGES = 64, 4096, 4096, 1024
#: Components are whole multiples of 1 / STEPS.
STEPS = 64
#: The order of documents comes from at most this many centres, fitted on at most this many vectors. It decides how tight bounds are, not the result.
MOST_CENTRES, SAMPLE_ROWS = 128, 8192
_EARLIEST = -np.iinfo(np.int64).max


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, width, vector``: floor(64 * x) of each component, without the rows that take no part."""

    def whole(v: list | None) -> np.ndarray | None:
        if not v or None in v:
            return None
        x = np.asarray(v, np.float64)
        if not np.isfinite(x).all():
            return None
        # Sums of products of smaller components fit a long.
        return np.floor(STEPS * x).astype(np.int64) if np.abs(x).max() < (2.0**62 / len(x)) ** 0.5 / STEPS - 1 else None

    def run(c: dict[str, list]) -> dict:
        made = [whole(v) for v in c["embedding"]]
        return {"vec_id": c["vec_id"], "width": [0 if m is None else len(m) for m in made], "vector": made}

    values = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(values.filter("vec_id is not null"), run, "vec_id long, width int, vector array<long>").filter("width > 0")


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _narrow(x: np.ndarray, most: float) -> np.ndarray:
    """In the quickest type in which sums of products up to ``most`` are exact."""
    return x.astype(np.float32) if most < 2**24 else x.astype(np.float64) if most < 2**53 else x.astype(np.int64)


def _limits(query: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bounds (queries by blocks): the sum over dimensions of the largest product a row inside can have."""
    most = np.abs(query).max(initial=0) * float(max(np.abs(high).max(initial=0), np.abs(low).max(initial=0))) * 2 * query.shape[1]
    above, below, high, low = (_narrow(x, most) for x in (np.maximum(query, 0), np.minimum(query, 0), high, low))
    return (above @ high.T + below @ low.T).astype(np.int64)


def blocks(vectors: DataFrame, width: int, rows: int) -> DataFrame:
    """``range, ids, vectors, high, low``: one row per block of documents of one width, in ranges of alike vectors."""
    sample = np.stack(bounded_sample(vectors.select("vector"), SAMPLE_ROWS, "vector").toPandas()["vector"].to_numpy()).astype(np.float64)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-9)
    centres = spherical_kmeans(sample, max(1, min(MOST_CENTRES, rows // (4 * BLOCK))))
    # Each centre beside one that is near it, so that a range which spans centres is still narrow.
    left, chain = list(range(1, len(centres))), [0]
    while left:
        chain.append(left.pop(int(np.argmax(centres[left] @ centres[chain[-1]]))))
    centres = centres[chain]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                cell = (_rows(batch.column("vector")).astype(np.float64) @ centres.T).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("vec_id"), batch.column("vector")], names=["cell", "vec_id", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            held = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
            while held.num_rows >= BLOCK:
                yield block(held.slice(0, BLOCK), first + n * BLOCK // RANGE_ROWS)
                held, n = held.slice(BLOCK), n + 1
        if held is not None and held.num_rows:
            yield block(held, first + n * BLOCK // RANGE_ROWS)

    def block(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        x = _rows(part.column("vector"))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([part.column("vec_id").to_pylist()], longs), pa.array([x.ravel()], longs), pa.array([x.max(0)], longs), pa.array([x.min(0)], longs)],
            names=["range", "ids", "vectors", "high", "low"])

    placed = vectors.select("vec_id", "vector").mapInArrow(near, "cell int, vec_id long, vector array<long>")
    ranged = placed.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return stored(ranged.mapInArrow(cut, "range long, ids array<long>, vectors array<long>, high array<long>, low array<long>"), "vector-blocks")


def _ranges(index: DataFrame, width: int) -> DataFrame:
    """``range, high, low`` from the blocks' own, in columns apart from their rows."""
    ends = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("high", F.max), ("low", F.min)) for i in range(width)]
    both = index.select("range", "high", "low").groupBy("range").agg(*ends)
    return both.select("range", *[F.array(*[f"{c}{i}" for i in range(width)]).alias(c) for c in ("high", "low")])


def _bounded(queries: DataFrame, ranges: DataFrame, n_ranges: int, n_queries: int, best: bool) -> DataFrame:
    """``query, range, bound``: per query its best range, or all ranges whose bound reaches its ``least`` but for that of its ``first``.

    Queries and summaries of ranges meet in blocks: each task has ``QUERY_ROWS`` queries and ``BOUND_RANGES`` ranges.
    """
    across, down = -(-n_ranges // BOUND_RANGES), -(-n_queries // QUERY_ROWS)
    own = queries.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("down", F.pmod(F.col("query"), F.lit(down)).cast("int"))
    theirs = ranges.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("across", F.pmod(F.xxhash64("range"), F.lit(across)).cast("int"))

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("query", "range", "bound")})
        number, range_ = q.column("query").to_numpy(), r.column("range").to_numpy()
        limit = _limits(_rows(q.column("vector")), _rows(r.column("high")), _rows(r.column("low")))
        if best:
            row, at = np.arange(len(limit)), limit.argmax(1)
        else:
            row, at = np.nonzero((limit >= q.column("least").to_numpy()[:, None]) & (range_[None, :] != q.column("first").to_numpy()[:, None]))
        return pa.table({"query": number[row], "range": range_[at], "bound": limit[row, at]})

    found = own.groupBy("across", "down").cogroup(theirs.groupBy("across", "down")).applyInArrow(lambda a, b: compare(a, b), "query long, range long, bound long")
    return found.groupBy("query").agg(F.max_by("range", F.struct("bound", "range")).alias("range"), F.max("bound").alias("bound")) if best else found


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then smallest id."""
    if score.shape[1] > 4 * k:
        # What ties with the k-th stays until ids decide.
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        most = int((score >= kth[:, None]).sum(1).max())
        if most < score.shape[1]:
            near = np.argsort(-score, axis=1, kind="stable")[:, :most]
            score, ids = np.take_along_axis(score, near, 1), np.take_along_axis(ids, near, 1)
    order = np.lexsort((ids, -score), axis=-1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _search(queries: pa.Table, index: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, blocks scored) of the queries over one range; places not filled have the lowest score."""
    query, own = _rows(queries.column("vector")), queries.column("vec_id").to_numpy()
    least = queries.column("least").to_numpy()
    held, ids = ([np.asarray(x) for x in index.column(c).to_pylist()] for c in ("vectors", "ids"))
    limit = _limits(query, _rows(index.column("high")), _rows(index.column("low")))
    most = np.abs(query).max(initial=0) * float(max(np.abs(x).max(initial=0) for x in held)) * query.shape[1]
    query, held = _narrow(query, most), [_narrow(x.reshape(-1, query.shape[1]).T, most) for x in held]
    order = np.argsort(-limit, axis=1, kind="stable")
    score, best = np.full((len(query), k), _EARLIEST), np.full((len(query), k), np.iinfo(np.int64).max)
    live, scored = np.arange(len(query)), 0
    for turn in range(len(held)):
        block = order[live, turn]
        # A block whose bound equals the k-th score may hold a smaller id of that score.
        kept = limit[live, block] >= np.maximum(score[live, k - 1], least[live])
        live, block = live[kept], block[kept]
        if not len(live):
            break
        scored += len(live)
        by_block = np.argsort(block, kind="stable")
        for rows in np.split(live[by_block], np.flatnonzero(np.diff(block[by_block])) + 1):
            at = order[rows[0], turn]
            found = (query[rows] @ held[at]).astype(np.int64)
            found[ids[at][None, :] == own[rows][:, None]] = _EARLIEST
            score[rows], best[rows] = _best(np.concatenate([score[rows], found], 1), np.concatenate([best[rows], np.broadcast_to(ids[at], found.shape)], 1), k)
    return score, best, scored


def _visited(queries: DataFrame, visits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``query, vec_id, score, n_blocks``: the best of each visit that beat the query's ``least`` score, or equal it with an id
    below its ``least_id``, with the blocks that were scored for all of the task.

    A range that many queries visit is copied to one task per ``QUERY_ROWS`` of them.
    """
    visits = stored(visits, "visits")
    counts = stored(visits.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("n_parts")), "visit-counts")
    going = visits.join(counts, "range").join(queries, "query").select("range", F.pmod(F.xxhash64("query"), F.col("n_parts")).cast("int").alias("part"), "query", F.col("own_id").alias("vec_id"), "least", "least_id", "vector")
    copies = index.join(counts, "range").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")

    def search(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "vec_id", "score", "n_blocks")})
        score, best, scored = _search(q, b, k)
        least, least_id = (q.column(c).to_numpy()[:, None] for c in ("least", "least_id"))
        row, at = np.nonzero((score > least) | ((score == least) & (best < least_id) & (score > _EARLIEST)))
        return pa.table({"query": q.column("query").to_numpy()[row], "vec_id": best[row, at], "score": score[row, at], "n_blocks": np.full(len(row), scored, np.int64)})

    found = going.groupBy("range", "part").cogroup(copies.groupBy("range", "part")).applyInArrow(lambda a, b: search(a, b), "query long, vec_id long, score long, n_blocks long")
    return stored(found, "visited")


def _top(found: DataFrame, k: int) -> DataFrame:
    """``query, rank, vec_id, score``: the k best of each query."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` its ``k`` highest inner products, ties to the smaller id.

    Components are floor(64 * x). Vectors that are null, empty or hold null or non-finite components take no part, nor do rows
    with a null id, nor vectors with a component so large (2^22 at 64 dimensions) that a score might not fit a long. Vectors of
    different lengths never meet. A query never meets rows of its own id; rows that repeat an id are candidates each, and
    queries each unless the vector repeats too. Fewer than ``k`` candidates give all. Columns beside id and vector are not read.
    """
    vectors = stored(whole_vectors(embeddings), "whole-vectors")
    out = None
    for width, rows in [tuple(r) for r in vectors.groupBy("width").count().orderBy("width").collect()]:
        own = vectors.filter(F.col("width") == width)
        index = blocks(own, width, rows)
        ranges = stored(_ranges(index, width), "vector-ranges")
        asked = own.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.xxhash64("vec_id", "vector").alias("query"), F.col("vec_id").alias("own_id"), "vector").dropDuplicates(["query"])
        asked = stored(asked, "queries")
        n_queries, n_ranges = asked.count(), ranges.count()
        if not n_queries:
            continue
        first = stored(_bounded(asked, ranges, n_ranges, n_queries, best=True), "first-ranges")
        none = {"least": F.lit(_EARLIEST), "least_id": F.lit(_EARLIEST)}
        open_ = asked.withColumns(none)
        seen = _visited(open_, first.select("query", "range"), index, k)
        kth = _top(seen, k).filter(F.col("rank") == k).select("query", F.col("score").alias("least"), F.col("vec_id").alias("least_id"))
        known = asked.join(kth, "query", "left").join(first.select("query", F.col("range").alias("first")), "query")
        known = stored(known.withColumns({c: F.coalesce(c, none_) for c, none_ in none.items()}), "known")
        more = _visited(known.drop("first"), _bounded(known, ranges, n_ranges, n_queries, best=False).select("query", "range"), index, k)
        best = _top(seen.unionByName(more), k).join(asked.select("query", F.col("own_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.unionByName(best)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out
