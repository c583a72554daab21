"""Near-duplicate embeddings: spherical k-means deals vectors to cells, blocks of cosines link them.

A vector belongs to its nearest cell and also visits every cell whose border lies within ``slack`` degrees of it. Two
vectors meet if either visits the other's cell. A pair at an angle a surely meets if slack >= a / 2, so a slack of half the
threshold's angle makes the join exact; the default finds nearer pairs surely and most of the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import block_pairs, bounded_sample, components, map_batches, roots
from tideframe.session import stored

#: Rows of a block; a task holds two blocks.
BLOCK = 8192
#: Rows whose distances to all centres are held at a time.
SLICE = 1000
#: Vectors per cell, and the most cells that are fitted; larger cells are compared in more blocks.
CELL_ROWS, MAX_CELLS = 1000, 2048


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, unit``: vectors of length 1 in double precision; null where the vector links with nothing."""

    def unit(v: list | None) -> np.ndarray | None:
        if not v or None in v:
            return None
        x = np.asarray(v, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            return None
        # Scaled by the largest component first, so that squares neither overflow nor vanish.
        x = x / top
        return x / np.sqrt(x @ x)

    def run(c: dict[str, list]) -> dict:
        return {"vec_id": c["vec_id"], "unit": [unit(v) for v in c["embedding"]]}

    values = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(values, run, "vec_id long, unit array<double>")


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of length 1 on a sample of unit vectors; a cell that runs empty keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 1e-9] = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return centres


def _visits(unit: np.ndarray, centres: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, whether each cell is visited); the own cell is not among those visited."""
    near = unit @ centres.T
    home = near.argmax(1)
    gaps = np.linalg.norm(centres[home][:, None, :] - centres[None, :, :], axis=2) if len(unit) * centres.size < 4_000_000 else np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centres[home] @ centres.T)))
    # Sine of the angle between a vector and the border of its own and another cell.
    visits = near[np.arange(len(unit)), home][:, None] - near <= np.sin(slack) * gaps + 1e-12
    visits[np.arange(len(unit)), home] = False
    return home, visits


def _assigned(nodes: DataFrame, centres: np.ndarray, slack: float) -> DataFrame:
    """``cell, node, copies, unit``: each vector in its own cell and in those it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                home, visits = _visits(np.stack(batch.column("unit").to_numpy(zero_copy_only=False)), centres, slack)
                visits[np.arange(len(home)), home] = True
                row, cell = np.nonzero(visits)
                out = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(out.column(n) for n in ("node", "copies", "unit"))], names=["cell", "node", "copies", "unit"])

    return nodes.mapInArrow(run, "cell int, node long, copies long, unit array<double>")


def _links(assigned: DataFrame, centres: np.ndarray, slack: float, threshold: float) -> DataFrame:
    """Per block: ``u`` with ``n_u`` other vectors linked, and a link ``u - v`` to the root of its part.

    A pair that meets in both its cells counts in the one of the smaller number.
    """
    dealt = block_pairs(assigned, "cell", F.xxhash64("node"), BLOCK)

    def compare(group: pa.Table) -> pa.Table:
        unit = np.stack(group.column("unit").to_numpy())
        side, node, copies = (group.column(n).to_numpy() for n in ("side", "node", "copies"))
        cell, one_block = group.column("cell")[0].as_py(), group.column("bi")[0].as_py() == group.column("bj")[0].as_py()
        # Slice by slice, since a row meets every centre.
        parts = [_visits(unit[lo : lo + SLICE], centres, slack) for lo in range(0, len(unit), SLICE)]
        home, visits = (np.concatenate(x) for x in zip(*parts))
        at_home = home == cell
        left, right = [], []
        for lo in range(0, len(unit), 256):
            own = np.arange(lo, min(lo + 256, len(unit)))
            like = unit[own] @ unit.T >= threshold
            like &= at_home[own, None] | at_home[None, :]
            like &= np.arange(len(unit))[None, :] > own[:, None]
            if not one_block:
                like &= side[own, None] != side[None, :]
            a, b = np.nonzero(like)
            a += lo
            stranger, host = np.where(at_home[a], b, a), np.where(at_home[a], a, b)
            once = at_home[stranger] | (cell < home[stranger]) | ~visits[host, home[stranger]]
            left.append(a[once])
            right.append(b[once])
        a, b = np.concatenate(left), np.concatenate(right)
        count = np.bincount(a, copies[b], len(unit)) + np.bincount(b, copies[a], len(unit))
        root = roots(len(unit), a, b)
        linked = np.flatnonzero(count)
        return pa.table({"u": node[linked], "v": node[root[linked]], "n_u": count[linked].astype(np.int64)})

    return dealt.groupBy("cell", "bi", "bj").applyInArrow(compare, "u long, v long, n_u long")


def embedding_dedup(embeddings: DataFrame, threshold: float = 0.9, slack_degrees: float = 4.0, cells: int | None = None, sample_rows: int = 16384) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``.

    Equal directions are one node with its number of copies, so a group of copies is never compared with itself. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing and are their own component.
    The centres (a thousand vectors to a cell, ``MAX_CELLS`` at most) are fitted on at most ``sample_rows`` vectors. Vectors of different
    lengths are never compared. Rows that repeat an id count as separate vectors. Labels are not read.
    """
    units = stored(unit_vectors(embeddings).withColumn("node", F.xxhash64("unit")), "units")
    sound = units.filter("unit is not null")
    nodes = stored(sound.groupBy("node").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lead")), "vector-nodes")
    links = None
    slack = min(math.radians(slack_degrees), math.acos(threshold) / 2)
    for width, rows in [tuple(r) for r in nodes.groupBy(F.size("unit").alias("width")).count().orderBy(F.desc("count"), "width").collect()]:
        own = nodes.filter(F.size("unit") == width)
        sample = bounded_sample(own.select("unit", "node"), sample_rows, "node").toPandas()
        centres = spherical_kmeans(np.stack(sample["unit"].to_numpy()), cells or max(1, min(MAX_CELLS, rows // CELL_ROWS)))
        found = _links(_assigned(own.select("node", "copies", "unit"), centres, slack), centres, slack, threshold)
        links = found if links is None else links.union(found)
    if links is None:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stored(links, "vector-links")
    classes = components(links.select("u", "v"), "vector-classes").withColumnRenamed("component", "class")
    direct = links.groupBy(F.col("u").alias("node")).agg(F.sum("n_u").alias("linked"))
    known = nodes.select("node", "lead", "copies").join(classes, "node", "left").join(direct, "node", "left").withColumn("class", F.coalesce("class", "node"))
    known = stored(known, "vector-known")
    lead = known.groupBy("class").agg(F.min("lead").alias("component_id"))
    final = known.join(lead, "class").select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    judged = units.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("node")).alias("node")).join(final, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return judged.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
