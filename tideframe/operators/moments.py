"""Moment matrices: one distributed pass, then algebra on k-by-k matrices per key.

A row carries its regressors and responses as one vector column. ``gramian`` sums the
outer products of the vectors with a partial sum per task; matrices travel as their upper triangles. ``expanding_solve`` gives
every walk-forward origin the moments of all rows before it: chunks of a series are
summed in parallel, the sums run forward over chunks, and each chunk then walks its own
origins. Cost is rows * m^2 + origins * m^3 and no task holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.panel import UNBOUNDED, PanelSpec

FLUSH = 2048


def vector(*parts: Column) -> Column:
    """Concatenate numbers and arrays to one vector; null when any element is missing."""
    arrays = F.concat(*parts)
    return F.when(~F.exists(arrays, lambda v: v.isNull() | F.isnan(v)), arrays)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _sum_elements(partials: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Elementwise sum of arrays per group."""
    cells = partials.select(*groups, F.posexplode("g").alias("_i", "_v"))
    sums = cells.groupBy(*groups, "_i").agg(F.sum("_v").alias("_v"))
    return _gather(sums, groups)


def _gather(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_v")))
    return cells.groupBy(*groups).agg(F.transform(ordered, lambda s: s["_v"]).alias("g"))


def gramian(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """Per group the packed sum of outer products of ``column`` (see ``square``); rows with a null vector are skipped."""
    groups = list(groups)
    schema = T.StructType([*_fields(df, groups), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, packed(g)) for k, g in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*groups, "g"])

        for pdf in batches:
            for key, part in pdf.groupby(groups, sort=False):
                x = np.stack(part[column].to_numpy())
                held[key] = held[key] + x.T @ x if key in held else x.T @ x
            if len(held) > FLUSH:
                yield flush()
        if held:
            yield flush()

    rows = df.filter(F.col(column).isNotNull()).select(*groups, column)
    return _sum_elements(rows.mapInPandas(partial, schema), groups)


def every_series(df: DataFrame, groups: Sequence[str], **moments: DataFrame) -> DataFrame:
    """One row per key of ``df`` with the column ``g`` of each of ``moments`` under its name; null where a series has none."""
    groups, kind = list(groups), "array<double>"
    blank = df.select(*groups).distinct().withColumns({n: F.lit(None).cast(kind) for n in moments})
    for name, own in moments.items():
        blank = blank.unionByName(own.select(*groups, *[(F.col("g") if n == name else F.lit(None).cast(kind)).alias(n) for n in moments]))
    return blank.groupBy(*groups).agg(*[F.first(n, ignorenulls=True).alias(n) for n in moments])


def typed(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows as a frame whose whole numbers and truth values may be null."""
    kinds = {"bigint": "Int64", "int": "Int32", "boolean": "boolean", "double": "float64"}
    return pd.DataFrame(rows, columns=schema.fieldNames()).astype({f.name: kinds[f.dataType.simpleString()] for f in schema if f.dataType.simpleString() in kinds})


def packed(g: np.ndarray) -> list[float]:
    """The upper triangle of a symmetric matrix, row by row."""
    return g[np.triu_indices(len(g))].tolist()


def square(triangle) -> np.ndarray:
    """The symmetric matrix of a packed triangle."""
    flat = np.asarray(triangle, dtype=float)
    m = int(round((np.sqrt(8 * flat.size + 1) - 1) / 2))
    g = np.empty((m, m))
    rows, columns = np.triu_indices(m)
    g[rows, columns] = g[columns, rows] = flat
    return g


class Collinear(np.linalg.LinAlgError):
    """Regressors that are linear combinations of others; ``at`` lists their positions, ``rank`` how many are not."""

    def __init__(self, what: str, at: Sequence[int], rank: int, names: Sequence[str] = ()):
        self.at, self.rank = list(at), rank
        named = ", ".join(names[i] for i in self.at) if names else ", ".join(map(str, self.at))
        super().__init__(f"{what}: rank {rank} of {rank + len(self.at)}, dependent: {named}")


def dependent(zz: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Positions of the columns that a pivoted Cholesky factor of the scaled moments leaves without variance of their own.

    The pivot is the column with the most variance left, of equal ones the first; a column without any variance, or one that is
    not finite, is dependent at once.
    """
    scale = np.sqrt(np.clip(np.nan_to_num(np.diag(zz), nan=0.0, posinf=0.0), 0, None))
    sound = (scale > 0) & np.isfinite(zz).all(axis=1)
    rest = np.where(sound, 1.0, 0.0)
    unit = np.where(scale > 0, scale, 1.0)
    left = np.nan_to_num(zz / np.outer(unit, unit))
    while (rest > tolerance).any():
        i = int(np.argmax(rest > rest.max() - 1e-9))
        column = left[:, i] / np.sqrt(left[i, i])
        left = left - np.outer(column, column)
        rest = np.where(rest > tolerance, np.diag(left), rest)
        rest[i] = -1.0
    return np.flatnonzero(rest > -1.0).tolist()


def require_rank(zz: np.ndarray, what: str, names: Sequence[str] = ()) -> None:
    """Refuse moments without full numerical rank, naming the dependent columns."""
    if not well_posed(zz):
        at = dependent(zz) or [int(np.argmin(np.abs(np.linalg.eigh(zz)[1][:, 0])))]
        raise Collinear(what, at, len(zz) - len(at), names)


def well_posed(zz: np.ndarray, tolerance: float = 1e-12) -> bool:
    """Whether the scaled moment matrix has full numerical rank."""
    scale = np.sqrt(np.diag(zz))
    if not np.all(np.isfinite(zz)) or np.any(scale <= 0):
        return False
    eig = np.linalg.eigvalsh(zz / np.outer(scale, scale))
    return bool(eig[0] > tolerance * eig[-1])


def least_squares(g: np.ndarray, m: int, names: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual cross products from the moments of [m regressors, responses]."""
    zz, zy, yy = g[:m, :m], g[:m, m:], g[m:, m:]
    require_rank(zz, "collinear regressors", names)
    scale = np.sqrt(np.diag(zz))
    coef = np.linalg.solve(zz / np.outer(scale, scale), zy / scale[:, None]) / scale[:, None]
    return coef, yy - zy.T @ coef


def expanding_solve(
    df: DataFrame, spec: PanelSpec, column: str, carried: Sequence[str],
    solve: Callable[[np.ndarray, dict], list[dict]], schema: T.StructType, chunk_rows: int = 250,
) -> DataFrame:
    """Run ``solve`` at every row with ``is_origin`` on the moments of all rows up to it.

    ``df`` holds the keys, ``rn`` (row position), ``is_origin``, the vector ``column``
    and the ``carried`` columns that ``solve`` gets as a dict. ``solve`` returns rows of
    ``schema`` without the keys.
    """
    keys = list(spec.keys)
    on = [*keys, "_chunk"]
    rows = df.select(*keys, "rn", "is_origin", column, *carried).withColumn("_chunk", F.floor((F.col("rn") - 1) / chunk_rows))
    # The solves cost far more than their bytes tell, so the planner must not merge small partitions here.
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, *on)
    sums_schema = T.StructType([*_fields(rows, on), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def one_chunk(key, pdf):
        x = np.stack(pdf[column].to_numpy())
        return pd.DataFrame([(*key, packed(x.T @ x))], columns=[*on, "g"])

    sums = rows.filter(F.col(column).isNotNull()).select(*on, column).groupBy(*on).applyInPandas(one_chunk, sums_schema)
    cells = sums.select(*on, F.posexplode("g").alias("_i", "_v"))
    before = Window.partitionBy(*keys, "_i").orderBy("_chunk").rowsBetween(UNBOUNDED, 0)
    upto = cells.withColumns({"_v": F.sum("_v").over(before), "_chunk": F.col("_chunk") + 1})
    carry = _gather(upto, on)
    out_schema = T.StructType([*_fields(rows, keys), *schema.fields])
    names = out_schema.fieldNames()

    def walk(key, left, right):
        left = left.sort_values("rn")
        g = square(right["g"].iloc[0]) if len(right) else None
        out: list[tuple] = []
        vectors, at, seen = left[column].to_numpy(), np.flatnonzero(left["is_origin"].to_numpy()), 0
        present = np.flatnonzero([v is not None for v in vectors])
        x = np.stack(vectors[present]) if len(present) else None
        for place, row in zip(at, left.iloc[at].to_dict("records")):
            upto = int(np.searchsorted(present, place, "right"))
            if upto > seen:
                own = x[seen:upto]
                g, seen = own.T @ own if g is None else g + own.T @ own, upto
            if g is not None:
                for made in solve(g, row):
                    out.append(tuple([*key[: len(keys)], *[made[n] for n in names[len(keys):]]]))
        return pd.DataFrame(out, columns=names)

    return rows.groupBy(*on).cogroup(carry.groupBy(*on)).applyInPandas(walk, out_schema)
