"""Split-conformal bands from exact order statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions.scalars import is_finite
from tideframe.operators.order_statistics import pick_ranks
from tideframe.panel import null_safe_join


def conformal_quantiles(
    residuals: DataFrame, groups: Sequence[str], residual: str, levels: Mapping[str, float], strict: bool = True
) -> DataFrame:
    """The ceil((n+1)q)-th smallest absolute residual per group and level.

    Beyond n no finite guarantee exists: the job fails, or with ``strict=False`` the
    cell is null. Wider levels never get narrower bands.
    """
    on = list(groups)
    sizes = residuals.groupBy(*on).agg(F.count_if(is_finite(F.col(residual).cast("double"))).alias("n_cal"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(q).alias("q")) for k, q in levels.items()]))
    wanted = sizes.withColumn("_c", cells).select(*on, "n_cal", F.col("_c.label").alias("label"), F.col("_c.q").alias("q"))
    rank = F.ceil(F.round((F.col("n_cal") + 1) * F.col("q"), 9))
    message = F.format_string("%d calibration rows cannot support level %s", F.col("n_cal"), F.col("label"))
    beyond = F.raise_error(message).cast("long") if strict else F.lit(None).cast("long")
    wanted = wanted.withColumn("rank", F.when(rank <= F.col("n_cal"), rank).otherwise(beyond))
    absolute = residuals.withColumn("_abs", F.abs(residual))
    picked = pick_ranks(absolute, on, "_abs", wanted.select(*on, "label", "rank"))
    wide = null_safe_join(wanted, picked, [*on, "label"], "left").groupBy(*on, "n_cal").agg(
        *[F.max(F.when(F.col("label") == k, F.col("value"))).alias(k) for k in levels])
    ordered = sorted(levels, key=levels.get)
    return wide.withColumns({
        k: F.when(F.col(k).isNotNull(), F.greatest(*[F.col(j) for j in ordered[: i + 1]]))
        for i, k in enumerate(ordered) if i})
