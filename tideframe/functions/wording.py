"""Verdict sentences as column expressions. The wording is fixed; the branches are ours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairwise_verdict(a: Column, b: Column) -> Column:
    """Six outcomes of a pairwise test on squared and absolute loss.

    Reads ``n_forecasts, insufficient_sample, a_better_rmse, b_better_rmse,
    a_better_mae, b_better_mae, p_squared, p_absolute``.
    """
    col = F.col
    rmse = F.when(col("a_better_rmse"), a).when(col("b_better_rmse"), b)
    mae = F.when(col("a_better_mae"), a).when(col("b_better_mae"), b)
    rival = F.when(rmse == a, b).otherwise(a)
    only = "%s significantly better than the rival on %s only (p=%.4f); %s not significant"
    return (
        F.when(
            col("insufficient_sample"),
            F.format_string("insufficient sample (n=%d) to run the DM test at this horizon", col("n_forecasts")),
        )
        .when(rmse == mae, F.format_string("%s significantly better than %s (RMSE and MAE agree)", rmse, rival))
        .when(
            rmse.isNotNull() & mae.isNotNull(),
            F.format_string(
                "mixed result: RMSE and MAE are both significant but disagree on which of "
                "%s/%s wins -- don't headline this as a robust result", a, b),
        )
        .when(rmse.isNotNull(), F.format_string(only, rmse, F.lit("RMSE"), col("p_squared"), F.lit("MAE")))
        .when(mae.isNotNull(), F.format_string(only, mae, F.lit("MAE"), col("p_absolute"), F.lit("RMSE")))
        .otherwise("no significant difference on either RMSE or MAE")
    )


def nested_verdict(model: Column, significant: Column, p: Column) -> Column:
    """Outcome of a nested-model test; ``p`` and ``significant`` may be raw or adjusted."""
    five = lambda name: F.coalesce(F.format_string("%.5f", F.round(name, 6)), F.lit("N/A"))
    stat, shown_p = F.round("cw_stat", 3), F.round(p, 4)
    adjusted = F.format_string(
        "(CW=%.3f, p=%.4f; MSPE_naive=%s, MSPE_adj=%s)", stat, shown_p, five("mspe_naive"), five("mspe_model_adj"))
    plain = F.format_string(
        "(CW=%.3f, p=%.4f; MSPE_naive=%s, MSPE_model=%s)", stat, shown_p, five("mspe_naive"), five("mspe_model"))
    return (
        F.when(
            F.col("insufficient_sample"),
            F.format_string("insufficient sample (n=%d) to run Clark-West test", F.col("n_forecasts")),
        )
        .when(stat.isNull() | shown_p.isNull(), "insufficient data to compute verdict")
        .when(significant, F.concat(model, F.lit(" significantly outperforms Naïve benchmark after Clark-West MSPE adjustment "), adjusted))
        .when(stat <= 0, F.concat(F.lit("No significant improvement: "), model, F.lit(" does not beat Naïve under Clark-West "), plain))
        .otherwise(F.concat(F.lit("Positive point gain not statistically significant: "), model, F.lit(" fails to reject equal accuracy "), adjusted))
    )
