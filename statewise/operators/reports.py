"""Result tables over term estimates: what each holds, its rounding and its order (`place` from 1, ties by term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import Z975, normal_cdf
from ..sources.shared import numbered
from .inference import bayes_fdr, loo_summary, posterior_summary


def _placed(table: DataFrame, *order: Column) -> DataFrame:
    """Rows numbered in their order; a table has one row for each term of a model, so one window holds it."""
    return table.withColumn("place", F.row_number().over(W.orderBy(*order, "term")))


def effect_table(terms: DataFrame, capped: bool = False) -> DataFrame:
    """(term, coef, sd) -> estimates with odds ratios and evidence, largest Bayes factor first."""
    t = posterior_summary(terms, capped=capped)
    cols = {"coef": F.round("coef", 3), "sd": F.round("sd", 3), "prob_positive": F.round("prob_positive", 3), "odds_ratio": F.round("odds_ratio", 3), "or_lower": F.round(F.exp("ci_lower"), 3), "or_upper": F.round(F.exp("ci_upper"), 3)}
    ranked = _placed(t, F.desc("bayes_factor"))
    return ranked.select("term", *[c.alias(n) for n, c in cols.items()], F.round("bayes_factor", 2).alias("bayes_factor"), "evidence", "place")


def group_posteriors(main: DataFrame, interaction: DataFrame, coding: str = "deviation") -> DataFrame:
    """Each term's normal posterior in either group, and the chance that it is stronger in one.

    With deviation coding a is the group coded +1 and b the one coded -1; with
    treatment coding a is the reference, whose effect is the main one alone,
    and b the other.  `prob_stronger` is for the group that the interaction
    favours when it is positive: a by deviation, b by treatment.  Covariances
    of the two estimates are left out.
    """
    both = interaction.select("term", F.col("coef").alias("diff"), F.col("sd").alias("sd_diff"))
    j = main.select("term", "coef", "sd").join(both, "term")
    joint = F.sqrt(F.col("sd") * F.col("sd") + F.col("sd_diff") * F.col("sd_diff"))
    with_, without = F.col("coef") + F.col("diff"), F.col("coef") - F.col("diff")
    sides = {"a": (with_, joint), "b": (without, joint)} if coding == "deviation" else {"a": (F.col("coef"), F.col("sd")), "b": (with_, joint)}
    cols: list[Column] = []
    for g, (effect, sd) in sides.items():
        cols += [effect.alias(f"coef_{g}"), sd.alias(f"sd_{g}"), F.exp(effect).alias(f"or_{g}"), F.exp(effect - Z975 * sd).alias(f"or_lower_{g}"), F.exp(effect + Z975 * sd).alias(f"or_upper_{g}"), normal_cdf(effect / sd).alias(f"prob_positive_{g}")]
    return j.select("term", *cols, "diff", "sd_diff", normal_cdf(F.col("diff") / F.col("sd_diff")).alias("prob_stronger"))


def group_table(main: DataFrame, interaction: DataFrame, coding: str = "deviation") -> DataFrame:
    """Effects in either group, largest difference first; the order is that of the rounded differences."""
    t = group_posteriors(main, interaction, coding)
    shown = ["coef_a", "or_a", "prob_positive_a", "coef_b", "or_b", "prob_positive_b", "diff", "prob_stronger"]
    return _placed(t.select("term", *[F.round(c, 3).alias(c) for c in shown]), F.desc(F.abs("diff")))


def comparison_table(terms: DataFrame, alpha: float = 0.05, strict: bool = False) -> DataFrame:
    """(term, prob_direction) -> running false discovery rate, least first, and whether the term is credible."""
    ranked = numbered(bayes_fdr(terms, alpha, strict), F.col("fdr"), F.col("term"), name="place").withColumn("place", F.col("place") + 1)
    return ranked.select("term", F.round("prob_direction", 3).alias("prob_direction"), F.round("fdr", 3).alias("fdr"), "credible", "place")


def fold_table(loo: DataFrame, groups: tuple[str, str] | None = None) -> DataFrame:
    """Leave-one-out coefficients (term, grp, coef) by term and group, most stable first; terms without a ratio come last."""
    shown = ["mean_a", "sd_a", "mean_b", "sd_b", "stability"]
    rounded = loo_summary(loo, groups).select("term", *[F.round(c, 4).alias(c) for c in shown])
    return _placed(rounded, F.desc_nulls_last("stability"))
