"""Self-supervised recovery of hidden demand and its masking test."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import arrays as A
from shelfcast.functions.metrics import hourly_metrics
from shelfcast.functions.quantiles import running_total_by_hash, seeded_hash
from shelfcast.operators.booster import MODEL, BoosterModel, BoosterParams, BoosterSet, fit_booster, fit_boosters
from shelfcast.operators.hourly import (MIN_DAYS, profile_recover, recover_by_profile, recovery_features,
                                        with_profile)
from shelfcast.schemas import PANEL_KEY
from shelfcast.session import stored

INPUTS = ["observed", "share_in", "profile_est", "level", "oos_hours", "first_oos_hour", "last_oos_hour", "dow",
          "discount", "holiday_flag", "activity_flag", "avg_temperature", "precpt", "third_category_id"]
FEATURES = [f"x_{c}" for c in INPUTS]
# The group each input is reported under.
INPUT_GROUPS = {
    "observed": "partial day", "oos_hours": "partial day", "first_oos_hour": "partial day",
    "last_oos_hour": "partial day", "share_in": "profile hint", "profile_est": "profile hint",
    "level": "series level", "discount": "promo", "activity_flag": "promo", "dow": "calendar",
    "holiday_flag": "calendar", "avg_temperature": "weather", "precpt": "weather",
    "third_category_id": "category",
}
PARAMS = BoosterParams(variance_power=1.3, rounds=30, min_rows=20)


def transplant_masks(targets: DataFrame, donors: DataFrame, seed: int) -> DataFrame:
    """Give every target row the stock-out hours (``mask``) of one pseudo-random donor row.

    Donors are numbered from 0 in the order of a seeded hash, range by range, so no task orders them
    all; a target's number is a hash of its key modulo the number of donors. One equi-join, every
    donor equally likely, and the same result however the data is partitioned.
    """
    n_donors = donors.count()
    if n_donors == 0:
        return targets.limit(0).withColumn("mask", F.col("hours_stock_status"))
    donor = F.concat_ws(":", *PANEL_KEY, "dt")
    named = donors.select(donor.alias("donor"), F.col("hours_stock_status").alias("mask"), F.lit(1).alias("one"))
    numbered = running_total_by_hash(named, "donor", "one", seed).select(F.col("total_before").alias("slot"), "mask")
    pick = F.pmod(seeded_hash(donor, seed + 1), F.lit(n_donors))
    return targets.withColumn("slot", pick).join(numbered, "slot").drop("slot")


def masked_days(rows: DataFrame, donors: DataFrame, seed: int) -> DataFrame:
    """Clean days with real stock-out hours hidden, features of what is left, and the hidden truth."""
    masked = transplant_masks(rows, donors, seed).where(A.empty_hours("mask") > 0)
    hidden = masked.withColumn("masked_sale", A.hide("hours_sale", "mask"))
    return recovery_features(hidden, "masked_sale", "mask").withColumn("truth", A.total("hours_sale"))


def fit_recovery(profiled: DataFrame, fit: Column, seed: int = 42, params: BoosterParams = PARAMS) -> BoosterModel:
    clean = A.is_clean("hours_stock_status")
    samples = masked_days(profiled.where(clean & fit), profiled.where(~clean & fit), seed)
    return fit_booster(samples, FEATURES, "truth", [*PANEL_KEY, "dt"], ["x_third_category_id"],
                       replace(params, seed=seed))


def apply_recovery(models: BoosterSet, profiled: DataFrame, by: str | None = None) -> DataFrame:
    """``rec_model``: the estimate of the row's model (numbered in ``by``) on stock-out days, never below what was sold."""
    keep = [c for c in profiled.columns if c != by]
    scored = models.transform(recovery_features(profiled), by, "estimate")
    observed = F.col("observed")
    value = F.when(A.is_clean("hours_stock_status"), observed).otherwise(F.col("estimate"))
    return scored.select(*keep, F.greatest(observed, value).alias("rec_model"))


def recover_folds(panel: DataFrame, cutoffs: list[int], seed: int = 42, with_model: bool = True, min_days: int = MIN_DAYS,
                  params: BoosterParams = PARAMS) -> tuple[DataFrame, BoosterSet | None]:
    """Every fold's panel rows (``cutoff_day`` says which) with ``observed``, ``rec_profile`` and, with a model, ``rec_model``.

    The models of all folds are fitted together.
    """
    parts = [recover_by_profile(panel, c, min_days).withColumns({"cutoff_day": F.lit(c), MODEL: F.lit(k)}) for k, c in enumerate(cutoffs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if not with_model:
        return out.drop(MODEL), None
    out = stored(out, "recovery-folds")  # read for clean days, donors and scoring
    clean, known = A.is_clean("hours_stock_status"), F.col("day") <= F.col("cutoff_day")
    samples = None
    for k in range(len(cutoffs)):
        fold = out.where((F.col(MODEL) == k) & known)
        own = masked_days(fold.where(clean), fold.where(~clean), seed)
        samples = own if samples is None else samples.unionByName(own)
    models = fit_boosters(samples, MODEL, len(cutoffs), FEATURES, "truth", [*PANEL_KEY, "dt"], ["x_third_category_id"], replace(params, seed=seed))
    return apply_recovery(models, out, MODEL), models


def recover(panel: DataFrame, cutoff: int, seed: int = 42, with_model: bool = True, min_days: int = MIN_DAYS,
            params: BoosterParams = PARAMS) -> tuple[DataFrame, BoosterModel | None]:
    """One fold of ``recover_folds``."""
    out, models = recover_folds(panel, [cutoff], seed, with_model, min_days, params)
    return out.drop("cutoff_day"), None if models is None else models[0]


def recovery_importance(model: BoosterModel) -> DataFrame:
    """Gain share of each input of the recovery model and its group."""
    name = F.substring("feature", 3, 100)
    groups = F.create_map(*[F.lit(v) for kv in INPUT_GROUPS.items() for v in kv])
    return model.importance().select(name.alias("feature"), "gain_pct",
                                     F.coalesce(F.try_element_at(groups, name), F.lit("other")).alias("input_group"))


def importance_by_group(importance: DataFrame) -> DataFrame:
    return importance.groupBy("input_group").agg(F.sum("gain_pct").alias("gain_pct"))


def held_out(share: float, seed: int) -> Column:
    """Whole series set aside by a seeded hash."""
    return F.pmod(seeded_hash(F.concat_ws(":", *PANEL_KEY), seed), F.lit(10_000)) < round(share * 10_000)


def validate_recovery(panel: DataFrame, cutoff: int, holdout_share: float = 0.2, seed: int = 7,
                      min_days: int = MIN_DAYS, params: BoosterParams = PARAMS, with_model: bool = True) -> DataFrame:
    """Masking test on held-out series: hide hours of clean days, recover, score against the truth.

    Profiles and the model never see the held-out series; their own level and everyone's stock-out
    patterns may be used. Without a model only the rules are scored.
    """
    clean = A.is_clean("hours_stock_status")
    known, hold = F.col("day") <= cutoff, held_out(holdout_share, seed)
    rows = stored(with_profile(panel, clean & known & ~hold, clean & known, min_days), "recovery-validation")
    tests = masked_days(rows.where(clean & known & hold), rows.where(~clean & known), seed + 1)
    left = F.col("x_observed")
    values = {"observed (no recovery)": left,
              "profile scaling": profile_recover(F.col("masked_sale"), F.col("mask"), F.col("profile"), F.col("level"))}
    if with_model:
        tests = fit_recovery(rows, known & ~hold, seed, params).transform(tests, "estimate")
        values["self-supervised booster"] = F.greatest(left, F.col("estimate"))
    methods = F.array(*[F.struct(F.lit(name).alias("method"), value.alias("value")) for name, value in values.items()])
    scored = tests.withColumn("m", F.explode(methods)).select("truth", left.alias("visible"), "m.method", "m.value")
    return scored.groupBy("method").agg(
        *hourly_metrics("truth", "value"), F.count(F.lit(1)).alias("n_masked_days"),
        (1 - F.sum("visible") / F.greatest(F.sum("truth"), F.lit(1e-9))).alias("avg_hidden_share"))
