"""Crop, soil and nutrient features as native column expressions.

Every function returns ``{feature name: Column}``; callers put all of them
into one ``select``, so a row is read and written once.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktab.schema import Columns

# --- Fixed values -----------------------------------------------------------
# Temperature range per crop, degrees, both ends included.
CROP_TEMPERATURE_RANGE = {
    "Barley": (15, 25),
    "Cotton": (25, 35),
    "Ground Nuts": (25, 32),
    "Maize": (25, 32),
    "Millets": (25, 35),
    "Oil seeds": (20, 30),
    "Paddy": (25, 35),
    "Pulses": (20, 30),
    "Sugarcane": (26, 35),
    "Tobacco": (20, 30),
    "Wheat": (20, 30),
}
DEFAULT_TEMPERATURE_RANGE = (20, 32)

# Best temperature per crop.
CROP_OPTIMUM = {
    "Cotton": 30,
    "Maize": 28,
    "Paddy": 30,
    "Sugarcane": 30,
    "Tobacco": 25,
    "Wheat": 25,
}
DEFAULT_OPTIMUM = 27

# How well a crop does on a soil.
CROP_SOIL_STRENGTH = {
    "Cotton_Black": 1.0,
    "Cotton_Red": 0.8,
    "Maize_Black": 0.8,
    "Maize_Loamy": 1.0,
    "Paddy_Clayey": 1.0,
    "Paddy_Loamy": 0.8,
    "Sugarcane_Black": 1.0,
    "Sugarcane_Red": 0.8,
    "Tobacco_Loamy": 0.8,
    "Tobacco_Red": 1.0,
    "Wheat_Black": 0.8,
    "Wheat_Loamy": 1.0,
}
DEFAULT_STRENGTH = 0.5

# Comfort bands: below the first or above the second value is stress.
TEMPERATURE_BAND = (20, 35)
HUMIDITY_BAND = (40, 80)
MOISTURE_BAND = (30, 70)

RATIO_EPSILON = 1e-8
RATIO_CLIP = (0.0, 10.0)
# -----------------------------------------------------------------------------


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    """Look a key up in a small constant table; unknown or NULL keys give the default.

    The table is a literal in the plan: no join, no exchange.
    """
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(table.items()))])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def outside(value: Column, band: tuple[float, float]) -> Column:
    """1 when outside the band, else 0; NULL counts as 0."""
    low, high = band
    return F.coalesce(((value < low) | (value > high)).cast("int"), F.lit(0))


def sample_std(values: list[Column]) -> Column:
    """Sample standard deviation across the columns of a row (NULLs skipped)."""
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    total = sum((F.coalesce(v.cast("double"), F.lit(0.0)) for v in values), F.lit(0.0))
    mean = total / F.nullif(n, F.lit(0))
    squares = sum(
        (F.coalesce(F.pow(v - mean, F.lit(2.0)), F.lit(0.0)) for v in values), F.lit(0.0)
    )
    return F.sqrt(squares / F.nullif(n - 1, F.lit(0)))


def environment(c: Columns) -> dict[str, Column]:
    t, h, m = (F.col(x) for x in c.climate)
    return {
        "env_max": F.greatest(t, h, m),
        "temp_humidity_index": t * h / F.lit(100.0),
        "climate_comfort": (t + h + m) / F.lit(3.0),
        "temp_stress": outside(t, TEMPERATURE_BAND),
        "humidity_stress": outside(h, HUMIDITY_BAND),
        "moisture_stress": outside(m, MOISTURE_BAND),
    }


def _closeness(*distances: Column) -> Column:
    return F.lit(1.0) / sum(distances, F.lit(1.0))


def nutrients(c: Columns, epsilon: float = RATIO_EPSILON) -> dict[str, Column]:
    """Ratios, total, balance and product scores.

    Scores use the unclipped ratios. Zero denominators cannot occur for
    non-negative nutrients; ``try_divide`` keeps a negative outlier from
    failing the whole job.
    """
    n, p, k = (F.col(x).cast("double") for x in c.nutrients)
    np_ratio = F.try_divide(n, p + F.lit(epsilon))
    nk_ratio = F.try_divide(n, k + F.lit(epsilon))
    pk_ratio = F.try_divide(p, k + F.lit(epsilon))
    total = n + p + k

    def off(ratio: Column, target: float) -> Column:
        return F.abs(ratio - F.lit(target))

    def clip(ratio: Column) -> Column:
        low, high = RATIO_CLIP
        return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(low)), F.lit(high)))

    return {
        "N_P_ratio": clip(np_ratio),
        "N_K_ratio": clip(nk_ratio),
        "P_K_ratio": clip(pk_ratio),
        "Total_NPK": sum((F.col(x) for x in c.nutrients[1:]), F.col(c.nitrogen)),
        "NPK_balance": sample_std([F.col(x) for x in c.nutrients]),
        "NPK_17_17_17_score": _closeness(off(np_ratio, 1.0), off(nk_ratio, 1.0)),
        "NPK_28_28_score": _closeness(off(np_ratio, 1.0)),
        "NPK_10_26_26_score": _closeness(off(np_ratio, 0.38), off(pk_ratio, 1.0)),
        "NPK_20_20_score": _closeness(off(np_ratio, 1.0)),
        "NPK_14_35_14_score": _closeness(off(np_ratio, 0.4), off(nk_ratio, 1.0)),
        "DAP_score": _closeness(off(np_ratio, 0.78)),
        "Urea_score": F.try_divide(n, total + F.lit(epsilon)),
    }


def temperature_suitability(
    c: Columns, ranges: Mapping[str, tuple[float, float]] = CROP_TEMPERATURE_RANGE
) -> dict[str, Column]:
    """1 when the temperature lies in the crop's range, else 0."""
    low, high = DEFAULT_TEMPERATURE_RANGE
    floor = lookup(F.col(c.crop), {k: float(v[0]) for k, v in ranges.items()}, float(low))
    ceiling = lookup(F.col(c.crop), {k: float(v[1]) for k, v in ranges.items()}, float(high))
    fits = F.col(c.temperature).between(floor, ceiling).cast("int")
    return {"temp_suitability": F.coalesce(fits, F.lit(0))}


def crop_soil(
    c: Columns, strength: Mapping[str, float] = CROP_SOIL_STRENGTH
) -> dict[str, Column]:
    """Crop and soil joined by ``_`` (missing parts read ``nan``), and their strength."""
    combo = F.concat(
        F.coalesce(F.col(c.crop), F.lit("nan")),
        F.lit("_"),
        F.coalesce(F.col(c.soil), F.lit("nan")),
    )
    return {
        c.combo: combo,
        "crop_soil_strength": lookup(combo, strength, DEFAULT_STRENGTH),
    }


# --- Extra groups, tried one by one by the feature search --------------------


def nutrient_polynomials(c: Columns) -> dict[str, Column]:
    n, p, k = (F.col(x).cast("double") for x in c.nutrients)
    return {
        "NPK_polynomial": n * n + p * p + k * k,
        "NPK_log_sum": F.log1p(n + p + k),
    }


def climate_polynomials(c: Columns) -> dict[str, Column]:
    t, h, m = (F.col(x).cast("double") for x in c.climate)
    return {
        "env_polynomial": t * t + h * h + m * m,
        "temp_humidity_interaction": t * h / F.lit(1000.0),
    }


def crop_optimum(c: Columns, optimum: Mapping[str, float] = CROP_OPTIMUM) -> dict[str, Column]:
    best = lookup(
        F.col(c.crop), {k: float(v) for k, v in optimum.items()}, float(DEFAULT_OPTIMUM)
    )
    return {"advanced_crop_suitability": _closeness(F.abs(F.col(c.temperature) - best))}


def effectiveness(c: Columns) -> dict[str, Column]:
    std = sample_std([F.col(x) for x in c.nutrients])
    return {"fertilizer_effectiveness": F.exp(F.lit(-0.1) * std)}


def harmonic(c: Columns) -> dict[str, Column]:
    parts = [
        F.lit(1.0) / F.when(F.col(x).isNotNull(), F.greatest(F.col(x).cast("double"), F.lit(1.0)))
        for x in c.nutrients
    ]
    return {"NPK_harmonic_mean": F.lit(3.0) / (parts[0] + parts[1] + parts[2])}


def interaction(c: Columns) -> dict[str, Column]:
    """Product of two base features; both must already be columns."""
    return {"env_npk_interaction": F.col("env_max") * F.col("Total_NPK") / F.lit(1000.0)}


#: Group name -> (builder, columns it needs).
EXTRA_GROUPS = {
    "polynomial_npk": (nutrient_polynomials, lambda c: c.nutrients),
    "environmental_polynomials": (climate_polynomials, lambda c: c.climate),
    "advanced_crop_suitability": (crop_optimum, lambda c: [c.crop, c.temperature]),
    "fertilizer_effectiveness": (effectiveness, lambda c: c.nutrients),
    "harmonic_means": (harmonic, lambda c: c.nutrients),
    "interaction_terms": (interaction, lambda c: ["env_max", "Total_NPK"]),
}

#: Groups added in each round of the search (fixed values).
SEARCH_ROUNDS = {
    0: ["polynomial_npk", "environmental_polynomials"],
    1: ["advanced_crop_suitability", "fertilizer_effectiveness"],
    2: ["harmonic_means", "interaction_terms"],
}
