"""Distance, decay, gravity, utility, rating and odds formulas as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
TRAVEL_RADIUS_KM = 6371.0


def euclidean_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def haversine_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle kilometres between degrees of longitude and latitude."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2.0 * radius_km) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def coordinate_distance(x1: Column, y1: Column, x2: Column, y2: Column, method: str = "euclidean") -> Column:
    known = {"euclidean": euclidean_distance, "haversine": haversine_distance}
    if method not in known:
        raise ValueError(f"unknown distance method: {method}")
    return known[method](x1, y1, x2, y2)


def _positive(**options: float) -> None:
    for name, value in options.items():
        if value <= 0:
            raise ValueError(f"{name} must be greater than zero")


def _least(value: Column, least: float, message: str) -> Column:
    """A value, or an error where it is below the least."""
    return F.when(value < least, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def _distance(distance: Column) -> Column:
    return _least(distance, 0.0, "distances must not be negative")


def power_decay(distance: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    _positive(scale=scale, power=power)
    return F.pow(1 + _distance(distance) / scale, F.lit(-power))


def exponential_decay(distance: Column, rate: float = 1.0) -> Column:
    _positive(rate=rate)
    return F.exp(-rate * _distance(distance))


def gaussian_decay(distance: Column, sigma: float = 1.0) -> Column:
    _positive(sigma=sigma)
    d = _distance(distance)
    return F.exp(-(d * d) / (2.0 * sigma * sigma))


def decay(
    distance: Column, method: str = "power", *, scale: float = 1.0, power: float = 2.0, rate: float = 1.0, sigma: float = 1.0
) -> Column:
    """A decay by name; an unknown name is an error."""
    if method == "power":
        return power_decay(distance, scale, power)
    if method == "exponential":
        return exponential_decay(distance, rate)
    if method == "gaussian":
        return gaussian_decay(distance, sigma)
    raise ValueError(f"unknown decay method: {method}")


def influence(weight: Column, distance: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    return weight * power_decay(distance, scale, power)


def interaction(origin: Column, destination: Column, distance: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    return origin * destination * power_decay(distance, scale, power)


def gravity_interaction(
    origin: Column, destination: Column, cost: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0, scale_factor: float = 1.0
) -> Column:
    """Masses over generalised cost; negative masses and costs that aren't positive are errors."""
    value = F.lit(scale_factor) * F.pow(origin, F.lit(alpha)) * F.pow(destination, F.lit(beta)) / F.pow(cost, F.lit(gamma))
    bad = (origin < 0) | (destination < 0) | (cost <= 0)
    return F.when(bad, F.raise_error(F.lit("masses must not be negative and costs must be positive")).cast("double")).otherwise(value)


def logistic_probability(predictors: dict[str, Column], coefficients: dict[str, float], intercept: float = 0.0) -> Column:
    """The sigmoid of a linear score; predictors without a coefficient count zero."""
    x = F.lit(float(intercept))
    for name in sorted(predictors):
        x = x + F.lit(float(coefficients.get(name, 0.0))) * predictors[name]
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def corridor_strength(weight: Column, length: Column, distance: Column, scale: float = 1.0, power: float = 2.0) -> Column:
    return weight * F.log1p(length) * power_decay(distance, scale, power)


def area_similarity(a: Column, b: Column, distance: Column, scale: float = 1.0, power: float = 1.0) -> Column:
    ratio = F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0.0)))
    return ratio * power_decay(distance, scale, power)


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Compass degrees, clockwise from north."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360, F.lit(360.0))


def alignment(x1: Column, y1: Column, x2: Column, y2: Column, preferred: float) -> Column:
    return F.cos(F.radians(bearing(x1, y1, x2, y2) - preferred))


def stress_index(load: Column, capacity: Column, power: float = 2.0) -> Column:
    return F.when(capacity <= 0, F.lit(0.0)).otherwise(F.pow(load / F.nullif(capacity, F.lit(0.0)), F.lit(power)))


def service_deficit(demand: Column, delivered: Column) -> Column:
    return F.when(demand <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (demand - delivered) / F.nullif(demand, F.lit(0.0))))
    )


def headloss_hazen_williams(length: Column, flow: Column, diameter: Column, roughness: float = 130.0) -> Column:
    """Zero for pipes without diameter or roughness."""
    if roughness <= 0:
        return F.when(length.isNotNull() & flow.isNotNull() & diameter.isNotNull(), F.lit(0.0))
    loss = 10.67 * length * F.pow(flow / roughness, F.lit(1.852)) / F.pow(F.nullif(diameter, F.lit(0.0)), F.lit(4.87))
    return F.when(diameter <= 0, F.lit(0.0)).otherwise(loss)


def aged_failure_rate(base: Column, age_years: Column, aging: float = 0.03) -> Column:
    """Negative rates, ages and factors are errors."""
    if aging < 0:
        raise ValueError("the aging factor must not be negative")
    return _least(base, 0.0, "failure rates must not be negative") * F.exp(aging * _least(age_years, 0.0, "ages must not be negative"))


def expected_impact(probability: Column, consequence: Column) -> Column:
    """Probabilities outside 0 to 1, and negative consequences, are errors."""
    bad = (probability < 0) | (probability > 1) | (consequence < 0)
    return F.when(
        bad, F.raise_error(F.lit("probabilities must be in 0 to 1 and consequences not negative")).cast("double")
    ).otherwise(probability * consequence)


def accessibility_score(supplies: Column, costs: Column, method: str = "power", **options: float) -> Column:
    """Sum of supplies, each decayed by its cost, over two aligned arrays."""
    return F.aggregate(F.zip_with(supplies, costs, lambda s, c: s * decay(c, method, **options)), F.lit(0.0), lambda a, v: a + v)


def resilience_index(
    redundancy: Column, recovery: Column, robustness: Column, deficit: Column, weights: Sequence[float] = (0.3, 0.25, 0.25, 0.2)
) -> Column:
    """Weighted scores less the weighted deficit, over the sum of weights."""
    a, b, c, d = weights
    if min(weights) < 0 or sum(weights) == 0:
        raise ValueError("weights must not be negative, and one must be greater than zero")
    return (a * redundancy + b * recovery + c * robustness - d * deficit) / sum(weights)


#: Metres, and cubic metres a second, in one of each unit.
UNITS = {
    "distance": {"m": 1.0, "km": 1000.0, "mi": 1609.344},
    "flow": {"m3s": 1.0, "lps": 0.001, "gpm": 0.0000630901964},
}


def convert_units(value: Column, source: str, target: str, quantity: str = "distance") -> Column:
    known = UNITS[quantity]
    return value * known[source] / known[target]


def implied_probability(odds: Column) -> Column:
    return F.when(odds <= 1, F.lit(0.0)).otherwise(1 / odds)


def normalised_market(odds: Column) -> Column:
    """A map of decimal odds as probabilities that sum to one."""
    raw = F.transform_values(odds, lambda _, v: implied_probability(v))
    total = F.aggregate(F.map_values(raw), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(raw, lambda _, v: F.when(total > 0, v / total).otherwise(F.lit(0.0)))


def elo_expected(rating: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - rating) / 400))


def margin_multiplier(difference: Column) -> Column:
    """How much a margin of victory counts; one without a margin."""
    d = F.abs(difference)
    return F.when(d == 0, F.lit(1.0)).otherwise(F.log(d + 1) * 2.2 / (0.001 * d + 2.2))


def travel_penalty(km: Column, most: float = 0.15) -> Column:
    """Nothing below 500 km, then with the logarithm up to ``most`` at 8000 km."""
    return F.when(km < 500, F.lit(0.0)).otherwise(F.least(F.lit(most), most * F.log(km / 500) / math.log(16)))


def normal_two_sided(z: Column) -> Column:
    """The two-sided p-value of a standard normal statistic (rational approximation of erfc, error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


#: Coefficients of the approximation (Numerical Recipes, erfcc), in ascending powers.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / F.greatest(nir + red, F.lit(1e-6))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1)


def trend_label(change: Column, tolerance: float = 1e-9) -> Column:
    return F.when(change > tolerance, "up").when(change < -tolerance, "down").otherwise("flat")


def threshold_status(value: Column, low: Column, high: Column, status: Column) -> Column:
    """``offline`` stays; a value outside its limits is an ``alert``; others are ``normal``."""
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    return F.when(F.lower(status) == "offline", "offline").when(outside, "alert").otherwise("normal")


def alert_score(value: Column, low: Column, high: Column, fallback: Column) -> Column:
    """How far a value is towards its limit, to two digits, else the fallback."""
    return F.when(
        high.isNotNull() & (high != 0), F.round(value / F.nullif(high, F.lit(0.0)), 2)
    ).when(low.isNotNull() & (value != 0), F.round(low / F.nullif(value, F.lit(0.0)), 2)).otherwise(fallback)
