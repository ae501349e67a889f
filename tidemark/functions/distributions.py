"""Distribution functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of the Lanczos approximation of the gamma function for g = 7 with nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of 1/2 or more."""
    y = x - 1
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + k)
    t = y + 7.5
    return F.lit(0.91893853320467274) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def _fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, by the modified method of Lentz, two levels a step."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def level(s: Column, factor: Column) -> Column:
        d = 1 / safe(1 + factor * s["d"])
        c = safe(1 + factor / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        once = F.transform(F.array(level(s, even)), lambda e: level(e, odd))
        return F.get(once, F.lit(0))

    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), start, step)["h"]


def regularized_beta(a: Column, b: Column, x: Column, terms: int = 300) -> Column:
    """I_x(a, b), the distribution function of the beta distribution, for a and b of 1/2 or more. ``terms`` serve for a
    and b up to about the square of a tenth of them to full accuracy."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    direct = front * _fraction(a, b, x, terms) / a
    mirrored = 1 - front * _fraction(b, a, 1 - x, terms) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)


def t_test_p(t: Column, freedom: Column) -> Column:
    """The two-sided p-value of a t statistic; null without degrees of freedom."""
    n = freedom.cast("double")
    return F.when(n > 0, regularized_beta(n / 2, F.lit(0.5), n / (n + t * t)))
