"""Expressions over one row's arrays: spectra, envelopes, interleaved IQ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandsift import params as P


def rint_long(value: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(value).cast("bigint")


def bind(value: Column, use) -> Column:
    """Evaluate `value` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def indices(n: Column) -> Column:
    """0 .. n-1; empty when n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.expr("cast(array() as array<int>)")
    )


def percentile_of(values: Column, q: float) -> Column:
    """Linearly interpolated percentile of one array; null for an empty one."""

    def pick(ordered: Column) -> Column:
        place = (F.size(ordered) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        high = F.ceil(place).cast("int")
        lower, upper = F.get(ordered, low), F.get(ordered, high)
        return lower + (upper - lower) * (place - low)

    return bind(F.sort_array(values), pick)


def frame_floor_of(power: Column) -> Column:
    """Robust floor of one spectrum: its 25th percentile."""
    return F.coalesce(percentile_of(power, P.FLOOR_PERCENTILE), F.lit(P.EMPTY_FLOOR_DB))


def _edge(n: Column, groups: int, i: Column) -> Column:
    return (i * (n.cast("double") / F.lit(groups))).cast("int")


def _group(values: Column, n: Column, groups: int, i: Column) -> Column:
    low = _edge(n, groups, i)
    high = F.when(i == groups - 1, n).otherwise(_edge(n, groups, i + 1))
    return F.slice(values, low + 1, F.greatest(high - low, F.lit(1)))


def reduce_bins(power: Column, target: int) -> Column:
    """Max-pool a spectrum to `target` bins; unchanged when it already fits."""
    n = F.size(power)
    pooled = F.transform(
        F.sequence(F.lit(0), F.lit(max(target, 1) - 1)),
        lambda i: F.array_max(_group(power, n, max(target, 1), i)),
    )
    fits = (n <= target) | F.lit(target <= 0)
    return F.when(fits, power).otherwise(pooled).cast("array<float>")


def frequency_axis(f0: Column, step: Column, n: Column, target: int) -> Column:
    """Linear axis matching `reduce_bins`."""
    last = f0 + step * (n - 1)
    full = F.transform(indices(n), lambda i: f0 + step * i)
    reduced = F.transform(
        F.sequence(F.lit(0), F.lit(max(target, 1) - 1)),
        lambda i: f0 + (last - f0) / F.lit(max(target - 1, 1)) * i,
    )
    return F.when((n <= target) | F.lit(target <= 0), full).otherwise(reduced)


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.size(values)


def magnitudes(iq: Column) -> Column:
    """|x| of interleaved complex samples."""

    def one(i: Column) -> Column:
        re = F.get(iq, i * 2).cast("double")
        im = F.get(iq, i * 2 + 1).cast("double")
        return F.sqrt(re * re + im * im)

    return F.transform(indices((F.size(iq) / 2).cast("int")), one)


def envelope_db(iq: Column, points: int = P.ENVELOPE_POINTS) -> Column:
    """Amplitude envelope in dB: means of equal runs of |x|, or |x| itself when short."""
    k = max(16, points)

    def reduce(mag: Column) -> Column:
        per = F.floor(F.size(mag) / F.lit(k)).cast("int")
        means = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: mean_of(F.slice(mag, i * per + 1, F.greatest(per, F.lit(1)))),
        )
        return F.when(F.size(mag) >= k, means).otherwise(mag)

    return F.transform(bind(magnitudes(iq), reduce), lambda m: 20.0 * F.log10(m + 1e-12))


def normalize_envelope(values: Column, bins: int = 16) -> Column:
    """Shape only: bucket means scaled to 0..1, zeros when flat or empty."""
    n = F.size(values)
    zeros = F.array_repeat(F.lit(0.0), bins)
    buckets = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: mean_of(_group(values, n, bins, i))
    )

    def scale(means: Column) -> Column:
        low, high = F.array_min(means), F.array_max(means)
        return F.when(high - low < 1e-9, zeros).otherwise(
            F.transform(means, lambda m: F.bround((m - low) / (high - low), 4))
        )

    return F.when(n == 0, zeros).otherwise(bind(buckets, scale))


def finite_or_null(power: Column) -> Column:
    """Non-finite values become null."""
    bad = lambda p: F.isnan(p) | (F.abs(p) == F.lit(float("inf")))
    return F.transform(power, lambda p: F.when(bad(p), F.lit(None)).otherwise(p))
