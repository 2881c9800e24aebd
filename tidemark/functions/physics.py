"""Physical relations and measurement steps as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturation_vapour_pressure(celsius: Column) -> Column:
    """Magnus formula over water, hPa."""
    return 6.112 * F.exp(17.62 * celsius / (243.12 + celsius))


def relative_humidity(vapour: Column, celsius: Column) -> Column:
    return F.least(100 * vapour / saturation_vapour_pressure(celsius), F.lit(100.0))


def vapour_pressure(celsius: Column, humidity: Column) -> Column:
    return humidity / 100 * saturation_vapour_pressure(celsius)


def foreign_fraction(gases: dict[str, Column], clean: dict[str, float], explosive: dict[str, float]) -> Column:
    """The share of air that gases take over clean air: parts per million, and for those of `explosive` (lower limits in
    percent of volume) percent of that limit."""
    over = {g: F.greatest(x - clean.get(g, 0.0), F.lit(0.0)) for g, x in gases.items()}
    return sum((x / 100 * explosive[g] / 100 if g in explosive else x * 1e-6 for g, x in over.items()), F.lit(0.0))


def oxygen(clean_percent: float, fraction: Column) -> Column:
    return clean_percent * (1 - fraction)


def pressure_at(sea_level: Column, metres: Column) -> Column:
    """International standard atmosphere."""
    return sea_level * F.pow(1 - 2.25577e-5 * metres, F.lit(5.25588))


def quantised(x: Column, resolution: float, low: float | None = None, high: float | None = None) -> Column:
    """Nearest multiple of the resolution, halves to even, to ten digits and without a negative zero, then clipped to the range."""
    y = F.round(F.rint(x / resolution) * resolution, 10) + 0.0
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    return F.least(y, F.lit(float(high))) if high is not None else y


def deadband(x: Column, centre: float, width: float) -> Column:
    """Readings less than width from the centre read as the centre."""
    return F.when(F.abs(x - centre) < width, F.lit(float(centre))).otherwise(x)


def step(t: Column, at: float, value: float, before: float = 0.0) -> Column:
    return F.when(t >= at, F.lit(value)).otherwise(F.lit(before))


def ramp(t: Column, start: float, duration: float, a: float, b: float) -> Column:
    if duration <= 0:
        return step(t, start, b, a)
    return a + (b - a) * F.least(F.greatest((t - start) / duration, F.lit(0.0)), F.lit(1.0))


def pulse(t: Column, start: float, duration: float, level: float, edge: float = 0.0) -> Column:
    """A trapezoid of total length duration + 2 edges; without edges a half-open box."""
    if edge <= 0:
        return F.when((t >= start) & (t < start + duration), F.lit(level)).otherwise(F.lit(0.0))
    up, down = (t - start) / edge, (start + duration + 2 * edge - t) / edge
    return level * F.least(F.greatest(F.least(up, down), F.lit(0.0)), F.lit(1.0))


def periodic(t: Column, period: float, amplitude: float, offset: float = 0.0, phase: float = 0.0) -> Column:
    return offset + amplitude * F.sin(2 * math.pi * (t - phase) / period)


def duty_cycle(t: Column, period: float, duty: float, on: float, off: float = 0.0, phase: float = 0.0) -> Column:
    return F.when(F.pmod(t - phase, F.lit(period)) < duty * period, F.lit(on)).otherwise(F.lit(off))


def uniform(seed: str, stream: str, i: Column) -> Column:
    """A uniform draw of (seed, stream, i) that doesn't depend on partitioning."""
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit(stream), i.cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
