"""Units: each known spelling is (base unit, scale, offset), and a conversion is the table of all spellings that can be written in a target."""

from __future__ import annotations

from fractions import Fraction
from itertools import chain, product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of units; units as (base, how many of it, what is added first); time units in hours; what "%" can stand for.
SPELLINGS = {
    "°C": ["C", "degC", "deg C", "℃"], "%RH": ["%rh", "% RH", "RH%"], "%vol": ["% vol", "%v/v"], "%LEL": ["% LEL", "%lel"], "lx": ["lux"], "°/s": ["dps", "deg/s", "º/s"],
    "µT": ["uT", "μT"], "s": ["sec"], "Hz": ["Hertz"], "√Hz": ["sqrt(Hz)", "rtHz"], "A": ["amp"], "%VWC": ["VWC%", "% VWC"], "°F": ["degF", "F"], "K": ["kelvin"],
}
IN_BASE = {
    "Pa": ("hPa", "0.01", "0"), "kPa": ("hPa", "10", "0"), "mbar": ("hPa", "1", "0"), "mg": ("g", "0.001", "0"), "µg": ("g", "0.000001", "0"), "ug": ("g", "0.000001", "0"),
    "m/s²": ("g", "100000/980665", "0"), "m/s^2": ("g", "100000/980665", "0"), "mdps": ("°/s", "0.001", "0"), "rad/s": ("°/s", "57.29577951308232", "0"), "G": ("µT", "100", "0"),
    "mG": ("µT", "0.1", "0"), "nT": ("µT", "0.001", "0"), "ppb": ("ppm", "0.001", "0"), "ms": ("s", "0.001", "0"), "min": ("s", "60", "0"), "h": ("s", "3600", "0"), "mA": ("A", "0.001", "0"),
    "in/s": ("mm/s", "25.4", "0"), "µm/s": ("mm/s", "0.001", "0"), "°F": ("°C", "5/9", "-32"), "K": ("°C", "1", "-273.15"),
}
HOURS = {"s": "1/3600", "min": "1/60", "h": "1", "hour": "1", "day": "24", "d": "24", "week": "168", "month": "730", "year": "8760", "yr": "8760"}
PERCENT = {"%RH", "%vol", "%LEL", "%VWC"}

NAMES = {s: name for name, others in SPELLINGS.items() for s in (name, *others)}
BASES = {base for base, _, _ in IN_BASE.values()}


def spelled(name: str) -> list[str]:
    return [name, *SPELLINGS.get(name, [])]


def simple(target: str) -> dict[str, tuple[Fraction, Fraction]]:
    """(scale, offset) of every spelling that can be written as a target without a denominator: y = x * scale + offset."""
    base, scale, added = IN_BASE.get(target, (target, "1", "0"))
    alike = {name: (Fraction(s), Fraction(a)) for name, (b, s, a) in IN_BASE.items() if b == base} | {base: (Fraction(1), Fraction(0))}
    alike |= {"%": alike[base]} if base in PERCENT else {}
    # Into the base by (x + a) * s, out of it by the inverse of the target's own.
    return {text: (s / Fraction(scale), a * s / Fraction(scale) - Fraction(added)) for name, (s, a) in alike.items() for text in spelled(name)}


def conversions(target: str) -> dict[str, tuple[float, float]]:
    """(scale, offset) of every spelling that can be written as the target; a quantity by time or by the root of a frequency has no offset."""
    goal = NAMES.get(target.strip(), target.strip())
    over, slash, under = goal.rpartition("/")
    if not slash or goal in IN_BASE or goal in BASES:
        return {text: (float(s), float(o)) for text, (s, o) in simple(goal).items()}
    under = NAMES.get(under, under)
    shares = {per: Fraction(HOURS[under]) / Fraction(h) for per, h in HOURS.items()} if under in HOURS else dict.fromkeys(spelled(under), Fraction(1))
    return {f"{text}/{per}": (float(s * share), 0.0) for (text, (s, _)), (per, share) in product(simple(NAMES.get(over, over)).items(), shares.items())}


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def factor(unit: Column, target: str) -> Column:
    """What takes an amount or a difference in unit to the target; null where it can't be, and for units that start elsewhere (temperatures)."""
    table = {text: scale for text, (scale, offset) in conversions(target).items() if not offset}
    return lookup(table, F.regexp_replace(F.trim(unit), r"\s*/\s*", "/"))


def output_transform(unit: str, target: str, absolute: bool = True) -> tuple[float, float]:
    """(scale, offset) that writes a column of one unit in another; differences (not absolute) and rates have no offset."""
    found = conversions(target).get(unit.strip())
    if found is None:
        raise ValueError(f"{unit} can't be written as {target}")
    return found[0], found[1] if absolute else 0.0
