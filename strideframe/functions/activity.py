"""Column expressions on activity counts: cut points, metabolic equivalents, energy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intensity classes, from the lowest.
LEVELS = ["sedentary", "light", "moderate", "vigorous", "very_vigorous"]
MVPA = ("moderate", "vigorous", "very_vigorous")

#: The first and last count per minute of each class (the last one open).
FREEDSON = [(0, 100), (101, 1951), (1952, 5724), (5725, 9498), (9499, None)]
BROAD = [(0, 150), (151, 2200), (2201, 6000), (6001, 10000), (10001, None)]
#: The METs from which each class begins.
MET_BREAKS = [(1.5, "light"), (3.0, "moderate"), (6.0, "vigorous"), (9.0, "very_vigorous")]
DEFAULT_MASS = 70.0


def to_cpm(counts: Column, epoch_seconds: float) -> Column:
    """Counts per minute of counts per epoch."""
    if epoch_seconds <= 0:
        raise ValueError("the epoch length must be positive")
    return counts * 60.0 / epoch_seconds


def classify(cpm: Column, ranges: list[tuple[int, int | None]]) -> Column:
    """The class whose range holds the count; between ranges, below zero and for null it is null."""
    out = F.lit(None).cast("string")
    for name, (low, high) in zip(reversed(LEVELS), reversed(ranges)):
        inside = cpm >= low if high is None else cpm.between(low, high)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def freedson(cpm: Column) -> Column:
    return classify(cpm, FREEDSON)


def broad(cpm: Column) -> Column:
    return classify(cpm, BROAD)


CUT_POINTS: dict[str, Callable[[Column], Column]] = {"freedson": freedson, "broad": broad}


def classify_mets(mets: Column) -> Column:
    """Classes closed below; null for null."""
    out = F.when(mets < MET_BREAKS[0][0], F.lit("sedentary"))
    for (_, name), (limit, _) in zip(MET_BREAKS, MET_BREAKS[1:]):
        out = out.when(mets < limit, F.lit(name))
    return out.when(mets.isNotNull(), F.lit(MET_BREAKS[-1][1]))


def level_rank(level: Column) -> Column:
    """0 for the lowest class."""
    out = F.when(level == LEVELS[0], 0)
    for i, name in enumerate(LEVELS[1:], 1):
        out = out.when(level == name, i)
    return out


def is_mvpa(level: Column, levels: tuple[str, ...] = MVPA) -> Column:
    return F.coalesce(level.isin(*levels), F.lit(False))


def vector_magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def enmo(x: Column, y: Column, z: Column, truncate: bool = True) -> Column:
    """Euclidean norm less one g, by default not below zero."""
    out = vector_magnitude(x, y, z) - 1.0
    return F.greatest(out, F.lit(0.0)) if truncate else out


def body_mass(mass: Column) -> Column:
    return F.when(mass > 0, mass).otherwise(F.lit(DEFAULT_MASS))


def _linear(intercept: float, slope: float) -> Callable[..., Column]:
    return lambda cpm, vm, mass, age: intercept + slope * cpm


def _freedson_adult(cpm: Column, vm: Column, mass: Column, age: Column) -> Column:
    kcal = F.when(cpm > 1951, 0.00094 * cpm + 0.1346 * mass - 7.37418).otherwise(cpm * 0.0000191 * mass)
    return F.greatest(kcal * 200 / (mass * 3.5), F.lit(1.0))


#: METs from counts per minute, vector magnitude, mass (kg) and age; Crouter's needs a window (operators.energy).
METS: dict[str, Callable[..., Column]] = {
    "freedson_vm3": lambda cpm, vm, mass, age: 0.000863 * vm + 0.668876,
    "freedson_adult": _freedson_adult,
    "hendelman_adult": _linear(1.602, 0.000638),
    "hendelman_lifestyle": _linear(2.922, 0.000409),
    "swartz": _linear(2.606, 0.0006863),
    "leenders": _linear(2.240, 0.0006),
    "yngve_treadmill": _linear(0.751, 0.0008198),
    "yngve_overground": _linear(1.136, 0.0008249),
    "brooks_overground": _linear(2.32, 0.000389),
    "brooks_bm": lambda cpm, vm, mass, age: 3.33 + 0.00037 * cpm - 0.012 * mass,
    "freedson_children": lambda cpm, vm, mass, age: 2.757 + 0.0015 * cpm - 0.08957 * age - 0.000038 * cpm * age,
}


def mets(algorithm: str, cpm: Column, vm: Column, mass: Column | None = None, age: Column | None = None) -> Column:
    """METs by name; negative values and nulls become 0."""
    if algorithm == "freedson_children" and age is None:
        raise ValueError("freedson_children needs the age")
    value = METS[algorithm](cpm, vm, body_mass(F.lit(None).cast("double") if mass is None else mass), age)
    return F.coalesce(F.greatest(value, F.lit(0.0)), F.lit(0.0))


def _resting(mass: Column) -> Column:
    return 3.5 * mass / 200


def _williams(cpm: Column, mass: Column) -> Column:
    return cpm * 0.0000191 * mass


#: kcal a minute from counts per minute, unscaled and scaled vector magnitude, mass and the factor from epoch to minute.
ENERGY: dict[str, Callable[..., Column]] = {
    "williams": lambda cpm, vm, vmcpm, mass, scale: _williams(cpm, mass),
    "freedson": lambda cpm, vm, vmcpm, mass, scale: F.greatest(F.when(cpm > 1951, 0.00094 * cpm + (0.1346 * mass - 7.37418)).otherwise(_resting(mass)), _resting(mass)),
    "freedson_combination": lambda cpm, vm, vmcpm, mass, scale: F.greatest(F.when(cpm > 1951, scale * (0.00094 * cpm + (0.1346 * mass - 7.37418))).otherwise(_williams(cpm, mass)), F.lit(0.0)),
    "freedson_vm3": lambda cpm, vm, vmcpm, mass, scale: F.greatest(F.when(vmcpm > 2453, 0.001064 * vm + 0.087512 * mass - 5.500229).otherwise(F.lit(0.0)), F.lit(0.0)),
    "freedson_vm3_combination": lambda cpm, vm, vmcpm, mass, scale: F.greatest(F.when(vmcpm > 2453, 0.001064 * vm + 0.087512 * mass - 5.500229).otherwise(_williams(cpm, mass)), F.lit(0.0)),
}


def energy(algorithm: str, axis1: Column, vm: Column, mass: Column, epoch_seconds: float = 60) -> Column:
    """kcal a minute by name."""
    scale = 60.0 / epoch_seconds
    return ENERGY[algorithm](axis1 * scale, vm, vm * scale, mass, scale)


def energy_from_mets(mets_value: Column, mass: Column, epoch_seconds: float = 60) -> Column:
    """kcal of an epoch."""
    return mets_value * 3.5 * mass / 200 * (epoch_seconds / 60)


def circular_minutes(minutes: Column) -> Column:
    """An aggregate: the mean of minutes of the day on the circle, from 0 to 1440."""
    angle = minutes * (2 * 3.141592653589793 / 1440)
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * (1440 / (2 * 3.141592653589793))
    return F.when(mean < 0, mean + 1440).otherwise(mean)


def clock_12h(minutes: Column) -> Column:
    """H:MM AM or PM of minutes of the day."""
    whole = F.round(F.round(minutes, 6)).cast("int") % 1440  # means of whole minutes may lie at a half
    hour = F.floor(whole / 60).cast("int")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.format_string("%d:%02d %s", twelve, whole % 60, F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM")))


def device_datetime(ts: Column) -> Column:
    """Month and day without leading zeros, hours from 1 to 12."""
    return F.date_format(ts, "M/d/yyyy hh:mm:ss a")


def format_height(centimetres: Column) -> Column:
    """Feet and inches; N/A for null and 0."""
    inches = centimetres / 2.54
    text = F.format_string("%dft %din", F.floor(inches / 12), F.bround(inches % 12, 0).cast("long"))
    return F.when(F.coalesce(centimetres, F.lit(0.0)) != 0, text).otherwise(F.lit("N/A"))


def format_weight(kilograms: Column) -> Column:
    """Whole pounds; N/A for null and 0."""
    text = F.format_string("%dlbs", F.bround(kilograms * 2.20462, 0).cast("long"))
    return F.when(F.coalesce(kilograms, F.lit(0.0)) != 0, text).otherwise(F.lit("N/A"))


def format_sex(sex: Column) -> Column:
    """Male or Female of names, initials and the codes 1 and 2; N/A for nothing; else as it is."""
    low = F.lower(sex)
    known = F.when(low.isin("male", "m", "1"), F.lit("Male")).when(low.isin("female", "f", "2"), F.lit("Female"))
    return F.when(sex.isNull() | sex.isin("", "0"), F.lit("N/A")).otherwise(F.coalesce(known, sex))


def format_gender(sex: Column) -> Column:
    first = F.upper(F.substring(F.trim(sex), 1, 1))
    return F.when(first == "F", F.lit("Female")).when(first == "M", F.lit("Male")).otherwise(F.lit("Undefined"))


def format_duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, those above the first that isn't zero left out."""
    s = seconds.cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, s % 60))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60))
        .when(m > 0, F.format_string("%dm %ds", m, s % 60))
        .otherwise(F.format_string("%ds", s % 60))
    )


def ticks_to_timestamp(ticks: Column) -> Column:
    """Ticks of 100 ns since year 1."""
    return F.timestamp_micros(F.floor(ticks / 10).cast("long") - F.lit(62135596800000000))
