"""From a list of worlds to the one value that is released.

Noise and the choice of world are pure functions of seed, query hash and the group's mask of worlds: a recomputed task
releases the same value again, never a second draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.keyhash import WORLDS, Settings
from veilspark.functions.votes import _draw, _let, drawn_bits, select


def world_mask(worlds: Column) -> Column:
    return select(F.transform(worlds, lambda w: w.isNotNull()))


def _uniform(settings: Settings, mask: Column, draw: int) -> Column:
    """52 bits in (0, 1]."""
    return (drawn_bits(settings, F.concat(mask.cast("string"), F.lit(f"|{draw}")), 13).cast("double") + 1.0) / float(1 << 52)


def _normal(settings: Settings, mask: Column) -> Column:
    return F.sqrt(-2.0 * F.log(_uniform(settings, mask, 1))) * F.cos(2 * math.pi * _uniform(settings, mask, 2))


def _variance(values: Column) -> Column:
    """Sample variance of a list without nulls; 0 for fewer than two."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    squares = _let(mean, lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.when(n > 1, squares / (n - 1)).otherwise(F.lit(0.0))


def _released(kept: Column, mask: Column, settings: Settings) -> Column:
    """One of the values, with noise if the information bound asks for it."""
    if settings.mi < 0:
        raise ValueError("mi must not be negative")
    if settings.mi == 0:
        return F.get(kept, 0)
    n = F.size(kept)
    at = F.pmod(F.lit(str(settings.query_hash)).cast("decimal(20,0)"), n.cast("decimal(20,0)")).cast("int")
    delta = _variance(kept) / (2 * settings.mi)
    noise = _let(delta, lambda d: F.when((d > 0) & ~F.isnan(d) & (d < F.lit(float("inf"))), F.sqrt(d) * _normal(settings, mask)).otherwise(F.lit(0.0)))
    return F.get(kept, at) + noise


def is_withheld(mask: Column, settings: Settings, correction: float = 1.0) -> Column:
    """Whether a group's value is null for want of worlds."""
    held = F.bit_count(mask)
    if settings.mi <= 0:
        return held * correction < 1
    span = max(1, math.floor(WORLDS * correction))
    return F.lit(WORLDS) - held > _draw(settings, mask, F.lit(span).cast("long"))


def sampled(worlds: Column, settings: Settings = Settings(), correction: float = 1.0, scale: float = 1.0, corrected: bool = True) -> Column:
    """The released value of 64 worlds: null worlds are dropped, the rest multiplied by the correction (if `corrected`)."""
    factor = correction if corrected else 1.0
    if settings.mi == 0:  # no draw, so no mask: the first world, if there are enough
        kept = F.filter(worlds, lambda x: x.isNotNull())
        return F.when(F.size(kept) * F.lit(float(correction)) >= 1, F.get(kept, 0).cast("double") * F.lit(float(factor * scale)))

    def finish(s: Column) -> Column:
        kept = F.transform(F.filter(s["w"], lambda x: x.isNotNull()), lambda x: x.cast("double") * F.lit(float(factor)))
        return F.when(~is_withheld(s["m"], settings, correction) & (F.size(kept) > 0), _released(kept, s["m"], settings) * F.lit(float(scale)))

    return F.when(worlds.isNotNull(), _let(F.struct(worlds.alias("w"), world_mask(worlds).alias("m")), finish))


def noised(worlds: Column, settings: Settings = Settings()) -> Column:
    """One noised value of a list of 64 worlds, not scaled; null unless the list has 64 elements, not all null."""
    return F.when((F.size(worlds) == WORLDS) & F.exists(worlds, lambda x: x.isNotNull()), sampled(worlds, settings))


def aggregate_samples(values: Column, counts: Column, mi: float, least: int, settings: Settings = Settings()) -> Column:
    """A value per sample: null for an empty list, a null value or when no count reaches `least`; lengths must agree."""
    if mi < 0:
        raise ValueError("mi must not be negative")
    s = Settings(mi, settings.seed, settings.query_number)
    x = F.transform(values, lambda v: v.cast("double"))
    checked = F.when(F.size(values) != F.size(counts), F.raise_error(F.lit("values and counts must have the same length")).cast("double"))
    null = (F.size(values) == 0) | F.exists(values, lambda v: v.isNull()) | (F.array_max(counts) < least)
    # what the draw depends on: the values, to six places where they have a decimal form
    mask = F.array_join(F.transform(x, lambda v: F.coalesce(v.try_cast("decimal(38,6)").cast("string"), v.cast("string"))), ",")
    return checked.when(F.coalesce(null, F.lit(True)), F.lit(None).cast("double")).otherwise(_released(x, mask, s))
