"""Masks of worlds and votes over them. A mask is a long whose bit j says whether world j holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.keyhash import WORLDS, Settings, signed


def drawn_bits(settings: Settings, what: Column, digits: int) -> Column:
    """Hex digits of the MD5 of seed, query and `what`, as a long: a retry gives the same, and any engine can tell it."""
    seed = f"{signed(settings.seed_used())}|{signed(settings.query_hash)}|"
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), what.cast("string")).cast("binary")), 1, digits), 16, 10).cast("long")


def _draw(settings: Settings, mask: Column, n: Column) -> Column:
    """A whole number under n: a function of seed, query and mask."""
    return F.pmod(drawn_bits(settings, mask, 15), n)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value in an expression, so that it isn't repeated."""
    return F.get(F.transform(F.array(value), body), 0)


def select(bools: Column) -> Column:
    """The mask of a boolean list: null elements don't hold, a null list gives null, elements after 64 don't count.

    The list stands in it once, outside of functions of elements, which would make it again for each of them.
    """
    bits = F.transform(F.slice(bools, 1, WORLDS), lambda x, j: F.when(F.coalesce(x, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def filter_mask(mask: Column, settings: Settings = Settings(), correction: Column | float = 1.0) -> Column:
    """The vote of a mask: half of the worlds without noise, else a drawn threshold."""
    c = F.coalesce(correction if isinstance(correction, Column) else F.lit(float(correction)), F.lit(1.0))
    held = F.bit_count(mask)
    if settings.mi <= 0:
        return held * c >= WORLDS // 2
    span = F.floor(F.lit(float(WORLDS)) / c).cast("long")
    return F.when(span <= 0, F.lit(True)).otherwise(held > _draw(settings, mask, F.greatest(span, F.lit(1).cast("long"))))


def filter_list(bools: Column, settings: Settings = Settings()) -> Column:
    """The vote of a boolean list; a null or empty list is false."""
    if settings.mi <= 0:  # no draw, so no mask: only how many hold counts
        return F.coalesce(F.size(F.filter(F.slice(bools, 1, WORLDS), lambda x: x)) >= WORLDS // 2, F.lit(False))
    return F.coalesce(F.when(F.size(bools) > 0, filter_mask(select(bools), settings)), F.lit(False))


COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda v, w: v > w,
    "gte": lambda v, w: v >= w,
    "lt": lambda v, w: v < w,
    "lte": lambda v, w: v <= w,
    "eq": lambda v, w: v == w,
    "neq": lambda v, w: v != w,
}


def filter_compare(name: str, value: Column, worlds: Column, settings: Settings = Settings(), correction: Column | float = 1.0) -> Column:
    """The vote of `value <comparison> world`; null worlds don't hold; a null value, null list or empty list is false."""
    compare = COMPARISONS[name]
    c = correction if isinstance(correction, Column) else F.lit(float(correction))

    def over(what: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
        return _let(worlds, lambda w: _let(value, lambda v: F.when(v.isNotNull() & (F.size(w) > 0), what(w, lambda x: compare(v, x)))))

    if settings.mi <= 0:  # no draw, so no mask: only how many hold counts
        held = over(lambda w, holds: F.size(F.filter(F.when(F.size(w) > WORLDS, F.slice(w, 1, WORLDS)).otherwise(w), holds)))
        return F.coalesce(held * F.coalesce(c, F.lit(1.0)) >= WORLDS // 2, F.lit(False))
    mask = over(lambda w, holds: select(F.transform(w, holds)))
    return F.coalesce(_let(F.struct(mask.alias("m"), c.alias("c")), lambda s: F.when(s["m"].isNotNull(), filter_mask(s["m"], settings, s["c"]))), F.lit(False))


def mask_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def mask_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def mask_not(a: Column) -> Column:
    return F.bitwise_not(a)


def coalesce_worlds(worlds: Column) -> Column:
    """A null list becomes a list of 64 nulls."""
    return F.coalesce(worlds, F.array_repeat(F.lit(None).cast("double"), WORLDS))
