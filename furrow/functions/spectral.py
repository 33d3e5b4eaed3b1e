"""Colour and vegetation arithmetic as Column expressions; r, g, b and masks are integers 0 to 255.

A black pixel has no chromatic coordinates: its index is null, and byte 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjust_gamma(v: Column, gamma: float) -> Column:
    """The level after gamma correction, cut to a whole level."""
    return F.floor(F.pow(v / F.lit(255.0), F.lit(1.0 / gamma)) * 255).cast("int")


def chromatic(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Shares of the three bands; null for a black pixel."""
    total = (r + g + b).cast("double")
    return tuple(F.when(total > 0, c / total) for c in (r, g, b))


def _exg(r, g, b):
    return 2 * g - r - b


def _exr(r, g, b):
    return 1.4 * r - g


def _cive(r, g, b):
    return 0.441 * r - 0.811 * g + 0.385 * b + 18.78745


INDICES = {"exg": _exg, "exr": _exr, "cive": _cive, "exgr": lambda r, g, b: _exg(r, g, b) - _exr(r, g, b)}


def veg_index(name: str, r: Column, g: Column, b: Column, order: str = "rgb") -> Column:
    """A vegetation index: exg, exr, cive, exgr, ndi, or the raw ndvi; order `grb` reads the bands as (g, r, b)."""
    if order == "grb":
        r, g = g, r
    if name in INDICES:
        return INDICES[name](*chromatic(r, g, b))
    if name == "ndi":
        total = (g + r).cast("double")
        return F.when(total > 0, (g - r) / total)
    if name == "ndvi":
        total = (r + b).cast("double")
        return (r - b) / F.when(total == 0, F.lit(0.01)).otherwise(total)
    raise ValueError(f"no index {name}")


def to_byte(v: Column) -> Column:
    """The index times 255 as a byte: cut toward zero, wrapped modulo 256; null and NaN are 0."""
    return F.coalesce(F.pmod(F.nanvl(v, F.lit(0.0)).cast("double").__mul__(255).cast("int"), F.lit(256)), F.lit(0)).cast("int")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees [0, 180), saturation and value 0 to 255, rounded."""
    high, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = high - low
    safe = F.when(span > 0, span).otherwise(F.lit(1.0))
    degrees = F.when(span == 0, F.lit(0.0)).when(high == r, 60 * (g - b) / safe).when(high == g, 120 + 60 * (b - r) / safe).otherwise(240 + 60 * (r - g) / safe)
    hue = F.floor(F.when(degrees < 0, degrees + 360).otherwise(degrees) / 2 + 0.5)
    saturation = F.floor(255 * span / F.when(high > 0, high).otherwise(F.lit(1.0)) + 0.5)
    return F.when(hue >= 180, 0).otherwise(hue).cast("int"), saturation.cast("int"), high.cast("int")


def green_mask(r: Column, g: Column, b: Column, sensitivity: int = 15) -> Column:
    """1 where the hue is within sensitivity of the greens 60 to 80 and the pixel is neither pale nor dark."""
    h, s, v = hsv(r, g, b)
    return F.when(h.between(60 - sensitivity, 80 + sensitivity) & s.between(30, 255) & v.between(30, 255), 1).otherwise(0)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def relight(r: Column, g: Column, b: Column, y_old: Column, y_new: Column) -> tuple[Column, Column, Column]:
    """The pixel with a new luminance and its old colour differences."""
    return tuple(F.least(F.lit(255), F.greatest(F.lit(0), c + y_new - y_old)).cast("int") for c in (r, g, b))


def combine_masks(a: Column, b: Column) -> Column:
    """The saturating sum."""
    return F.least(a + b, F.lit(255))


def mask_rgb(mask: Column, v: Column) -> Column:
    return F.least(mask, v)


def apply_mask(mask: Column, v: Column) -> Column:
    return F.when(mask > 0, v).otherwise(0)
