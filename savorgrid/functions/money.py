"""Price levels from the places vocabulary, from numbers and from euro amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price names and their level; anything else is moderate.
PRICE_LEVELS = {
    "PRICE_LEVEL_FREE": 0,
    "PRICE_LEVEL_INEXPENSIVE": 1,
    "PRICE_LEVEL_MODERATE": 2,
    "PRICE_LEVEL_EXPENSIVE": 3,
    "PRICE_LEVEL_VERY_EXPENSIVE": 4,
}
# Upper bound in euro, level, symbol, label.
PRICE_BANDS = [
    (15.0, 1, "$", "Cheap"),
    (30.0, 2, "$$", "Mid-range"),
    (60.0, 3, "$$$", "Upscale"),
    (None, 4, "$$$$", "Fine Dining"),
]


def price_number(level: Column) -> Column:
    """Accepts the names and plain numbers 0-4; unknown or missing is 2."""
    out = None
    for name, n in PRICE_LEVELS.items():
        cond = (level == name) | (level == str(n))
        out = F.when(cond, F.lit(n)) if out is None else out.when(cond, F.lit(n))
    return out.otherwise(F.lit(2))


def price_band(euro: Column) -> Column:
    """struct<level, symbol, label>; null without a price."""
    out = F.when(euro.isNull(), F.lit(None))
    for upper, level, symbol, label in PRICE_BANDS:
        value = F.struct(F.lit(level).alias("level"), F.lit(symbol).alias("symbol"), F.lit(label).alias("label"))
        out = out.otherwise(value) if upper is None else out.when(euro < upper, value)
    return out
