"""Panel geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Margin, and the panel's size where none is given.
MARGIN, WIDTH, HEIGHT = 20.0, 320.0, 220.0


def clamp(value: Column, low: Column, high: Column) -> Column:
    """The upper bound wins if the bounds cross."""
    return F.least(F.greatest(value, low), high)


def bound(viewport: Column, size: Column, default: float) -> Column:
    return F.greatest(F.lit(MARGIN), viewport - F.coalesce(size, F.lit(default)) - F.lit(MARGIN))


def sanitize_position(left: Column, top: Column, width: Column, height: Column, panel_w: Column | None = None, panel_h: Column | None = None) -> Column:
    """A struct of left and top inside the viewport; null unless both are numbers from 0 to the viewport less the
    margin."""
    none = F.lit(None).cast("double")
    inside = (left >= 0) & (top >= 0) & (left <= width - MARGIN) & (top <= height - MARGIN)
    return F.when(
        inside,
        F.struct(
            clamp(left, F.lit(MARGIN), bound(width, none if panel_w is None else panel_w, WIDTH)).alias("left"),
            clamp(top, F.lit(MARGIN), bound(height, none if panel_h is None else panel_h, HEIGHT)).alias("top"),
        ),
    )


def dragged(start: Column, pointer: Column, now: Column) -> Column:
    return start + (now - pointer)
