"""Text templates with named slots, filled by columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F


def fill(template: str, **slots: Column) -> Column:
    """``template`` with each ``{slot}`` replaced; NULL if any used slot is NULL."""
    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if slot is not None:
            parts.append(slots[slot].cast("string"))
    return F.concat(*parts)
