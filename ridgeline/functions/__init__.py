"""Scalar helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRADS = 200  # in half a turn


def day_of_year(day: Column, year: Column) -> Column:
    """The date of a day of the year, counted from 1."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)


def radians_to_grads(c: Column) -> Column:
    return F.degrees(c) * GRADS / 180


def grads_to_radians(c: Column) -> Column:
    return F.radians(c * 180 / GRADS)


def quantisation(least: Column, most: Column, digits: int = 8) -> Column:
    """The power of ten by which heights become whole numbers of about ``digits`` digits."""
    return F.pow(F.lit(10.0), F.lit(digits) - F.length((most - least).cast("long").cast("string")))


def packed_colour(alpha: Column, red: Column, green: Column, blue: Column) -> Column:
    return F.shiftleft(alpha.cast("long"), 24).bitwiseOR(F.shiftleft(red.cast("long"), 16)).bitwiseOR(F.shiftleft(green.cast("long"), 8)).bitwiseOR(blue.cast("long"))


def colour_parts(c: Column) -> Column:
    part = lambda k: F.shiftright(c.cast("long"), k).bitwiseAND(255).cast("int")
    return F.struct(part(24).alias("alpha"), part(16).alias("red"), part(8).alias("green"), part(0).alias("blue"))
