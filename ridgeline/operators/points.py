"""Point clouds: bit fields, coordinates, classes, search within a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the LAS specification, versions 1.1 to 1.3
CLASS_NAMES = (
    "Created, never classified", "Unclassified", "Ground", "Low Vegetation", "Medium Vegetation", "High Vegetation", "Building",
    "Low Point (noise)", "Model Key-point (mass point)", "Water", "Reserved for ASPRS Definition", "Reserved for ASPRS Definition", "Overlap Points",
)


def bit(c: Column, k: int) -> Column:
    return F.shiftright(c, k).bitwiseAND(1) == 1


def return_fields(flags: Column) -> dict[str, Column]:
    return {
        "return_number": flags.bitwiseAND(7), "number_of_returns": F.shiftright(flags, 3).bitwiseAND(7),
        "scan_direction": bit(flags, 6), "edge_of_flightline": bit(flags, 7),
    }


def class_fields(byte: Column, class_bits: int = 4) -> dict[str, Column]:
    value = byte.bitwiseAND((1 << class_bits) - 1)
    names = F.create_map(*[x for k, n in enumerate(CLASS_NAMES) for x in (F.lit(k), F.lit(n))])
    first = 4 if class_bits == 4 else 5
    return {
        "class_value": value, "class_name": F.coalesce(F.try_element_at(names, value), F.lit("Undefined class value")),
        "synthetic": bit(byte, first), "key_point": bit(byte, 5 if first == 4 else 6), "withheld": bit(byte, 6 if first == 4 else 7),
    }


def scaled(raw: Column, scale: float, offset: float) -> Column:
    return raw * F.lit(scale) + F.lit(offset)


def within_radius(points: DataFrame, queries: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of a query and a point closer than ``radius``: points fall into square buckets of that size and each query looks at nine."""
    if radius <= 0:
        return queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns]).crossJoin(points).limit(0)
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    q = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn("_n", near)
    q = q.withColumns({"_i": cell(f"q_{x}") + F.col("_n.i"), "_j": cell(f"q_{y}") + F.col("_n.j")}).drop("_n")
    p = points.withColumns({"_i": cell(x), "_j": cell(y)})
    dx, dy = F.col(x) - F.col(f"q_{x}"), F.col(y) - F.col(f"q_{y}")
    return q.join(p, ["_i", "_j"]).filter(dx * dx + dy * dy < radius * radius).drop("_i", "_j")
