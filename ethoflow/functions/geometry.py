"""Body-frame geometry of landmarks, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WELL_DIAMETER_MM = 15.6
DEFAULT_FPS = 50.0


def midpoint(a: str, b: str, axis: str) -> Column:
    """Halfway between two parts, such as the frons between the eyes."""
    return (F.col(f"{a}_{axis}") + F.col(f"{b}_{axis}")) * 0.5


def centroid(parts: Iterable[str], axis: str) -> Column:
    """Mean position of parts, such as the centre-of-mass proxy of both eyes and the tail base."""
    parts = list(parts)
    total = F.col(f"{parts[0]}_{axis}")
    for p in parts[1:]:
        total = total + F.col(f"{p}_{axis}")
    return total / float(len(parts))


def with_body_axis(df: DataFrame) -> DataFrame:
    """Adds frons_x/y, com_x/y and yaw (the direction from tail base to frons)."""
    df = df.withColumns({f"frons_{x}": midpoint("left_eye", "right_eye", x) for x in "xy"} | {f"com_{x}": centroid(("left_eye", "right_eye", "tail_base"), x) for x in "xy"})
    return df.withColumn("yaw", F.atan2(F.col("frons_y") - F.col("tail_base_y"), F.col("frons_x") - F.col("tail_base_x")))


def to_body_frame(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """(thrust, slip): a step along the body axis and across it, by the yaw at the step's end."""
    return dx * F.cos(-yaw) - dy * F.sin(-yaw), dx * F.sin(-yaw) + dy * F.cos(-yaw)


def aligned(df: DataFrame, parts: Iterable[str], origin: str = "frons", axis: str = "tail_base", suffix: str = "_aligned") -> DataFrame:
    """Adds each part's position with the origin at (0, 0) and the axis part on +x; scale stays."""
    turn = F.atan2(F.col(f"{axis}_y") - F.col(f"{origin}_y"), F.col(f"{axis}_x") - F.col(f"{origin}_x"))
    df = df.withColumn("__turn", -turn)
    new = {}
    for p in parts:
        x, y = F.col(f"{p}_x") - F.col(f"{origin}_x"), F.col(f"{p}_y") - F.col(f"{origin}_y")
        new[f"{p}{suffix}_x"] = x * F.cos("__turn") - y * F.sin("__turn")
        new[f"{p}{suffix}_y"] = x * F.sin("__turn") + y * F.cos("__turn")
    return df.withColumns(new).drop("__turn")


def per_second(value: Column, mm: float, px: Column | float, fps: Column | float = DEFAULT_FPS) -> Column:
    """Pixels a frame to millimetres a second."""
    return value * (F.lit(mm) / F.lit(px) if not isinstance(px, Column) else F.lit(mm) / px) * fps


def speed(x: str = "thrust_mm_s", y: str = "slip_mm_s") -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))


def speed_with_turn(x: str = "thrust_mm_s", y: str = "slip_mm_s", yaw: str = "yaw_rad_s") -> Column:
    """Length of the three-component velocity; mixes units, as the older analyses did."""
    return F.sqrt(F.pow(F.col(x), 2) + F.pow(F.col(y), 2) + F.pow(F.col(yaw), 2))


def wrapped(step: Column) -> Column:
    """An angle difference in (-pi, pi]: what unwrapping adds between two frames."""
    pi = F.pi()
    turned = F.pmod(step + pi, 2 * pi) - pi
    return F.when((turned == -pi) & (step > 0), pi).otherwise(turned)
