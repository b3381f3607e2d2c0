"""Range and range rate of pixels for every kind of image grid, and terrain.

The metadata of one image are a few numbers: they enter the plan as literals, and the
kind of grid is chosen while the plan is made.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.poly import derivative, polyval, polyval2d
from ..functions.vectors import Vec
from .geometry import _kept, _vec, bilinear, to_height, with_geodetic

Numbers = list[float]


def _array(values: Numbers) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _matrix(rows: list[Numbers]) -> Column:
    return F.array(*map(_array, rows))


def _vector(v: tuple[float, float, float]) -> Vec:
    return Vec(*[F.lit(float(x)) for x in v])


@dataclass(frozen=True)
class Grid:
    """Metadata of an image: polynomials are ascending, vectors (x, y, z) in metres.

    kind: RGAZIM (with algorithm PFA or RGAZCOMP), RGZERO, XRGYCR, XCTYAT or PLANE. What a
    kind doesn't use may be left out; if it lacks what it needs it counts as PLANE.
    """

    kind: str
    scp: tuple[float, float, float]
    arp: tuple[Numbers, Numbers, Numbers]  # position polynomials over time
    coa_time: list[Numbers]  # over (row, column) metres
    row_spacing: float
    col_spacing: float
    scp_row: float = 0.0
    scp_col: float = 0.0
    first_row: float = 0.0
    first_col: float = 0.0
    row: tuple[float, float, float] = (1.0, 0.0, 0.0)
    col: tuple[float, float, float] = (0.0, 1.0, 0.0)
    algorithm: str = ""
    polar_angle: Numbers = field(default_factory=list)
    frequency_scale: Numbers = field(default_factory=list)
    azimuth_scale: float | None = None
    approach_time: Numbers = field(default_factory=list)
    approach_range: float | None = None
    doppler_rate_scale: list[Numbers] = field(default_factory=list)

    @property
    def usable(self) -> str:
        if self.kind == "RGAZIM" and self.algorithm == "PFA" and self.polar_angle and self.frequency_scale:
            return "PFA"
        if self.kind == "RGAZIM" and self.algorithm == "RGAZCOMP" and self.azimuth_scale is not None:
            return "RGAZCOMP"
        if self.kind == "RGZERO" and self.approach_time and self.approach_range is not None and self.doppler_rate_scale:
            return "RGZERO"
        return "PLANE"


def with_contours(px: DataFrame, grid: Grid) -> DataFrame:
    """Adds range, rate, arp_*, vel_* of pixels (r, c), counted from 0."""
    c = F.col
    own = px.withColumns({"_x": (c("r") + (grid.first_row - grid.scp_row)) * grid.row_spacing, "_y": (c("c") + (grid.first_col - grid.scp_col)) * grid.col_spacing})
    own = own.withColumn("_t", polyval2d(_matrix(grid.coa_time), c("_x"), c("_y")))
    own = own.withColumns({f"arp_{a}": polyval(_array(p), c("_t")) for a, p in zip("xyz", grid.arp, strict=True)})
    own = own.withColumns({f"vel_{a}": polyval(derivative(_array(p)), c("_t")) for a, p in zip("xyz", grid.arp, strict=True)})
    scp, arp, velocity = _vector(grid.scp), _vec("arp"), _vec("vel")
    kind = grid.usable
    if kind == "PLANE":
        own = _kept(own, "_back", arp - (scp + _vector(grid.row) * c("_x") + _vector(grid.col) * c("_y")))
        own = own.withColumn("range", _vec("_back").norm()).withColumn("rate", velocity.dot(_vec("_back")) / c("range"))
        return own.drop("_x", "_y", "_t", "_back_x", "_back_y", "_back_z")
    if kind == "RGZERO":
        own = own.withColumn("_tca", polyval(_array(grid.approach_time), c("_y")))
        speed = Vec(*[polyval(derivative(_array(p)), c("_tca")) for p in grid.arp])
        own = own.withColumn("_v2", speed.dot(speed)).withColumn("_d", polyval2d(_matrix(grid.doppler_rate_scale), c("_x"), c("_y"))).withColumn("_dt", c("_t") - c("_tca"))
        closest = c("_x") + grid.approach_range
        own = own.withColumn("range", F.sqrt(closest * closest + c("_d") * c("_v2") * c("_dt") * c("_dt")))
        own = own.withColumn("rate", c("_d") / c("range") * c("_v2") * c("_dt"))
        return own.drop("_x", "_y", "_t", "_tca", "_v2", "_d", "_dt")
    own = own.withColumn("_r0", (arp - scp).norm()).withColumn("_v0", velocity.dot(arp - scp) / c("_r0"))
    if kind == "PFA":
        angle, scale = _array(grid.polar_angle), _array(grid.frequency_scale)
        own = own.withColumns({"_a": polyval(angle, c("_t")), "_da": polyval(derivative(angle), c("_t"))})
        own = own.withColumns({"_k": polyval(scale, c("_a")), "_dk": polyval(derivative(scale), c("_a"))})
        along, across = c("_x") * F.cos("_a") + c("_y") * F.sin("_a"), c("_y") * F.cos("_a") - c("_x") * F.sin("_a")
        own = own.withColumns({"range": c("_r0") + c("_k") * along, "rate": c("_v0") + (c("_dk") * along + c("_k") * across) * c("_da")})
        return own.drop("_x", "_y", "_t", "_r0", "_v0", "_a", "_da", "_k", "_dk")
    own = own.withColumns({"range": c("_r0") + c("_x"), "rate": c("_v0") - velocity.norm() * grid.azimuth_scale * c("_y")})
    return own.drop("_x", "_y", "_t", "_r0", "_v0")


#: Steps of a contour that come from one row.
PART = 4096


def to_terrain(px: DataFrame, grid: Grid, dem: DataFrame, step: float, low: float, high: float, spacing: float = 10.0) -> DataFrame:
    """Adds lat, lon, height of the lowest place where each pixel's contour meets terrain.

    px needs a key of (r, c). The contour between the heights ``low`` and ``high`` is a
    row for each step along it; the steps meet the elevation grid in equi-joins, and
    the first change of sign is interpolated. Each pixel converges by itself.
    """
    own = with_contours(px.select("r", "c"), grid)
    scp = _vector(grid.scp)
    bottom = to_height(own, scp, low).select("r", "c", F.col("out_x").alias("b_x"), F.col("out_y").alias("b_y"), F.col("out_z").alias("b_z"))
    top = to_height(own, scp, high).select("r", "c", F.col("out_x").alias("t_x"), F.col("out_y").alias("t_y"), F.col("out_z").alias("t_z"))
    own = own.join(bottom, ["r", "c"]).join(top, ["r", "c"])
    arp, velocity = _vec("arp"), _vec("vel")
    own = own.withColumn("_speed", velocity.norm())
    own = _kept(own, "_uv", velocity * (1 / F.col("_speed")))
    own = own.withColumn("_cos", -F.col("rate") / F.col("_speed"))
    own = _kept(own, "_ctr", arp + _vec("_uv") * (F.col("range") * F.col("_cos")))
    own = own.withColumn("_rad", F.col("range") * F.sqrt(1 - F.col("_cos") * F.col("_cos")))
    own = _kept(own, "_uy", arp.cross(_vec("_uv")).unit())
    own = _kept(own, "_ux", _vec("_uy").cross(_vec("_uv")))
    for name in ("b", "t"):
        rel = _vec(name) - _vec("_ctr")
        own = own.withColumn(f"_ang_{name}", F.atan2(rel.dot(_vec("_uy")), rel.dot(_vec("_ux"))))
    steps = F.greatest(F.lit(2), F.ceil(F.abs(F.col("_ang_t") - F.col("_ang_b")) * F.col("_rad") / spacing)).cast("long")
    # A long contour is many rows, dealt out in parts: first a row for each part, then one for each step.
    own = own.withColumn("_n", steps).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / PART))))
    own = own.withColumn("_step", F.explode(F.sequence(F.col("_part") * PART, F.least(F.col("_n"), F.col("_part") * PART + PART - 1)))).drop("_part")
    angle = F.col("_ang_b") + (F.col("_ang_t") - F.col("_ang_b")) * F.col("_step") / F.col("_n")
    own = own.withColumn("_angle", angle)
    own = _kept(own, "p", _vec("_ctr") + _vec("_ux") * (F.col("_rad") * F.cos("_angle")) + _vec("_uy") * (F.col("_rad") * F.sin("_angle")))
    places = with_geodetic(own.select("r", "c", "_step", "p_x", "p_y", "p_z"), "p").select("r", "c", "_step", "lat", "lon", "height")
    met = bilinear(places, dem, step).withColumn("_over", F.col("height") - F.col("elev"))
    from pyspark.sql import Window

    order = Window.partitionBy("r", "c").orderBy("_step")
    nxt = {x: F.lead(x).over(order).alias(f"{x}_next") for x in ("lat", "lon", "height", "_over")}
    pairs = met.select("r", "c", "_step", "lat", "lon", "height", "_over", *nxt.values())
    crosses = pairs.where(F.col("_over") * F.col("_over_next") <= 0)
    share = F.when(F.col("_over") == F.col("_over_next"), 0.0).otherwise(F.col("_over") / (F.col("_over") - F.col("_over_next")))
    value = F.struct("_step", *[(F.col(x) + share * (F.col(f"{x}_next") - F.col(x))).alias(x) for x in ("lat", "lon", "height")])
    found = crosses.groupBy("r", "c").agg(F.min_by(value, "_step").alias("v"))
    return px.join(found.select("r", "c", "v.lat", "v.lon", "v.height"), ["r", "c"], "left")
