"""Column functions: time, geometry, hydraulics, identities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
M_PER_DEGREE_LAT = 110_540.0
M_PER_DEGREE_LON = 111_320.0


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def slot(us: Column, seconds: int) -> Column:
    """Number of the slot of that length which holds the instant."""
    return F.floor(us / F.lit(seconds * 1_000_000)).cast("long")


def snap(us: Column, start_us: Column, end_us: Column, seconds: int) -> Column:
    """The instant floored to the ladder start + k * seconds and clamped to [start, end]."""
    step = F.lit(seconds * 1_000_000)
    floored = start_us + F.floor((us - start_us) / step).cast("long") * step
    return F.least(F.greatest(floored, start_us), end_us)


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north metres from a reference point, on the plane that fits there."""
    return (lon - lon0) * M_PER_DEGREE_LON * F.cos(F.radians(lat0)), (lat - lat0) * M_PER_DEGREE_LAT


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_octant(dx: Column, dy: Column) -> Column:
    """One of eight compass sectors, 0 for north, clockwise."""
    return F.pmod(F.floor((F.degrees(F.atan2(dx, dy)) + 22.5) / 45), F.lit(8)).cast("int")


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside the box or on its edge; false for missing coordinates."""
    return F.coalesce(x.between(box[0], box[2]) & y.between(box[1], box[3]), F.lit(False))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rain_rate(dbz: Column, a: Column | float = 200.0, b: Column | float = 1.6) -> Column:
    """mm/h from reflectivity by Z = a R^b."""
    return F.pow(F.pow(F.lit(10.0), dbz / 10) / a, 1 / F.lit(b) if not isinstance(b, Column) else 1 / b)


def reflectivity(rate: Column, a: float = 200.0, b: float = 1.6) -> Column:
    """dBZ from mm/h, the inverse of rain_rate; null where it doesn't rain."""
    return F.when(rate > 0, 10 * F.log10(F.lit(a) * F.pow(rate, F.lit(b))))


def to_dbr(rate: Column) -> Column:
    """10 log10 of the rate; below 0.1 mm/h or missing: -15."""
    return F.when(rate >= 0.1, 10 * F.log10(rate)).otherwise(F.lit(-15.0))


def from_dbr(dbr: Column) -> Column:
    """Rates from dBR: 0 below 0.1 mm/h, at most 400."""
    return F.when(dbr < 10 * F.log10(F.lit(0.1)), 0.0).otherwise(F.least(F.lit(400.0), F.pow(F.lit(10.0), dbr / 10)))


def slowdown(depth: Column, closed_at: Column | float, dry: float = 5.0, most: float = 3.0) -> Column:
    """Factor on travel time: 1 up to ``dry`` cm, rising to ``most`` at the depth that closes the road."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (depth - dry) / (F.lit(closed_at) - dry if not isinstance(closed_at, Column) else closed_at - dry)))
    return 1 + (most - 1) * share


def capacity_loss(beta: Column) -> Column:
    """Percent of a pipe's capacity that a blockage takes."""
    return (1 - F.pow(1 - beta, F.lit(5.0 / 3.0))) * 100


def manning_flow(area: Column, radius: Column, slope: Column, n: Column | float) -> Column:
    return area * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(slope) / n


def rational_peak(area_m2: Column, rain_mm_h: Column, runoff: Column | float = 1.0) -> Column:
    """m3/s off an area under steady rain."""
    return area_m2 * rain_mm_h * runoff / 3.6e6


def inlet_flow(depth: Column, length: Column, area: Column) -> Column:
    """What an inlet takes: the lesser of weir and orifice flow."""
    h = F.greatest(depth, F.lit(0.0))
    return F.least(1.66 * length * F.pow(h, F.lit(1.5)), 0.67 * area * F.sqrt(2 * 9.81 * h))


def orifice_flow(head: Column, area: Column | float, coefficient: float = 0.67) -> Column:
    """m3/s through an opening under a head; none without one."""
    return coefficient * area * F.sqrt(2 * 9.81 * F.greatest(head, F.lit(0.0)))


def pipe_flow(diameter: Column, slope: Column, n: float = 0.015) -> Column:
    """m3/s of a round pipe that runs full."""
    return manning_flow(math.pi / 4 * diameter * diameter, diameter / 4, slope, n)


def box_flow(width: Column, height: Column, slope: Column, n: float = 0.015) -> Column:
    """m3/s of a box drain that runs full, all four sides wetted."""
    return manning_flow(width * height, width * height / (2 * (width + height)), slope, n)


def beta_moments(a: Column, b: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of a Beta prior."""
    return a / (a + b), F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))


def tile_index(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web map tile that holds a point."""
    n = float(1 << zoom)
    rad = F.radians(lat)
    return F.floor((lon + 180) / 360 * n).cast("long"), F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n).cast("long")


def wind_vector(speed: Column, from_degrees: Column) -> tuple[Column, Column]:
    """East and north parts of a wind that comes from a bearing."""
    return -speed * F.sin(F.radians(from_degrees)), -speed * F.cos(F.radians(from_degrees))


def pedestrian_hazard(depth_cm: Column, speed: Column) -> Column:
    """Depth times speed of half a square metre per second or more; false where either is missing or there is no water."""
    return F.coalesce((depth_cm > 0) & (depth_cm / 100 * F.abs(speed) >= 0.5), F.lit(False))


def snap_up(value: Column, sizes: tuple[float, ...]) -> Column:
    """The least of the sizes that is not below the value; the largest beyond it."""
    out = F.lit(float(sizes[-1]))
    for s in reversed(sizes[:-1]):
        out = F.when(value <= s, float(s)).otherwise(out)
    return out


def unit_interval(text: Column) -> Column:
    """The text's place in [0, 1): the first 16 hex digits of its SHA-256 over 2^64."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def identity(*parts: Column) -> Column:
    """Parts joined by ``|``; a missing part is an empty one, so that places don't shift."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def masked_number(text: Column) -> Column:
    """All but the last four digits of a phone number as stars."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(digits) - 4)), F.right(digits, F.lit(4)))


def street_name(text: Column) -> Column:
    """The first of several names, single-spaced, cut at an opening bracket, slash or comma."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), "^[^;(/,]*", 0)
    return F.nullif(F.trim(F.regexp_replace(first, "\\s+", " ")), F.lit(""))


def fitted_text(text: Column, most: int = 160) -> Column:
    """Text of at most so many characters, cut at a word where it must be cut."""
    cut = F.regexp_replace(F.substring(text, 1, most - 3), "\\s+\\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def run_id_parts(run_id: Column) -> Column:
    """City, instant and mode of a run's name; null parts where the name isn't one."""
    pattern = r"^([A-Z]{3})-(\d{8}T\d{4}Z)-(.+)-([a-z]+)$"
    part = lambda i: F.nullif(F.regexp_extract(run_id, pattern, i), F.lit(""))
    return F.struct(part(1).alias("city"), part(2).alias("instant"), part(3).alias("versions"), part(4).alias("mode"))


def depth_band(depth: Column, edges: tuple[float, ...] = (5.0, 15.0, 30.0, 45.0, 60.0)) -> Column:
    """How many of the edges the depth has reached."""
    return sum((F.coalesce(depth >= e, F.lit(False)).cast("int") for e in edges), F.lit(0))
