"""Column functions over longitudes, latitudes, areas and scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEG = 111.32
EARTH_KM = 40075.0

# Area limits and widths of corridors, stretches of the main stem, reveal thresholds by zoom, town glow.
WIDTH_LOW, WIDTH_SPAN, WIDTH_LEAST_UP, WIDTH_MOST_UP = 0.5, 4.5, 10.0, 3e6
BORDER_LON, CONFLUENCE_LON, MAIN_STEM_MIN_UP = -69.95, -59.902, 700000.0
GLOW_POP0, GLOW_POP1, GLOW_S0, GLOW_R0, GLOW_FLOOR, GLOW_LEVELS = 2000.0, 2.2e6, 0.3, 6.5, 0.005, 100


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def round_half_up(x) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(col(x) + 0.5)


def quantise(x, digits: int) -> Column:
    return round_half_up(col(x) * float(10**digits)) / float(10**digits)


def scaled(x, factor: float) -> Column:
    """A whole number of 1/factor units, so that sums do not depend on their order."""
    return F.floor(col(x) * float(factor) + 0.5).cast("long")


def mercator_x(lon) -> Column:
    return (col(lon) + 180.0) / 360.0


def mercator_y(lat) -> Column:
    s = F.sin(F.radians(col(lat)))
    return F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * F.pi())


def mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * col(y)))))


def corridor_miles(up) -> Column:
    """Half-width of a corridor, log-linear in the upstream area."""
    t = (F.log10(F.greatest(col(up), F.lit(WIDTH_LEAST_UP))) - 1.0) / (F.log10(F.lit(WIDTH_MOST_UP)) - 1.0)
    return WIDTH_LOW + WIDTH_SPAN * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def stem_name(lon) -> Column:
    return F.when(col(lon) < BORDER_LON, "Río Amazonas").when(col(lon) < CONFLUENCE_LON, "Rio Solimões").otherwise("Rio Amazonas")


def reveal_zoom(up, thresholds: dict[int, float], default: int = 11, least: int = 3) -> Column:
    """The first zoom, from the smallest on, whose threshold the area reaches; one less, but at least `least`."""
    out = F.lit(default)
    for zoom in sorted(thresholds, reverse=True):
        out = F.when(col(up) >= thresholds[zoom], max(least, zoom - 1)).otherwise(out)
    return out


def glow_strength(pop) -> Column:
    t = F.log10(col(pop) / GLOW_POP0) / F.log10(F.lit(GLOW_POP1 / GLOW_POP0))
    return GLOW_S0 + (1 - GLOW_S0) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def glow_radius_km(pop) -> Column:
    return GLOW_R0 * F.cbrt(col(pop) / GLOW_POP0)


def km(x1, y1, x2, y2, at: str) -> Column:
    """Equirectangular distance; `at` names the latitude whose cosine scales longitude: start, end or mean."""
    lat = {"start": col(y1), "end": col(y2), "mean": (col(y1) + col(y2)) / 2}[at]
    return F.hypot((col(x2) - col(x1)) * F.cos(F.radians(lat)), col(y2) - col(y1)) * KM_PER_DEG


def segment_km(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point to a segment, longitudes scaled at the point's latitude."""
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    c = F.cos(F.radians(py))
    ax, ay, dx, dy = (x1 - px) * c, y1 - py, (x2 - x1) * c, y2 - y1
    ll = dx * dx + dy * dy
    t = F.when(ll > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / ll))).otherwise(0.0)
    ex, ey = ax + t * dx, ay + t * dy
    return F.sqrt(ex * ex + ey * ey) * KM_PER_DEG


def metres_per_pixel(lat, zoom) -> Column:
    return F.cos(F.radians(col(lat))) * (EARTH_KM * 1000) / (512 * F.pow(F.lit(2.0), col(zoom)))
