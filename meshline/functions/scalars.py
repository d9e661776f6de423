"""Scalar functions: hashes, rounding, projections, colours, text and direction arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PI = 3.141592653589793


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half up (towards plus infinity): floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def djb2(text: Column) -> Column:
    """h = h * 33 + code, modulo 2^32, from 5381, as 8 hex digits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def strict_color(c: Column) -> Column:
    """A three- or six-digit hex colour, else grey."""
    return F.when(c.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), c).otherwise(F.lit("#888888"))


def prefixed_color(c: Column) -> Column:
    return F.when(c.startswith("#"), c).otherwise(F.concat(F.lit("#"), c))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def xml_unescape(s: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def text_width(s: Column) -> Column:
    return F.char_length(s) * 6


def octilinear_distance(dx: Column, dy: Column) -> Column:
    """Length of the shortest path of horizontal, vertical and diagonal moves."""
    a, b = F.abs(dx), F.abs(dy)
    return F.lit(1.4142135623730951) * F.least(a, b) + F.abs(a - b)


def nearest_direction(dx: Column, dy: Column) -> Column:
    """Number (0 east, counting by 45 degrees) of the unit direction with the largest dot product; the first of equals."""
    d = 0.7071067811865476
    units = [(1.0, 0.0), (d, d), (0.0, 1.0), (-d, d), (-1.0, 0.0), (-d, -d), (0.0, -1.0), (d, -d)]
    dots = [F.struct((dx * F.lit(a) + dy * F.lit(b)).alias("dot"), F.lit(-i).alias("i")) for i, (a, b) in enumerate(units)]
    return -F.greatest(*dots)["i"]


def turn_steps(a: Column, b: Column) -> Column:
    """Steps of 45 degrees between two directions, 0 to 4."""
    d = F.abs(a - b)
    return F.least(d, F.lit(8) - d)


#: Weights of bends by steps between a node's two ports (4: straight on), and what keeps a sharp turn from
#: being cheaper as several gentle ones.
BENDS, NO_SHORTCUT = (float("inf"), 0.95, 0.6, 0.05, 0.0), 0.95 - 0.05


def bend_weight(steps: Column) -> Column:
    """Cost of a bend by ``turn_steps`` of its ports; ports of one direction can't be joined."""
    return F.get(F.array(*[F.lit(b + NO_SHORTCUT) for b in BENDS]), F.least(steps, F.lit(len(BENDS) - 1)).cast("int"))


def off_grid_degrees(dx: Column, dy: Column) -> Column:
    """Angle from the nearest multiple of 45 degrees, quantised to a millionth of a degree."""
    deg = F.floor(F.degrees(F.atan2(dy, dx)) * 1e6 + 0.5) / 1e6
    m = F.pmod(deg, F.lit(45.0))
    return F.least(m, F.lit(45.0) - m)


def cardinal(vx: Column, vy: Column) -> Column:
    """E, S, W or N (y down) by the largest component; east first of equals."""
    most = F.greatest(vx, vy, -vx, -vy)
    return F.when(vx == most, "E").when(vy == most, "S").when(-vx == most, "W").otherwise("N")


def smoothstep(w: Column) -> Column:
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))
    return w * w * (F.lit(3.0) - w * 2.0)


#: Property values that mean greenery.
GREEN = (
    "park", "grass", "grassland", "forest", "wood", "woodland", "meadow", "scrub", "heath", "fell", "moor", "garden",
    "recreation_ground", "cemetery", "grave_yard", "nature_reserve", "protected_area", "national_park", "conservation",
    "farmland", "farmyard", "orchard", "vineyard", "allotments", "village_green", "common", "golf_course", "pitch",
    "playground", "dog_park", "wetland", "marsh", "greenfield", "plant_nursery",
)


def feature_category(layer: Column, properties: Column) -> Column:
    """Water and green by dedicated layers, else green by the first property that is set, else null."""
    first = F.coalesce(*[F.try_element_at(properties, F.lit(k)) for k in ("class", "kind", "pmap:kind", "subclass", "type")])
    return (
        F.when(layer.isin("water", "ocean_foundations"), "water").when(layer.isin("park", "parks"), "green")
        .when(F.lower(first).isin(*GREEN), "green")
    )


def fit_projection(lng: Column, lat: Column, b: Column, width: float, height: float, pad: float = 0.06) -> tuple[Column, Column]:
    """Equirectangular fit of a bounding box struct (x0, y0, x1, y1) into a padded viewport, y downwards."""
    mid = (b["y0"] + b["y1"]) / 2.0
    k = F.floor(F.cos(mid * F.lit(PI / 180.0)) * 1e9 + 0.5) / 1e9
    w, h = F.greatest((b["x1"] - b["x0"]) * k, F.lit(1e-9)), F.greatest(b["y1"] - b["y0"], F.lit(1e-9))
    s = F.least(F.lit(width * (1 - 2 * pad)) / w, F.lit(height * (1 - 2 * pad)) / h)
    x = F.lit(width / 2) + (lng - (b["x0"] + b["x1"]) / 2.0) * k * s
    y = F.lit(height / 2) - (lat - mid) * s
    return x, y


def lifecycle(queued: Column, before: Column, now: Column, snapshot: Column) -> Column:
    """What happens to the detail areas on a repaint: restore, keep or clear.

    A queued restore wins; the first paint or an unchanged key keeps; a smoothed map (key ``s:``) that is returned to
    from another mode (``m:``) gets its snapshot back, if there is one; any other change clears.
    """
    back = now.startswith("s:") & before.startswith("m:") & snapshot
    return F.when(queued, "restore").when(before.isNull() | (before == now), "keep").when(back, "restore").otherwise("clear")


def metres(lng: Column, lat: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres around ``lat0``; the cosine is quantised to 9 digits."""
    cos = F.floor(F.cos(lat0 * F.lit(PI) / 180) * 1e9 + 0.5) / 1e9
    return F.lit(6371000.0) * lng * F.lit(PI) * cos / 180, F.lit(6371000.0) * lat * F.lit(PI) / 180


def corner_place(i: Column, n: Column, low: Column, high: Column) -> Column:
    """Coordinate of grid corner ``i`` of ``n`` cells between ``low`` and ``high``."""
    return low + i / n * (high - low)


def boxes_alike(a: list[Column], b: list[Column]) -> Column:
    """Whether the four sides of two boxes are the same up to a millionth."""
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & (F.abs(p - q) <= 1e-6)
    return out


#: Fixed values in the functions below: steps and weights of corners, and the scales of slider positions.
def corner_factor(dot: Column) -> Column:
    """Weight of a crossing by the cosine of its turn, in steps."""
    return F.when(dot < -0.92, 6.0).when(dot < -0.38, 0.5).otherwise(0.15)


def angle_factor(dot: Column, most: float = 6.0) -> Column:
    """Weight of a crossing by the cosine of its turn: least at a right angle, ``most`` at either end."""
    return F.lit(0.15) + F.lit(most - 0.15) * dot * dot


def circular_distance(a: Column, b: Column, n: Column) -> Column:
    return F.pmod(b - a, n)


def move_penalty(distance: Column, cell: float, per_grid: float) -> Column:
    return distance / F.lit(cell) * F.lit(per_grid)


def heuristic(dx: Column, dy: Column, x_cost: float, y_cost: float, diagonal_saving: float, bend: float, hop: float) -> Column:
    """Least cost of a path over an octilinear grid: straight and diagonal moves, one bend where both are needed."""
    x, y = F.abs(dx), F.abs(dy)
    cost = x * F.lit(x_cost) + y * F.lit(y_cost) + F.least(x, y) * F.lit(diagonal_saving)
    cost = cost + F.when((x != y) & (x != 0) & (y != 0), F.lit(bend)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), cost - F.lit(hop))


def slider_values(p: Column) -> dict[str, Column]:
    """Parameters for a slider position from -1 to 1."""
    return {
        "warp_alpha": F.greatest(F.lit(0.0), (p + 1) * 0.8),
        "affinity": F.when(p <= 0, F.lit(0.05) - p * 0.1).otherwise((F.lit(1.0) - p) * 0.05),
        "box_expand": F.greatest(F.lit(1.0), F.pow(F.lit(6.0), p) * 6),
        "box_growth": F.greatest(F.lit(1.0), F.pow(F.lit(3.0), p) * 1.5),
    }


def attributes(element: Column) -> Column:
    """Map of a tag's attributes, in either kind of quotes and with any white space around ``=``; the last of equal names counts."""
    pattern = F.lit("([^\\s=/>\"'<]+)\\s*=\\s*(\"[^\"]*\"|'[^']*')")
    named = F.zip_with(F.regexp_extract_all(element, pattern, F.lit(1)), F.regexp_extract_all(element, pattern, F.lit(2)), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    split = F.transform(named, lambda a: F.struct(a["k"].alias("k"), F.substring(a["v"], F.lit(2), F.length(a["v"]) - 2).alias("v")))
    last = F.filter(split, lambda x, i: ~F.exists(F.slice(split, i + 2, F.size(split)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def translation(transform: Column) -> Column:
    """The two numbers of ``translate(x y)``, of any length and with exponents; zeros without one, y is 0 where it is left out."""
    digits = "[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?"
    pattern = f"translate\\s*\\(\\s*({digits})(?:[\\s,]+({digits}))?\\s*\\)"
    number = lambda g: F.coalesce(F.regexp_extract(transform, pattern, g).try_cast("double"), F.lit(0.0))
    return F.array(number(1), number(2))


def map_json(m: Column, tag: str = "map") -> Column:
    """A map as JSON text that keeps its entries' order: a list of pairs under ``tag``."""
    pairs = F.transform(F.map_entries(m), lambda e: F.array(e["key"], e["value"]))
    return F.to_json(F.named_struct(F.lit(tag), pairs))


def json_map(text: Column, tag: str = "map") -> Column:
    pairs = F.from_json(text, f"`{tag}` array<array<string>>")[tag]
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0], p[1])))


def vertex_key(x: Column, y: Column) -> Column:
    """Text of a point quantised to eighths of a pixel."""
    eighth = lambda c: F.floor(c * 8 + 0.5).cast("string")
    return F.concat(eighth(x), F.lit(","), eighth(y))


def splits_trunk(trunk: Column, a: Column, b: Column) -> Column:
    """Whether the line sets ``a`` and ``b`` have nothing in common and make up ``trunk`` together."""
    same = (F.size(F.array_except(F.array_union(a, b), trunk)) == 0) & (F.size(F.array_except(trunk, F.array_union(a, b))) == 0)
    return (F.size(F.array_intersect(a, b)) == 0) & same


def water_filled(shares: Column, floor: float, cap: float, rounds: int = 16) -> Column:
    """Shares kept between ``floor`` and ``cap``: cut at both ends and scaled to a sum of 1, for some rounds or until they do."""

    def step(rho: Column, _: Column) -> Column:
        cut = F.transform(rho, lambda r: F.greatest(F.lit(floor), F.least(F.lit(cap), r)))
        total = F.aggregate(cut, F.lit(0.0), lambda s, r: s + r)
        return F.when(F.abs(total - 1) < 1e-9, cut).otherwise(F.transform(cut, lambda r: r / total))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), shares, step)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    vx, vy = bx - ax, by - ay
    t = ((px - ax) * vx + (py - ay) * vy) / F.nullif(vx * vx + vy * vy, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))
    return F.sqrt(F.pow(px - (ax + t * vx), 2) + F.pow(py - (ay + t * vy), 2))


def segments_distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Least distance of the ends of two segments (x0, y0, x1, y1) from the other segment."""
    return F.least(
        segment_distance(p[0], p[1], *q), segment_distance(p[2], p[3], *q), segment_distance(q[0], q[1], *p), segment_distance(q[2], q[3], *p)
    )
