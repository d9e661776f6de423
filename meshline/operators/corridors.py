"""Geometry of combos: tracks appended in order, repeats left out, and the corridor of each edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshline.sources.stored import dealt

#: Fixed values, in degrees: ends this near are one place; and this near for the ends of a corridor drawn already.
TIP, SAME_ENDS = 1e-5, 2e-4


def _own_course(coords: Column) -> Column:
    """Points without those that repeat the one before."""
    return F.filter(coords, lambda p, i: (i == 0) | (p != F.get(coords, i - 1)))


def _near(a: Column, b: Column, most: float) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy) <= most


def _follows(drawn: Column, seg: Column) -> Column:
    """Whether a track outside stations is drawn after what is drawn: not where it has the ends of it, or leads back to its start."""
    first, last, start, end = F.get(drawn, F.lit(0)), F.element_at(drawn, -1), F.get(seg["course"], F.lit(0)), F.element_at(seg["course"], -1)
    both = (_near(start, first, SAME_ENDS) & _near(end, last, SAME_ENDS)) | (_near(start, last, SAME_ENDS) & _near(end, first, SAME_ENDS))
    back = _near(last, start, TIP) & _near(end, first, SAME_ENDS)
    return F.when(F.size(drawn) < 2, True).otherwise(~both & ~back)


def combo_courses(steps: DataFrame, tracks: DataFrame, *key: str, rows: int | None = None) -> DataFrame:
    """``key``, ``course``: the points along the ``steps(key, pos, track, reversed)`` of each key, in order of ``pos``.

    ``tracks(track, grp, coords)``: a track of a station group is drawn where the group changes, one outside stations
    unless it repeats what is drawn (``_follows``). Unknown tracks are left out. The points of one key are in one row. About how many
    ``rows`` of steps there are, where it is known, tells how many tasks they are dealt to.
    """
    met = steps.join(tracks, "track").withColumn("course", _own_course(F.when(F.col("reversed"), F.reverse("coords")).otherwise(F.col("coords"))))
    met = met.filter(F.size("course") > 0)
    met = met if rows is None else dealt(met, rows, *key)
    per = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "grp", "course"))).alias("segs"))
    kind = met.schema["course"].dataType.simpleString()
    none = F.array().cast(kind)

    def draw(acc: Column, seg: Column) -> Column:
        drawn = acc["course"]
        wanted = F.when(seg["grp"].isNotNull(), acc["grp"].isNull() | (seg["grp"] != acc["grp"])).otherwise(_follows(drawn, seg))
        joint = (F.size(drawn) > 0) & (F.element_at(drawn, -1) == F.get(seg["course"], F.lit(0)))
        rest = F.when(joint, F.slice(seg["course"], 2, F.size(seg["course"]))).otherwise(seg["course"])
        course = F.when(wanted, F.concat(drawn, rest)).otherwise(drawn)
        return F.struct(course.alias("course"), F.coalesce(seg["grp"], acc["grp"]).alias("grp"))

    start = F.struct(none.alias("course"), F.lit(None).cast(met.schema["grp"].dataType).alias("grp"))
    return per.select(*key, F.aggregate("segs", start, draw)["course"].alias("course"))


def corridors(combos: DataFrame, courses: DataFrame, groups: DataFrame) -> DataFrame:
    """``a``, ``b``, ``course``: the corridor from group to group, of the first combo that has one.

    ``combos(route, combo, start_node, end_node)`` in the order of both numbers, ``groups(node, grp)``; combos that stay
    in a group, or whose course is under two points, have none.
    """
    at = lambda c, g: groups.select(F.col("node").alias(c), F.col("grp").alias(g))
    met = combos.join(at("start_node", "a"), "start_node").join(at("end_node", "b"), "end_node").filter("a <> b").join(courses, ["route", "combo"])
    found = met.filter(F.size("course") >= 2).groupBy("a", "b").agg(F.min_by("course", F.struct("route", "combo")).alias("course"))
    return found


def attached(edges: DataFrame, found: DataFrame) -> DataFrame:
    """``a``, ``b``, ``course`` of ``edges(a, b)``: the corridor forwards, else the one backwards turned round, else null."""
    back = found.select(F.col("a").alias("b"), F.col("b").alias("a"), F.reverse("course").alias("back"))
    met = edges.join(found, ["a", "b"], "left").join(back, ["a", "b"], "left")
    return met.select("a", "b", F.coalesce("course", "back").alias("course"))
