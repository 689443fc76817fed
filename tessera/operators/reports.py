"""Run reports: labels for file names and Markdown summaries, one line a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_label(label: Column) -> Column:
    """A size class as part of a file name: > as gt_, < as lt_, other characters as _."""
    s = F.trim(label)
    s = F.when(s.startswith(">"), F.concat(F.lit("gt_"), F.substr(s, F.lit(2)))).when(s.startswith("<"), F.concat(F.lit("lt_"), F.substr(s, F.lit(2)))).otherwise(s)
    s = F.btrim(F.regexp_replace(s, r"[^\p{L}\p{N}_]", "_"), F.lit("_"))
    return F.when(s == "", "unclassified").otherwise(s)


def size_table(counts: DataFrame, order: list[str]) -> DataFrame:
    """Markdown of each scene's counts by size class, in the order of the classes. counts: scene_id, size_class, n."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("size_class"))
    line = F.format_string("| %s | %d |", "size_class", "n")
    rows = counts.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), line.alias("line")))).alias("rows"))
    head = F.array(F.lit("| Bin | Count |"), F.lit("|---|---:|"))
    return rows.select("scene_id", F.array_join(F.concat(head, F.transform("rows", lambda r: r["line"])), "\n").alias("report"))


def duration(seconds: Column) -> Column:
    """Whole seconds as 7s, 2m05s or 1h02m05s; halves to even, nothing below 0."""
    s = F.greatest(F.lit(0), F.rint(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def remaining(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the pace so far; 0 before the first tile and after the last."""
    return F.when((done > 0) & (total > done), elapsed / done * (total - done)).otherwise(F.lit(0.0))


def labels_to_write(order: list[str], every: bool, chosen: str | None) -> list[str]:
    """The size classes that get a file of their own, in order: all if asked for, and the one that the habitat uses."""
    want = {*(order if every else ()), *([chosen] if chosen else ())}
    return [x for x in order if x in want]


def run_text(metrics: DataFrame, order: list[str]) -> DataFrame:
    """A run's summary by scene. metrics: scene_id, raw, kept, green, sizes (map of size class to count), cells, blocked, scored, zones."""
    line = lambda label, c: F.concat(F.lit(f"  - {label}: "), F.col(c).cast("string"))
    sizes = F.transform(F.array(*map(F.lit, order)), lambda k: F.concat(F.lit("      "), k, F.lit(": "), F.coalesce(F.try_element_at("sizes", k), F.lit(0)).cast("string")))
    first = F.array(F.lit("Run summary:"), line("Detections", "raw"), line("After suppression", "kept"), line("Removed as green", "green"), F.lit("  - By size:"))
    rest = F.array(line("Grid cells", "cells"), line("Blocked by canopy", "blocked"), line("Scored above 0", "scored"), line("Zones", "zones"))
    return metrics.select("scene_id", F.array_join(F.concat(first, sizes, rest), "\n").alias("report"))


def point_text(points: DataFrame) -> DataFrame:
    """A Markdown line a point. points: scene_id, point_id, x, y, n, sizes (map of size class to count)."""
    found = F.filter(F.map_entries("sizes"), lambda e: e["value"] > 0)
    each = F.array_join(F.transform(F.array_sort(found), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ", ")
    where = F.format_string("- %s (%.1f, %.1f): ", "point_id", "x", "y")
    some = F.concat(F.format_string("total=%d; ", "n"), F.when(each == "", "no size breakdown").otherwise(each))
    return points.select("scene_id", "point_id", F.concat(where, F.when(F.col("n") > 0, some).otherwise("none")).alias("line"))
