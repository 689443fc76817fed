"""Model outputs to detections: tensors, JSON payloads and class names."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.detections import BOX, clamp_boxes

# Class names that stand for nothing, beside all that begin with "background".
NOTHING = ("no_object", "no-object", "__background__")


def background(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return n.startswith("background") | n.isin(*NOTHING)


def class_name(class_id: Column, names: list[str]) -> Column:
    """The name at class_id, else the id as text; a null id has the only name there is, or rock."""
    sure = F.lit(names[0] if len(names) == 1 else "rock")
    if not names:
        return F.coalesce(class_id.cast("string"), sure)
    known = F.when(class_id.between(0, len(names) - 1), F.element_at(F.array(*map(F.lit, names)), F.greatest(class_id, F.lit(0)).cast("int") + 1))
    return F.coalesce(known, class_id.cast("string"), sure)


def from_tensors(outputs: DataFrame, names: list[str], width: int, height: int, least: float = 0.25) -> DataFrame:
    """Boxes of (tile_id, col_off, row_off, tile_width, tile_height, query, cx, cy, w, h, logits).

    Each class of a query whose sigmoid reaches the threshold is a box. Boxes whose four values are at most
    2 are shares of the tile.
    """
    if not 0 <= least <= 1:
        raise ValueError("confidence must be in [0, 1]")
    o = outputs.select("*", F.posexplode("logits").alias("class_id", "_l")).withColumn("confidence", 1 / (1 + F.exp(-F.col("_l")))).filter(F.col("confidence") >= least)
    o = o.withColumn("class_name", class_name(F.col("class_id"), names))
    if names:
        o = o.filter(~((F.col("class_id") < len(names)) & background(F.col("class_name"))))
    share = F.greatest(*[F.abs(c) for c in ("cx", "cy", "w", "h")]) <= 2
    x, y = (F.when(share, F.col(c)).otherwise(F.lit(1)) for c in ("tile_width", "tile_height"))
    at = {"pixel_xmin": ("col_off", "cx", "w", x, -1), "pixel_ymin": ("row_off", "cy", "h", y, -1), "pixel_xmax": ("col_off", "cx", "w", x, 1), "pixel_ymax": ("row_off", "cy", "h", y, 1)}
    o = o.withColumns({k: F.col(off) + F.col(c) * unit + sign * F.col(s) * unit / 2 for k, (off, c, s, unit, sign) in at.items()})
    return clamp_boxes(o, width, height).select("tile_id", "query", "class_id", "class_name", "confidence", *BOX)


SIDES = ("x", "y", "width", "height")
#: Names under which a payload may hold a box's sides, score, class name and class number, the first of them first.
INSIDE, SCORE, CLASS, CLASS_ID = ("bbox", "bounding_box"), ("confidence", "score", "class_confidence"), ("class", "class_name", "label"), ("class_id", "classId")


class Found(dict):
    """An object of a payload that has the four sides of a box, its own or those of a box inside it."""


def _marked(pairs: list) -> dict:
    """What the parser calls for each object, inner ones first."""
    held = dict(pairs)
    for part in (held, *(held[k] for k in INSIDE if isinstance(held.get(k), dict))):
        if all(side in part for side in SIDES):
            return Found({**held, **part})
    return held


def _listed(node, image=None) -> Iterator[tuple[Found, object]]:
    """Boxes in reading order, each with its image: those under ``predictions``, and those of lists that hold nothing else."""
    match node:
        case {"predictions": [*listed], **rest}:
            yield from ((b, rest.get("image")) for b in listed if isinstance(b, Found))
            yield from _listed(list(rest.values()))
        case {**rest} if rest:
            yield from _listed(list(rest.values()))
        case [_, *_] if all(isinstance(b, Found) for b in node):
            yield from ((b, None) for b in node)
        case [*inner]:
            for each in inner:
                yield from _listed(each)


def _as(kind, box: dict, names: Iterable[str], default):
    """The value under the first of the names there, as a number; the default if it is none."""
    try:
        return kind(next(box[k] for k in names if k in box))
    except (StopIteration, TypeError, ValueError, OverflowError):
        return default


def _boxes(payload: str | None):
    """(class name, score, class id, centre and sides, size of the image or null) of the boxes of one payload."""
    try:
        tree = json.loads(payload or "null", object_pairs_hook=_marked)
        for box, image in _listed(tree):
            size = image if isinstance(image, dict) else {}
            name = next((box[k] for k in CLASS if k in box), "rock")
            yield str(name), _as(float, box, SCORE, 0.0), _as(int, box, CLASS_ID, None), *(_as(float, box, [k], 0.0) for k in SIDES), _as(float, size, ["width"], None), _as(float, size, ["height"], None)
    except (ValueError, RecursionError):  # broken, or nested beyond what the parser takes
        return


def from_json(tiles: DataFrame, width: int, height: int, least: float = 0.25) -> DataFrame:
    """Boxes in the payloads of (tile_id, col_off, row_off, tile_width, tile_height, payload).

    Payloads are taken apart in Arrow batches; scale, place and threshold are columns. Broken or null payloads
    hold no box; values that are no numbers count as 0.
    """
    if not 0 <= least <= 1:
        raise ValueError("confidence must be in [0, 1]")
    parts = ["class_name", "confidence", "class_id", *SIDES, "image_w", "image_h"]
    place = ["tile_id", "col_off", "row_off", "tile_width", "tile_height"]

    def take_apart(batches):
        import pyarrow as pa

        for b in batches:
            found = [list(_boxes(p)) for p in b.column("payload").to_pylist()]
            owner = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            flat = [r for rows in found for r in rows]
            kinds = [pa.string(), pa.float64(), pa.int64(), *[pa.float64()] * 6]
            columns = [pa.array([r[i] for r in flat], k, from_pandas=False) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(c).take(owner) for c in place] + columns, names=place + parts)

    kinds = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in place) + ", class_name string, confidence double, class_id long, " + ", ".join(f"{c} double" for c in parts[3:])
    boxes = tiles.select(*place, "payload").mapInArrow(take_apart, kinds)
    finite = ~(F.isnan(F.col("x") - F.col("x")) | F.isnan(F.col("y") - F.col("y")) | F.isnan(F.col("width") - F.col("width")) | F.isnan(F.col("height") - F.col("height")))
    boxes = boxes.filter((F.col("confidence") >= least) & finite)
    scale = lambda tile, image: F.when(F.coalesce(image, tile) != 0, tile / F.coalesce(image, tile)).otherwise(F.lit(1.0))
    out = {}
    for axis, off, side, tile, image in (("x", "col_off", "width", "tile_width", "image_w"), ("y", "row_off", "height", "tile_height", "image_h")):
        unit = scale(F.col(tile).cast("double"), F.col(image))
        for end, sign in (("min", -1), ("max", 1)):
            out[f"pixel_{axis}{end}"] = F.col(off) + (F.col(axis) + sign * F.col(side) / 2) * unit
    return clamp_boxes(boxes.withColumns(out), width, height).select("tile_id", "class_name", "confidence", "class_id", *BOX)


def _bare(x: str) -> str:
    return x.strip().strip("'\"").strip()


def _named(value) -> list[str]:
    """Names of a list, of a text parted by commas or lines, or of a mapping by key, numbers in their order."""
    if isinstance(value, str):
        value = [x.strip() for x in value.replace(",", "\n").splitlines()]
    if isinstance(value, dict):
        value = [value[k] for k in sorted(value, key=lambda k: (not str(k).isdigit(), int(k) if str(k).isdigit() else 0, str(k)))]
    return [str(x) for x in value if str(x)] if isinstance(value, list) else []


def sidecar_names(text: str) -> list[str]:
    """Class names of a sidecar text: JSON (a list, or an object with names), ``names`` in YAML style, a comma list, or lines; lines that start with # are comments."""
    try:
        tree = json.loads(text)
    except ValueError:
        tree = None
    if isinstance(tree, dict):
        tree = next((tree[k] for k in ("names", "class_names", "class_name", "classes") if tree.get(k)), None)
    elif not isinstance(tree, list):
        tree = None
    if names := _named(tree):
        return names
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    at = next((i for i, x in enumerate(lines) if x.startswith("names:")), None)
    if at is not None:
        rest = lines[at][6:].strip()
        if rest.startswith("["):
            return [b for x in rest.strip("[]").split(",") if (b := _bare(x))]
        if rest:
            return _named(_bare(rest))
        found, pairs = [], {}
        for x in lines[at + 1 :]:
            key, colon, value = x.partition(":")
            if x.startswith("- "):
                found.append(_bare(x[2:]))
            elif colon and _bare(key).isdigit():
                pairs[_bare(key)] = _bare(value)
            else:
                break
        return found or _named(pairs)
    return [x.strip() for x in lines[0].split(",") if x.strip()] if len(lines) == 1 and "," in lines[0] else lines
