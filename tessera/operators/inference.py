"""The detector stage: tiles of pixels to model inputs, one model a worker, and its outputs as rows for decoding.

A model is what ``load()`` returns on a worker: a function of a batch (N, 3, height, width) that gives arrays. It is
loaded once for each Python worker, so ``load`` must be picklable; ``onnx(path)`` makes one of a model file.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import decode

# The means and deviations of the colour bands that the models were trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
BATCH = 8


def first_tiles(windows: DataFrame, n: int | None) -> DataFrame:
    """The first n windows by scene, row and column, before any work is done on them; all for None."""
    if n is None:
        return windows
    if n < 1:
        raise ValueError("the number of tiles must be positive")
    return windows.orderBy("scene_id", "row_off", "col_off").limit(n)


def first_match(paths: list[str]) -> str | None:
    return min(paths, default=None)


def tensor(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image (rows, columns, 3) of bytes as (3, height, width) floats: bilinear to the model's size, to 0..1, less the means, by the deviations."""
    for axis, size in ((0, height), (1, width)):
        n = image.shape[axis]
        if n != size:
            at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
            low = np.floor(at).astype(int)
            part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
            image = np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), axis) * part
    x = image.astype(np.float32) / np.float32(255)
    return ((x - np.float32(MEAN)) / np.float32(DEVIATION)).transpose(2, 0, 1).astype(np.float32)


def boxes_and_logits(outputs: list, classes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of a model's outputs, the three-dimensional ones with four values, and with one a class, or else any other number."""
    deep = [a for a in map(np.asarray, outputs) if a.ndim == 3]
    boxes = [a for a in deep if a.shape[-1] == 4]
    rest = sorted((a for a in deep if a.shape[-1] != 4), key=lambda a: classes is not None and a.shape[-1] != classes)
    if not boxes or not rest:
        raise ValueError(f"no boxes and logits among outputs of shapes {[np.shape(a) for a in outputs]}")
    return boxes[0], rest[0]


def onnx(path: str) -> Callable:
    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: session.run(None, {name: batch})

    return load


def backend(path: str, kind: str | None = None) -> str:
    """Which way a model is run: what the user names, or by its file's ending."""
    found = kind or {".onnx": "onnx", ".pt": "torch"}.get(Path(path).suffix.lower())
    if found not in ("onnx", "torch", "remote"):
        raise ValueError(f"no way to run {path!r}")
    return found


def tiles(windows: DataFrame, pixels: DataFrame) -> DataFrame:
    """windows with ``image``: the window's pixels by rows, three bytes each, 0 where the raster has none.

    Pixels meet their windows by block of the raster, so a scene is not gathered in one task; a task holds one window's pixels.
    """
    block = 64
    w = windows.withColumn("_br", F.explode(F.expr(f"sequence(row_off div {block}, (row_off + height - 1) div {block})"))).withColumn("_bc", F.explode(F.expr(f"sequence(col_off div {block}, (col_off + width - 1) div {block})")))
    p = pixels.select("scene_id", F.expr(f"row div {block}").alias("_br"), F.expr(f"col div {block}").alias("_bc"), "row", "col", "r", "g", "b")
    keys = ["scene_id", "col_off", "row_off", "width", "height"]
    inside = F.col("row").between(F.col("row_off"), F.col("row_off") + F.col("height") - 1) & F.col("col").between(F.col("col_off"), F.col("col_off") + F.col("width") - 1)
    place = (F.col("row") - F.col("row_off")) * F.col("width") + F.col("col") - F.col("col_off")
    colour = F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b")).cast("int")
    held = w.join(p, ["scene_id", "_br", "_bc"]).filter(inside).groupBy(*keys).agg(F.collect_list(F.struct(place.cast("int").alias("i"), colour.alias("c"))).alias("image"))
    return windows.join(held, keys, "left")


def infer(tiles: DataFrame, load: Callable, classes: int | None, size: tuple[int, int]) -> DataFrame:
    """Rows for decoding: a query of the model for each tile, with its box and logits."""
    names = ["scene_id", "col_off", "row_off", "tile_width", "tile_height", "query", "cx", "cy", "w", "h", "logits"]

    def run(batches):
        import pandas as pd

        model = load()
        for b in batches:
            for at in range(0, len(b), BATCH):
                rows = list(b.iloc[at : at + BATCH].itertuples(index=False))
                inputs = []
                for r in rows:
                    flat = np.zeros(r.height * r.width, np.int64)
                    if r.image is not None and len(r.image):
                        got = np.array([(p["i"], p["c"]) for p in r.image])
                        flat[got[:, 0]] = got[:, 1]
                    inputs.append(tensor(np.stack([flat >> 16, flat >> 8 & 255, flat & 255], 1).reshape(r.height, r.width, 3), *size))
                boxes, logits = boxes_and_logits(model(np.stack(inputs)), classes)
                out = [(r.scene_id, r.col_off, r.row_off, r.width, r.height, q, *map(float, boxes[k, q]), logits[k, q].astype(float).tolist()) for k, r in enumerate(rows) for q in range(boxes.shape[1])]
                yield pd.DataFrame(out, columns=names)

    kinds = "scene_id long, col_off int, row_off int, tile_width int, tile_height int, query int, cx double, cy double, w double, h double, logits array<double>"
    return tiles.select("scene_id", "col_off", "row_off", "width", "height", "image").mapInPandas(run, kinds)


def detect(windows: DataFrame, pixels: DataFrame, load: Callable, names: list[str], size: tuple[int, int], width: int, height: int, least: float = 0.25, limit: int | None = None) -> DataFrame:
    """Read, infer and decode: boxes of every window by scene."""
    rows = infer(tiles(first_tiles(windows, limit), pixels), load, len(names) or None, size)
    key = F.struct("scene_id", "col_off", "row_off")
    found = decode.from_tensors(rows.withColumn("tile_id", key), names, width, height, least)
    return found.select("tile_id.*", *[c for c in found.columns if c != "tile_id"])


def quarters():
    """A tiny model without weights: a box in each quarter of the tile, and the quarter's band means as logits."""
    def run(batch: np.ndarray) -> list[np.ndarray]:
        n, _, h, w = batch.shape
        parts = batch.astype(np.float64).reshape(n, 3, 2, h // 2, 2, w // 2).mean((3, 5))
        boxes = np.array([[(0.5 + x) / 2, (0.5 + y) / 2, 0.4, 0.3] for y in range(2) for x in range(2)])
        return [parts.reshape(n, 3, 4).transpose(0, 2, 1) * 4, np.broadcast_to(boxes, (n, 4, 4))]

    return run
