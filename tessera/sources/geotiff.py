"""GeoTIFF rasters: each scene's cells as one float32 or RGBA file, and files as pixel tables.

Strips are deflated. A scene is held whole by one task when it is written, a strip when it is read.
The folder must be one that all machines mount.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: tag numbers, field types and their sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, EXTRA, KIND, SCALE, TIEPOINT, NODATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 338, 339, 33550, 33922, 42113
SHORT, LONG, DOUBLE, ASCII = 3, 4, 12, 2
FORMAT = {SHORT: "H", LONG: "I", DOUBLE: "d", ASCII: "B"}
STRIP = 16


def encode(image, pixel: float, x0: float, y0: float, nodata: float | None) -> bytes:
    """A TIFF of an array of height x width x bands."""
    h, w, bands = image.shape
    strips = [zlib.compress(image[r : r + STRIP].tobytes()) for r in range(0, h, STRIP)]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    floats = image.dtype.kind == "f"
    tags = {
        WIDTH: (LONG, [w]), HEIGHT: (LONG, [h]), BITS: (SHORT, [image.dtype.itemsize * 8] * bands), COMPRESSION: (SHORT, [8]), PHOTOMETRIC: (SHORT, [2 if bands > 2 else 1]),
        OFFSETS: (LONG, offsets), SAMPLES: (SHORT, [bands]), ROWS: (LONG, [STRIP]), COUNTS: (LONG, [len(s) for s in strips]), KIND: (SHORT, [3 if floats else 1] * bands),
        SCALE: (DOUBLE, [pixel, pixel, 0.0]), TIEPOINT: (DOUBLE, [0.0, 0.0, 0.0, x0, y0, 0.0]),
    }
    if bands == 4:
        tags[EXTRA] = (SHORT, [2])
    if nodata is not None:
        tags[NODATA] = (ASCII, list(f"{nodata:g}".encode() + b"\0"))
    at += at % 2
    more, entries, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        data = struct.pack(f"<{len(values)}{FORMAT[kind]}", *values)
        if len(data) > 4:
            place = struct.pack("<I", free + len(more))
            more += data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    body = struct.pack("<2sHI", b"II", 42, at) + b"".join(strips)
    return body.ljust(at, b"\0") + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + more


def header(f) -> dict[int, list]:
    """Tags of an open little- or big-endian TIFF."""
    f.seek(0)
    order = {b"II": "<", b"MM": ">"}[f.read(2)]
    code, at = struct.unpack(order + "HI", f.read(6))
    if code != 42:
        raise ValueError("not a TIFF")
    f.seek(at)
    entries = [struct.unpack(order + "HHI4s", f.read(12)) for _ in range(struct.unpack(order + "H", f.read(2))[0])]
    tags: dict = {0: [order]}
    for tag, kind, n, place in entries:
        if kind not in FORMAT:
            continue
        form = f"{order}{n}{FORMAT[kind]}"
        if struct.calcsize(form) > 4:
            f.seek(struct.unpack(order + "I", place)[0])
            place = f.read(struct.calcsize(form))
        tags[tag] = list(struct.unpack_from(form, place))
    return tags


def strips(f, tags: dict):
    """(first row, array of rows x width x bands) of each strip; stored or deflated, bands by pixel."""
    import numpy as np

    if tags.get(COMPRESSION, [1])[0] not in (1, 8, 32946) or OFFSETS not in tags:
        raise ValueError("only stored or deflated strips can be read")
    bands, bits, kind = tags.get(SAMPLES, [1])[0], tags[BITS][0], tags.get(KIND, [1])[0]
    dtype = np.dtype(f"{tags[0][0]}{ {1: 'u', 2: 'i', 3: 'f'}[kind]}{bits // 8}")
    per = tags.get(ROWS, tags[HEIGHT])[0]
    for k, (at, n) in enumerate(zip(tags[OFFSETS], tags[COUNTS], strict=True)):
        f.seek(at)
        data = f.read(n)
        data = data if tags.get(COMPRESSION, [1])[0] == 1 else zlib.decompress(data)
        yield k * per, np.frombuffer(data, dtype).reshape(-1, tags[WIDTH][0], bands)


def write(cells: DataFrame, folder: str, bands: list[str], width: int, height: int, pixel: float = 1.0, nodata: float | None = 0.0) -> DataFrame:
    """One file scene_<id>.tif for each scene_id of (scene_id, row, col, bands); missing cells are 0.
    One band is float32, more are bytes. Returns scene_id and path."""
    root = folder.removeprefix("file://").removeprefix("file:")
    Path(root).mkdir(parents=True, exist_ok=True)

    def save(key, rows):
        import numpy as np
        import pandas as pd

        image = np.zeros((height, width, len(bands)), "<f4" if len(bands) == 1 else "u1")
        image[rows["row"].to_numpy(), rows["col"].to_numpy()] = rows[bands].to_numpy()
        path, part = f"{root}/scene_{key[0]}.tif", f"{root}/.{uuid.uuid4().hex}"
        Path(part).write_bytes(encode(image, pixel, 0.0, 0.0, nodata))
        os.replace(part, path)
        return pd.DataFrame({"scene_id": [key[0]], "path": [path]})

    return cells.select("scene_id", "row", "col", *bands).groupBy("scene_id").applyInPandas(save, "scene_id long, path string")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels (path, row, col, values, valid) of the .tif files of a folder, a strip at a time. valid: finite and not the nodata value."""
    where = folder.removeprefix("file://").removeprefix("file:")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").option("recursiveFileLookup", "true").load(where).select("path")

    def load(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
                    tags = header(f)
                    nodata = float(bytes(tags[NODATA]).rstrip(b"\0 ")) if NODATA in tags else None
                    for top, a in strips(f, tags):
                        h, w, _ = a.shape
                        v = a.reshape(h * w, -1).astype("f8")
                        ok = np.isfinite(v).all(1) if nodata is None else np.isfinite(v).all(1) & ~(v == nodata).all(1)
                        yield pd.DataFrame({"path": path, "row": np.repeat(np.arange(top, top + h), w), "col": np.tile(np.arange(w), h), "values": list(v), "valid": ok})

    return files.mapInPandas(load, "path string, row int, col int, values array<double>, valid boolean")


def rgb(pixels: DataFrame) -> DataFrame:
    """r, g, b of pixels read: one band thrice, the second of two twice, the first three of more."""
    n, v = F.size("values"), lambda k: F.element_at("values", k)
    return pixels.select("*", v(1).alias("r"), F.when(n == 1, v(1)).otherwise(F.try_element_at("values", F.lit(2))).alias("g"), F.when(n == 1, v(1)).when(n == 2, F.try_element_at("values", F.lit(2))).otherwise(F.try_element_at("values", F.lit(3))).alias("b"))
