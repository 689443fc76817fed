"""Shapefiles of boxes: one whole file for each partition that Spark writes, and reading them back.

A box has a fixed record size, so every task writes its own .shp, .shx and .dbf without knowing of the
others. A retried task replaces its files. The folder must be one that all machines mount.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: file code, version, polygon type; name, type, width and decimals of the fields.
CODE, VERSION, POLYGON, HEADER = 9994, 1000, 5, 100
FIELDS = (("CLASS_NAME", "C", 50, 0), ("CONF", "N", 12, 6), ("CLASS_ID", "N", 10, 0), ("PXMIN", "N", 12, 2), ("PYMIN", "N", 12, 2), ("PXMAX", "N", 12, 2), ("PYMAX", "N", 12, 2))
SIZED = (*FIELDS, ("WIDTH_PX", "N", 12, 2), ("HEIGHT_PX", "N", 12, 2), ("WIDTH_CM", "N", 12, 2), ("HEIGHT_CM", "N", 12, 2), ("AREA_CM2", "N", 14, 2), ("SIZE_VAL", "N", 14, 2), ("SIZE_CLS", "C", 24, 0))
COLUMNS = ("class_name", "confidence", "class_id", "pixel_xmin", "pixel_ymin", "pixel_xmax", "pixel_ymax")
SIZED_COLUMNS = (*COLUMNS, "width_px", "height_px", "width_cm", "height_cm", "area_cm2", "size_value", "size_class")
MAP = ("map_xmin", "map_ymin", "map_xmax", "map_ymax")
_BOX = struct.Struct("<i4d2i i10d")


def _head(words: int, extent: tuple) -> bytes:
    return struct.pack(">i20xi", CODE, words) + struct.pack("<2i8d", VERSION, POLYGON, *extent, 0, 0, 0, 0)


def _cell(value, kind: str, width: int, decimals: int) -> bytes:
    if value is None or value != value:
        return b" " * width
    if kind == "C":
        return str(value)[:width].encode("ascii", "ignore").ljust(width)
    return f"{value:.{decimals}f}"[:width].rjust(width).encode("ascii")


def _files(base: str, rows: Iterable[tuple], fields: tuple, projection: str | None) -> int:
    """Rows are four map edges and then a value for each field."""
    mark = f".{uuid.uuid4().hex}"
    n, extent = 0, [float("inf"), float("inf"), float("-inf"), float("-inf")]
    size, width = _BOX.size, 1 + sum(f[2] for f in fields)
    with open(base + ".shp" + mark, "wb") as shp, open(base + ".shx" + mark, "wb") as shx, open(base + ".dbf" + mark, "wb") as dbf:
        shp.write(bytes(HEADER))
        shx.write(bytes(HEADER))
        dbf.write(bytes(32))
        for name, kind, w, d in fields:
            dbf.write(struct.pack("<11sc4xBB14x", name.encode("ascii"), kind.encode("ascii"), w, d))
        dbf.write(b"\r")
        for x0, y0, x1, y1, *values in rows:
            shx.write(struct.pack(">2i", (HEADER + n * (8 + size)) // 2, size // 2))
            n += 1
            # clockwise with y up, closed
            shp.write(struct.pack(">2i", n, size // 2) + _BOX.pack(POLYGON, x0, y0, x1, y1, 1, 5, 0, x0, y0, x0, y1, x1, y1, x1, y0, x0, y0))
            dbf.write(b" " + b"".join(_cell(v, *f[1:]) for v, f in zip(values, fields, strict=True)))
            extent = [min(extent[0], x0), min(extent[1], y0), max(extent[2], x1), max(extent[3], y1)]
        dbf.write(b"\x1a")
        box = tuple(extent) if n else (0.0, 0.0, 0.0, 0.0)
        for out, each in ((shp, 8 + size), (shx, 8)):
            out.seek(0)
            out.write(_head((HEADER + n * each) // 2, box))
        dbf.seek(0)
        day = date.today()
        dbf.write(struct.pack("<B3BIHH20x", 3, day.year - 1900, day.month, day.day, n, 32 * (len(fields) + 1) + 1, width))
    if projection is not None:
        Path(base + ".prj" + mark).write_text(projection, encoding="utf-8")
    for end in (".shx", ".dbf", ".prj"):
        if os.path.exists(base + end + mark):
            os.replace(base + end + mark, base + end)
    os.replace(base + ".shp" + mark, base + ".shp")
    return n


def write(boxes: DataFrame, folder: str, sized: bool = False, projection: str | None = None, overwrite: bool = False) -> int:
    """Write boxes (map edges and the columns of a detection) that have all map edges, and return their number. A file holds at most
    what a partition does: keep partitions below 15 million rows, the format's 2 GB."""
    where = Path(folder.removeprefix("file://").removeprefix("file:"))
    if where.exists() and any(where.iterdir()):
        if not overwrite:
            raise FileExistsError(f"{where} is not empty")
        for old in where.glob("part-*.*"):
            old.unlink()
    where.mkdir(parents=True, exist_ok=True)
    fields, columns, root = (SIZED, SIZED_COLUMNS, str(where)) if sized else (FIELDS, COLUMNS, str(where))
    kinds = dict(boxes.dtypes)
    b = boxes.dropna(subset=list(MAP)).select(*[F.col(c).cast("double") for c in MAP], *[F.col(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns])

    def save(batches):
        import pandas as pd
        from pyspark import TaskContext as Task

        k = Task.get().partitionId()
        rows = (tuple(None if pd.isna(v) else v for v in r) for p in batches for r in p.itertuples(index=False))
        yield pd.DataFrame({"n": [_files(f"{root}/part-{k:05d}", rows, fields, projection)]})

    return b.mapInPandas(save, "n long").agg(F.sum("n")).first()[0] or 0


def write_bins(boxes: DataFrame, folder: str, labels: list[str], projection: str | None = None, overwrite: bool = False) -> dict[str, int]:
    """A folder of sized boxes for each label, named by it, of no rows where no box has it; how many rows each has."""
    from tessera.operators.reports import file_label

    names = boxes.sparkSession.createDataFrame([(x,) for x in labels], "size_class string").select("size_class", file_label(F.col("size_class"))).collect()
    return {x: write(boxes.filter(F.col("size_class") == x), f"{folder}/bin__{name}", True, projection, overwrite) for x, name in names}


def read(spark: SparkSession, folder: str, sized: bool = False) -> DataFrame:
    """Boxes of all shapefiles of a folder, a file a task. The .shx is not needed."""
    fields, columns = (SIZED, SIZED_COLUMNS) if sized else (FIELDS, COLUMNS)
    where = folder.removeprefix("file://").removeprefix("file:")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(where).select("path")
    schema = ", ".join(f"{c} double" for c in MAP) + ", " + ", ".join(f"{c} {'string' if f[1] == 'C' else 'long' if f[3] == 0 else 'double'}" for c, f in zip(columns, fields, strict=True))

    def load(batches):
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                base = path.removeprefix("file://").removeprefix("file:")[:-4]
                for chunk in _chunks(base, fields):
                    yield pd.DataFrame(chunk, columns=[*MAP, *columns]).astype({c: "Int64" for c, f in zip(columns, fields, strict=True) if f[1] == "N" and f[3] == 0})

    return files.mapInPandas(load, schema)


def _chunks(base: str, fields: tuple, rows: int = 10_000):
    with open(base + ".shp", "rb") as shp, open(base + ".dbf", "rb") as dbf:
        shp.seek(HEADER)
        head, width = struct.unpack("<8xHH20x", dbf.read(32))
        dbf.seek(head)
        out = []
        while mark := shp.read(8):
            body = shp.read(2 * struct.unpack(">4xi", mark)[0])
            line = dbf.read(width)
            if struct.unpack_from("<i", body)[0] != POLYGON or line[:1] == b"*":
                continue
            at, values = 1, []
            for _, kind, w, d in fields:
                text = line[at : at + w].decode("ascii", "replace").strip()
                at += w
                values.append((text or None) if kind == "C" else None if not text else float(text) if d else int(text))
            out.append((*struct.unpack_from("<4d", body, 4), *values))
            if len(out) == rows:
                yield out
                out = []
        if out:
            yield out
