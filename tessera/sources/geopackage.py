"""GeoPackage files of boxes: an SQLite database with the three core tables and one table of features."""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from pathlib import Path
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: application id and the columns of the core tables.
APPLICATION = 0x47504B47
CORE = (
    "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)",
    "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)",
    "CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)",
)
MAP = ("map_xmin", "map_ymin", "map_xmax", "map_ymax")
# A feature is a header of 8 bytes and well-known binary: byte order, polygon, one ring, five points.
FEATURE = np.dtype([("magic", "S2"), ("version", "u1"), ("flags", "u1"), ("srs", "<i4"), ("order", "u1"), ("kind", "<u4"), ("rings", "<u4"), ("points", "<u4"), ("xy", "<f8", (10,))])
COLUMNS = "geom BLOB, class_name TEXT, confidence REAL, class_id INTEGER"
# Rows that a task holds at once, and rows that a task reads.
BLOCK, SHARE = 10_000, 200_000


def features(boxes: np.ndarray, epsg: int) -> list[bytes]:
    """Closed polygons, counter-clockwise with y up, in little-endian well-known binary behind GeoPackage's header."""
    f = np.zeros(len(boxes), FEATURE)
    for name, value in (("magic", b"GP"), ("flags", 1), ("srs", epsg), ("order", 1), ("kind", 3), ("rings", 1), ("points", 5)):
        f[name] = value
    f["xy"] = boxes[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]]
    data, n = f.tobytes(), FEATURE.itemsize
    return [data[i : i + n] for i in range(0, len(data), n)]


def local(path: str) -> str:
    """The path without its scheme; SQLite opens files of a folder that all machines share, no others."""
    bare = path.removeprefix("file://").removeprefix("file:")
    if "://" in bare:
        raise ValueError(f"{path}: GeoPackage files need a folder that is mounted")
    return bare


def layer_name(name: str, other: str = "detections") -> str:
    """Letters, digits and _ only, 48 of them at most, none of _ at the ends."""
    return ("".join(c if c.isalnum() or c == "_" else "_" for c in name).strip("_") or other)[:48]


def write(boxes: DataFrame, path: str, layer: str, epsg: int, definition: str = "undefined", overwrite: bool = False) -> int:
    """Write boxes with all edges (the others go) as one file in a folder that all machines share, and return their number.

    Tasks write features to files of their own beside it, and the driver appends these to the file, inside SQLite: it has one writer.
    """
    path = local(path)
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    table, part = layer_name(layer), f"{path}.{uuid.uuid4().hex}"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = boxes.select(*[F.col(c).cast("double") for c in MAP], "class_name", F.col("confidence").cast("double"), F.col("class_id").cast("long") if "class_id" in boxes.columns else F.lit(None).cast("long").alias("class_id"))
    rows = rows.dropna(subset=list(MAP))

    def save(batches):
        from pyspark import TaskContext as Task

        own, n, ends = f"{part}.{Task.get().partitionId():08d}.{uuid.uuid4().hex}", 0, None
        db = sqlite3.connect(own)
        db.execute("PRAGMA journal_mode = OFF")
        with db:
            db.execute(f"CREATE TABLE part ({COLUMNS})")
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(at, BLOCK)
                    edges = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in MAP], axis=1)
                    db.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", zip(features(edges, epsg), *[b.column(c).to_pylist() for c in ("class_name", "confidence", "class_id")], strict=True))
                    low, high = edges[:, :2].min(axis=0), edges[:, 2:].max(axis=0)
                    ends = (low, high) if ends is None else (np.minimum(ends[0], low), np.maximum(ends[1], high))
                    n += len(edges)
        db.close()
        if n:
            yield pa.RecordBatch.from_pylist([{"file": own, "n": n} | dict(zip(MAP, np.concatenate(ends).tolist(), strict=True))])

    try:
        # one row a task; a task that ran twice gives one of its files
        parts = sorted(rows.mapInArrow(save, "file string, n long, " + ", ".join(f"{c} double" for c in MAP)).collect())
        ends = [f(r[c] for r in parts) if parts else None for f, c in zip((min, min, max, max), MAP, strict=True)]
        db = sqlite3.connect(part)
        db.execute("PRAGMA journal_mode = OFF")
        with db:
            db.execute(f"PRAGMA application_id = {APPLICATION}")
            for table_sql in CORE:
                db.execute(table_sql)
            db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", [("undefined cartesian", -1, "NONE", -1, "undefined"), ("undefined geographic", 0, "NONE", 0, "undefined"), (f"EPSG:{epsg}", epsg, "EPSG", epsg, definition)])
            db.execute(f'CREATE TABLE "{table}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, {COLUMNS})')
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (table, table, *ends, epsg))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (table, epsg))
        for r in parts:
            db.execute("ATTACH ? AS one", (r.file,))
            with db:
                db.execute(f'INSERT INTO main."{table}" (geom, class_name, confidence, class_id) SELECT * FROM one.part ORDER BY rowid')
            db.execute("DETACH one")
            os.remove(r.file)
        db.close()
        os.replace(part, path)
    finally:
        for left in Path(path).parent.glob(glob.escape(os.path.basename(part)) + "*"):
            left.unlink(missing_ok=True)
    return sum(r.n for r in parts)


def read(spark, path: str) -> DataFrame:
    """The boxes of a file's first layer, by tasks that each read a range of its ids."""
    path = local(path)
    opened = lambda: sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    db = opened()
    (table,) = db.execute("SELECT table_name FROM gpkg_contents ORDER BY table_name LIMIT 1").fetchone()
    n, first, last = db.execute(f'SELECT count(*), min(fid), max(fid) FROM "{table}"').fetchone()
    db.close()
    tasks = max(1, -(-n // SHARE))
    step = (last - first) // tasks + 1 if n else 1

    def load(batches):
        db = opened()
        for b in batches:
            for k in b.column("id").to_pylist():
                rows = db.execute(f'SELECT geom, class_name, confidence, class_id FROM "{table}" WHERE fid BETWEEN ? AND ? ORDER BY fid', (first + k * step, min(last, first + (k + 1) * step - 1)))
                while block := rows.fetchmany(BLOCK):
                    geom, *rest = zip(*block, strict=True)
                    xy = np.frombuffer(b"".join(g[21:101] for g in geom), "<f8").reshape(-1, 5, 2)
                    edges = np.concatenate([xy.min(axis=1), xy.max(axis=1)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:, i]) for i in range(4)] + [pa.array(v, t) for v, t in zip(rest, (pa.string(), pa.float64(), pa.int64()), strict=True)], names=[*MAP, "class_name", "confidence", "class_id"])
        db.close()

    return spark.range(0, tasks if n else 0, 1, tasks).mapInArrow(load, ", ".join(f"{c} double" for c in MAP) + ", class_name string, confidence double, class_id long")
