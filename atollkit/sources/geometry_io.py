"""Geometry at the edges: WKT, WKB and GeoJSON, and ASCII grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atollkit.functions import kernels
from atollkit.functions.crs import GEOMETRY
from atollkit.functions.geometry_udf import lists_of_polygons, polygons, rowwise


def from_wkt(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a row for each polygon of the WKT text; null and empty texts give none. A point is a ring of one vertex."""
    parse = rowwise(lambda t: kernels.parse_wkt(t) if t.strip() else [], f"array<{GEOMETRY}>")
    others = [c for c in df.columns if c not in (text, name)]
    return df.select(*others, F.explode(parse(F.coalesce(F.col(text), F.lit("")))).alias(name))


def to_wkt(df: DataFrame, geom: str, name: str) -> DataFrame:
    """df with the polygon as WKT text; built-in functions alone."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "), F.lit(")"))
    return df.withColumn(name, F.concat(F.lit("POLYGON ("), F.array_join(F.transform(F.col(geom), ring), ", "), F.lit(")")))


def _wkb_polygons(raw: bytes) -> list:
    """Polygons of a WKB value: POINT, POLYGON, MULTIPOLYGON or GEOMETRYCOLLECTION, either byte order at each level, with or without Z, M and SRID."""
    def read(at: int) -> tuple[list, int]:
        order = "<" if raw[at] else ">"
        kind = int(np.frombuffer(raw, f"{order}u4", 1, at + 1)[0])
        at += 9 if kind & 0x20000000 else 5
        wide = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000]
        kind = (kind & 0xFFFF) % 1000
        if kind == 1:
            p = np.frombuffer(raw, f"{order}f8", wide, at)[None, :2]
            return ([] if np.isnan(p).any() else [[p.astype(float)]]), at + 8 * wide
        if kind not in (3, 6, 7):
            raise ValueError(f"cannot read WKB type {kind}")
        n, at, out = int(np.frombuffer(raw, f"{order}u4", 1, at)[0]), at + 4, []
        for _ in range(n):
            if kind == 3:
                m = int(np.frombuffer(raw, f"{order}u4", 1, at)[0])
                out.append(np.frombuffer(raw, f"{order}f8", m * wide, at + 4).reshape(m, wide)[:, :2].astype(float))
                at += 4 + 8 * m * wide
            else:
                parts, at = read(at)
                out += parts
        return ([out] if out else []) if kind == 3 else out, at

    return read(0)[0] if raw else []


def from_wkb(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a row for each polygon of the WKB column; null, empty and EMPTY values give none. A point is a ring of one vertex."""
    read = F.arrow_udf(lambda c: lists_of_polygons([_wkb_polygons(x or b"") for x in c.to_pylist()]), f"array<{GEOMETRY}>")
    others = [c for c in df.columns if c not in (column, name)]
    return df.select(*others, F.explode(read(F.col(column).cast("binary"))).alias(name))


def _to_wkb(column: pa.Array) -> pa.Array:
    head = lambda kind, n: np.array([n], "<u4").tobytes() if kind is None else b"\x01" + np.array([kind, n], "<u4").tobytes()
    out = [None if g is None else head(3, len(g)) + b"".join(head(None, len(r)) + r.astype("<f8").tobytes() for r in g) for g in polygons(column)]
    return pa.array(out, pa.binary())


def to_wkb(df: DataFrame, geom: str, name: str) -> DataFrame:
    """df with the polygon as little-endian WKB."""
    return df.withColumn(name, F.arrow_udf(_to_wkb, "binary")(F.col(geom)))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of a feature a line (with or without the record separator before it), one row a polygon. Files are split, however large; blank and unreadable lines and
    those without a polygon give none."""
    kind = T._parse_datatype_string("type string, properties map<string,string>, geometry struct<type:string,coordinates:string>")
    lines = spark.read.text(path).select(F.from_json(F.ltrim(F.translate("value", "\x1e", " ")), kind).alias("f"))
    return _polygon_rows(lines, [F.col("f.properties").alias("properties")])


def _polygon_rows(rows: DataFrame, others: list) -> DataFrame:
    """others and geometry, a row for each polygon of the features f."""
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons_ = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", F.array(one))
    shaped = F.transform(F.col("p"), lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    return rows.select(*others, F.explode(polygons_).alias("p")).withColumn("geometry", shaped).drop("p")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, properties, geometry) of the polygons and multipolygons of feature collections, one row a polygon."""
    kind = T._parse_datatype_string("type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>")
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    return _polygon_rows(rows, ["feature", F.col("f.properties").alias("properties")])


def write_ascii_grids(cells: DataFrame, path: str, rows: int, cols: int, nodata: int = -9999) -> None:
    """One ESRI ASCII grid a layer, in a folder layer=... below path, whose name read_ascii_grid takes as the label.

    Each row's line is built in its own group, from its cells in order and the gaps between them: work and memory go with a line's length. Lines are
    dealt out by ranges of layer and row and written in that order, the header before row 0: a layer's files, in the order of their names, are the
    grid, and no task holds more than its range. Two values in one place are an error."""
    blank = lambda n: F.repeat(F.lit(f"{nodata} "), n)
    listed = cells.where(F.col("c").between(0, cols - 1)).groupBy("layer", "r").agg(F.array_sort(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), "v"))).alias("s"))
    past = lambda i: F.when(i > 0, F.get("s", i - 1).c).otherwise(-1)
    twice = F.raise_error(F.concat(F.lit("two values in one place in "), "layer"))
    told = lambda x, i: F.when(x.c > past(i), F.concat(blank(x.c - past(i) - 1), F.coalesce(x.v.cast("string"), F.lit(str(nodata))))).otherwise(twice)
    rest = blank(F.lit(cols - 1) - F.get("s", F.size("s") - 1).c)
    body = listed.select("layer", "r", F.rtrim(F.concat(F.array_join(F.transform("s", told), " "), F.lit(" "), rest)).alias("value"))
    spine = cells.select("layer").distinct().select("layer", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"))
    full = spine.join(body, ["layer", "r"], "left").select("layer", "r", F.coalesce("value", F.rtrim(blank(F.lit(cols)))).alias("value"))
    head = cells.select("layer").distinct().select("layer", F.lit(-1).alias("r"), F.lit(f"ncols {cols}\nnrows {rows}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value {nodata}").alias("value"))
    ordered = full.unionByName(head).repartitionByRange("layer", "r").sortWithinPartitions("layer", "r")
    ordered.select("layer", "value").write.partitionBy("layer").text(path)
