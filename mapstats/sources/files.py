"""Readers and writers of the formats that the ETL meets. Archives and binary tables arrive through
Spark's binaryFile source, so any store that Spark reads will do; each file is one row there, and
is parsed where it lies, piece by piece."""

from __future__ import annotations

import csv
import io
import json
import struct
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 10_000


def _struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """Typed scan; a malformed row is an error, and only the columns asked for are parsed."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return df.select(columns) if columns else df


def _blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _converted(rows: Iterator[dict], schema: T.StructType) -> Iterator[pd.DataFrame]:
    def typed(value: str | None, kind: T.DataType):
        if value is None or (value == "" and not isinstance(kind, T.StringType)):
            return None
        return value if isinstance(kind, T.StringType) else float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else int(value)

    batch: list[list] = []
    for r in rows:
        batch.append([typed(r[f.name], f.dataType) for f in schema])
        if len(batch) == ROWS:
            yield pd.DataFrame(batch, columns=schema.names, dtype=object)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=schema.names, dtype=object)


def _member(z: zipfile.ZipFile, suffix: str) -> str:
    found = [n for n in z.namelist() if n.lower().endswith(suffix.lower())]
    if len(found) != 1:
        raise ValueError(f"{len(found)} members end with {suffix}; one is needed")
    return found[0]


def read_zip_csv(spark: SparkSession, path: str, schema: str, member: str = ".csv", aliases: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """The one member of each archive that ends so, as text with or without a byte-order mark. aliases
    renames headers; a missing column is an error."""
    shape, names = _struct(schema), dict(aliases or {})

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(_member(z, member)) as f:
                    reader = csv.DictReader(io.TextIOWrapper(f, encoding="utf-8-sig", newline=""), delimiter=sep)
                    reader.fieldnames = [names.get(h.strip(), h.strip()) for h in reader.fieldnames or []]
                    if missing := set(shape.names) - set(reader.fieldnames):
                        raise ValueError(f"columns are missing: {sorted(missing)}")
                    yield from _converted(reader, shape)

    return _blobs(spark, path).mapInPandas(parse, shape)


def dbf_rows(data: bytes, wanted: list[str]) -> Iterator[dict]:
    """Records of a DBF table that are not deleted; a file that is too short is an error."""
    count, header, width = struct.unpack("<IHH", data[4:12])
    fields, at, offset = {}, 32, 1
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii")
        fields[name] = (offset, data[at + 16])
        offset += data[at + 16]
        at += 32
    if missing := set(wanted) - set(fields):
        raise ValueError(f"fields are missing: {sorted(missing)}")
    if offset != width or len(data) < header + count * width:
        raise ValueError("the table is cut off")
    for k in range(count):
        start = header + k * width
        if data[start : start + 1] == b"*":
            continue
        yield {n: data[start + fields[n][0] : start + sum(fields[n])].decode("latin-1").strip() for n in wanted}


def read_dbf(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """DBF tables, alone or as the one .dbf member of an archive."""
    shape = _struct(schema)

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                data = bytes(content)
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(_member(z, ".dbf"))
                yield from _converted(dbf_rows(data, shape.names), shape)

    return _blobs(spark, path).mapInPandas(parse, shape)


def shape_rings(data: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """Record number and rings of each polygon of a .shp file."""
    if struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at < len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            yield number, []
            continue
        if kind % 10 != 5:
            raise ValueError(f"shape type {kind} is no polygon")
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        yield number, [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """record, wkb of each polygon of .shp files, alone or in an archive."""
    from mapstats.functions.geometry import wkb_polygon

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(_member(z, ".shp"))
                rows = [(k, wkb_polygon(r)) for k, r in shape_rings(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["record", "wkb"])

    return _blobs(spark, path).mapInArrow(parse, "record long, wkb binary")


TRACE = "seed int, epsilon double, step long, dem_seats int, cut_edges int, efficiency_gap double, mean_median double, max_abs_pop_dev double, plan_hash string"
SEGMENT = r"_seed(\d+)_steps(\d+)-(\d+)"


def read_segments(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    """Chain segments, each row with the seed and step range that its file's name claims."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_name"), SEGMENT, k).cast("long")
    return df.withColumns({"file_seed": part(1), "file_first": part(2), "file_last": part(3)})


def segment_faults(segments: DataFrame) -> DataFrame:
    """Segments whose rows are not exactly what their names claim."""
    g = segments.groupBy("file_seed", "file_first", "file_last").agg(F.count("*").alias("n"), F.count_distinct("step").alias("kinds"), F.min("step").alias("a"), F.max("step").alias("b"), F.count_if(F.col("seed") != F.col("file_seed")).alias("strays"))
    ok = (F.col("a") == F.col("file_first")) & (F.col("b") == F.col("file_last")) & (F.col("n") == F.col("kinds")) & (F.col("n") == F.col("b") - F.col("a") + 1) & (F.col("strays") == 0)
    return g.where(~ok)


def read_manifest(spark: SparkSession, path: str, version: int) -> dict:
    """A JSON manifest of one object; another version is an error."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    got = json.loads(text)
    if got.get("version") != version:
        raise ValueError(f"manifest version {got.get('version')!r}; {version} is needed")
    return got


def catalog(entries: DataFrame) -> DataFrame:
    """Catalogue rows (Title, Format, URL) without credentials: name of the file and bare address."""
    bare = F.regexp_replace(F.regexp_replace("URL", r"//[^/@]*@", "//"), r"[?#].*$", "")
    name = F.url_decode(F.element_at(F.split(bare, "/"), -1))
    fine = F.col("URL").rlike(r"^https://[^\s]+$") & (F.length(name) > 0)
    return entries.where(fine).select(F.trim("Title").alias("title"), F.upper("Format").alias("format"), bare.alias("url"), name.alias("file_name"))


def inventory(entries: DataFrame, terms: list[str], limit: int = 30) -> DataFrame:
    """Entries whose title holds every term, whatever its case; a listing, so the limit is its feature."""
    found = entries
    for t in terms:
        found = found.where(F.contains(F.lower("title"), F.lit(t.lower())))
    return found.orderBy("title", "file_name").limit(limit)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write to a place that must not exist yet."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def publish(df: DataFrame, path: str) -> bool:
    """Write once; the same rows again are fine (False), other rows an error."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        write_once(df, path)
        return True
    old = spark.read.parquet(path)
    if old.columns != df.columns or not (old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty()):
        raise FileExistsError(f"{path} holds something else")
    return False


def report(df: DataFrame) -> DataFrame:
    """One JSON line a row, with NaN and infinity as null."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table of a small result."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
