"""Sources and sinks: manifests with their frames, sealed manifests, write-once records, the append-only ledger, multipart bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "struct<id:string,split:string,annotations:array<struct<id:string,cls:string,box:struct<x:double,y:double,w:double,h:double>,visibility:string>>>"
MANIFEST = f"name string, version string, split string, samples array<{SAMPLE}>"


def read_manifest(spark: SparkSession, path: str, split: str, schema: str = MANIFEST) -> DataFrame:
    """Samples of one manifest document; any sample of another split is an error when it is read."""
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = d.select(F.col("split").alias("manifest_split"), F.explode("samples").alias("s")).select("manifest_split", "s.*")
    foreign = (F.col("split") != split) | (F.col("manifest_split") != split)
    return rows.withColumn("id", F.when(foreign, F.raise_error(F.concat(F.lit("foreign sample "), "id"))).otherwise(F.col("id"))).drop("manifest_split")


def frame_inventory(samples: DataFrame, frames: DataFrame, path_col: str = "frame") -> DataFrame:
    """Referenced and existing frames, both ways: frame, kind MISSING / UNEXPECTED / PRESENT, sha256. frames is a binaryFile table with a name column."""
    f = frames.select(F.col("name"), F.sha2("content", 256).alias("sha256"))
    j = samples.select(F.col(path_col).alias("ref")).distinct().join(f, F.col("ref") == F.col("name"), "full_outer")
    return j.select(F.coalesce("ref", "name").alias("frame"), F.when(F.col("name").isNull(), "MISSING").when(F.col("ref").isNull(), "UNEXPECTED").otherwise("PRESENT").alias("kind"), "sha256")


def sealed(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: number of rows and the hash over their JSON in order of id. For manifests, which one task holds."""
    return rows.select(F.col(id_col).alias("k"), F.to_json(F.struct(*sorted(rows.columns))).alias("j")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("k", "j")))["j"], ","), 256).alias("sha256"))


def write_once(df: DataFrame, path: str) -> None:
    """Fails if the record exists."""
    df.write.mode("errorifexists").json(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def multipart(manifest: Column) -> Column:
    """Body of a manifest-only multipart message; the boundary comes from the content's hash, null if the content holds it."""
    boundary = F.concat(F.lit("part-"), F.substring(F.sha2(manifest, 256), 1, 32))
    body = F.concat(F.lit("--"), boundary, F.lit('\r\ncontent-disposition: form-data; name="manifest"\r\ncontent-type: application/json; charset=utf-8\r\n\r\n'), manifest, F.lit("\r\n--"), boundary, F.lit("--\r\n"))
    return F.when(~F.contains(manifest, boundary), F.struct(boundary.alias("boundary"), body.alias("body")))


def parsed_multipart(body: Column, boundary: Column) -> Column:
    """The manifest text of such a body, or null if anything about it is off."""
    head = F.concat(F.lit("--"), boundary, F.lit('\r\ncontent-disposition: form-data; name="manifest"\r\ncontent-type: application/json; charset=utf-8\r\n\r\n'))
    tail = F.concat(F.lit("\r\n--"), boundary, F.lit("--\r\n"))
    ok = F.startswith(body, head) & F.endswith(body, tail) & boundary.rlike("^part-[0-9a-f]{32}$")
    inner = F.substr(body, F.length(head) + 1, F.length(body) - F.length(head) - F.length(tail))
    return F.when(ok & ~F.contains(inner, F.concat(F.lit("--"), boundary)), inner)
