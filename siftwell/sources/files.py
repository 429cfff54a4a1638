"""Reading collections and writing results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DISCUSSION = "number long, title string, url string, created_at string, category string, question string, answer string, answer_url string"
QUESTION = "id string, number long, title string, question string, reference_answer string, url string, gold_chunk_ids array<string>"


def scan_documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".md", ".mdx"), min_chars: int = 40) -> DataFrame:
    """(doc_path, text) of the files under a folder with one of the suffixes; bytes that are not UTF-8 are replaced; texts under
    ``min_chars`` characters are left out. The path is relative to the folder."""
    pattern = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace("path", rf"^.*?\Q{root}\E/", "")
    out = files.select(path.alias("doc_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return out.filter(F.length("text") >= min_chars)


def scan_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """An array of objects, or one object a line, under a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def scan_optional(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """As scan_json; a missing file gives no rows, so that joins leave nulls."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return scan_json(spark, path, schema)


def scan_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_traces(df: DataFrame, path: str) -> None:
    """Trace rows as JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def manifest(df: DataFrame, path: str) -> None:
    """Headline numbers and the files they come from."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """``df(path, content binary)`` as files under ``folder``, a URI or path of a file system that all executors share; gives the written
    manifest (path, n_bytes, sha256), which is under ``folder``/_manifest too. A file that is there already is not fetched or written
    again, if its size is the same. A file gets its name when it is whole, so a task that runs twice leaves one."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path!r} is not a path below the folder")
                target = f"{root.rstrip('/')}/{path}"
                there = system.get_file_info(target)
                if there.type == fs.FileType.File and there.size == len(content):
                    continue
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                if there.type == fs.FileType.File:
                    system.delete_file(target)
                system.move(part, target)
            yield batch.select(["path", "n_bytes", "sha256"])

    files = df.select("path", F.col("content").cast("binary").alias("content")).filter("path is not null and content is not null")
    facts = files.select("path", "content", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    schema = "path string, n_bytes long, sha256 string"
    facts.mapInArrow(run, schema).write.mode("overwrite").json(f"{folder.rstrip('/')}/_manifest")
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/_manifest")
