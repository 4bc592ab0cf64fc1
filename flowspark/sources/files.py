"""Files seen through Hadoop: listing, moving, headers, and tables by format."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import uuid
from collections.abc import Iterable, Sequence
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.expr import HEADER_ALIASES, quoted, strip
from flowspark.session import local_table

FORMATS = ("csv", "parquet")
OPEN_FILES = 32  # headers and footers read at a time
HEADER_BYTES = 16 << 20  # longest header line
RANGE_ROWS = 1 << 19  # that a task sorts before it writes them


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target)


def rename(spark: SparkSession, source: str, destination: str) -> None:
    fs, origin = _hadoop(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(destination)
    fs.mkdirs(goal.getParent())
    if not fs.rename(origin, goal):
        raise OSError(f"Could not move {source} to {destination}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _hadoop(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path, size, modification time) of the plain files with a suffix, by name."""
    fs, target = _hadoop(spark, folder)
    if not fs.exists(target):
        return []
    found = [
        (s.getPath().toString(), s.getLen(), s.getModificationTime())
        for s in fs.listStatus(target)
        if s.isFile() and s.getPath().getName().lower().endswith(suffix)
    ]
    return sorted(found)


def base_name(path: str) -> str:
    return posixpath.basename(path.rstrip("/"))


def stem(path: str) -> str:
    return posixpath.splitext(base_name(path))[0]


def free_name(spark: SparkSession, folder: str, name: str) -> str:
    """A path in ``folder`` that does not replace an earlier file."""
    root, ending = posixpath.splitext(name)
    candidate, number = f"{folder.rstrip('/')}/{name}", 0
    while exists(spark, candidate):
        number += 1
        candidate = f"{folder.rstrip('/')}/{root}_{number}{ending}"
    return candidate


def load_data(spark: SparkSession, path: str, format: str | None = None, schema=None) -> DataFrame:
    """Read a CSV or Parquet table; the format comes from the suffix.

    Without a schema a CSV is scanned once more to infer its types, as an
    exploration tool needs; pipelines pass a schema or use ``flowcsv``.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"There is nothing to load at {path}.")
    kind = (format or posixpath.splitext(path)[1].lstrip(".")).lower()
    if kind not in FORMATS:
        raise ValueError(f"Files of the kind {kind!r} are not read.")
    reader = spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.format(kind).load(path)
    except (PySparkException, Py4JJavaError) as error:
        raise OSError(f"{path} does not open as {kind}: {error}") from error


def refuse_existing(spark: SparkSession, paths: Iterable[str], overwrite: bool = False) -> None:
    """Stop before any work when an output is already there."""
    taken = [p for p in paths if exists(spark, p)]
    if taken and not overwrite:
        raise FileExistsError(f"Already there, and not to be replaced: {', '.join(taken)}")


def save_data(
    df: DataFrame, path: str, format: str = "csv", overwrite: bool = False, partition_by: Sequence[str] = ()
) -> str:
    """Write beside the destination, then put the finished table in its place.

    A failure leaves an earlier result untouched and removes the unfinished one.
    """
    kind = format.lower()
    if kind not in FORMATS:
        raise ValueError(f"Files of the kind {format!r} are not written.")
    spark = df.sparkSession
    refuse_existing(spark, [path], overwrite)
    with StagedOutput(spark, path) as staging:
        writer = df.write.format(kind)
        if kind == "csv":
            writer = writer.option("header", True)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(staging)
    return path


class StagedOutput:
    """Context that hands out a staging path and publishes it when all went well."""

    def __init__(self, spark: SparkSession, destination: str):
        folder, name = posixpath.split(destination.rstrip("/"))
        self.spark = spark
        self.destination = destination.rstrip("/")
        self.staging = f"{folder}/.{name}.{uuid.uuid4().hex}.partial"

    def __enter__(self) -> str:
        return self.staging

    def __exit__(self, kind, error, trace) -> bool:
        if kind is not None:
            delete(self.spark, self.staging)
            return False
        previous = f"{self.staging}.previous"
        replaced = exists(self.spark, self.destination)
        if replaced:
            rename(self.spark, self.destination, previous)
        try:
            rename(self.spark, self.staging, self.destination)
        except Exception:
            if replaced:
                rename(self.spark, previous, self.destination)
            delete(self.spark, self.staging)
            raise
        if replaced:
            delete(self.spark, previous)
        return False


def _read_each(paths: Sequence[str], read) -> list:
    """``read`` of every path, in order, a bounded number of files open at a time."""
    if not paths:
        return []
    with ThreadPool(min(OPEN_FILES, len(paths))) as pool:
        return pool.map(read, paths, chunksize=1)


def _first_line(spark: SparkSession, path: str) -> str:
    """First line of a text file, decompressed as its suffix says.

    The file is opened by the file system that Hadoop has for its scheme, with the
    session's credentials, and closed after one buffer or as many as the line needs.
    """
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    try:
        fs, target = _hadoop(spark, path)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings).getCodec(target)
        stream = fs.open(target)
        try:
            plain = stream if codec is None else codec.createInputStream(stream)
            line = jvm.org.apache.hadoop.io.Text()
            jvm.org.apache.hadoop.util.LineReader(plain, 1 << 16).readLine(line, HEADER_BYTES, HEADER_BYTES)
        finally:
            stream.close()
    except Py4JJavaError as error:
        raise OSError(f"The header of {path} cannot be read: {error.java_exception}") from error
    if line.getLength() >= HEADER_BYTES:
        raise ValueError(f"The first line of {path} does not end within {HEADER_BYTES} bytes.")
    return line.toString().removeprefix("\ufeff")


def number_repeats(names: Sequence[str]) -> list[str]:
    """Repeated spellings become name.1, name.2, ... so that each column can be named.

    Only equal spellings are told apart; names that become equal by normalisation
    stay in conflict.
    """
    taken, result = set(names), []
    seen: set[str] = set()
    for name in names:
        fresh, number = name, 0
        while fresh in seen or (number and fresh in taken):
            number += 1
            fresh = f"{name}.{number}"
        seen.add(fresh)
        result.append(fresh)
    return result


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, columns) from the first line of each file; an empty file has no columns."""
    lines = _read_each(paths, lambda path: _first_line(spark, path))
    parsed = {line: number_repeats(next(csv.reader(io.StringIO(line)), [])) for line in set(lines)}
    rows = [(path, parsed[line]) for path, line in zip(paths, lines)]
    return local_table(spark, rows, "path string, columns array<string>")


def parquet_schema(spark: SparkSession, path: str):
    """The schema in a Parquet file's footer; the row groups that it lists are not looked at."""
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    parquet = jvm.org.apache.parquet
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        source = parquet.hadoop.util.HadoopInputFile.fromPath(target, settings)
        no_groups = parquet.format.converter.ParquetMetadataConverter.SKIP_ROW_GROUPS
        options = parquet.HadoopReadOptions.builder(settings).withMetadataFilter(no_groups).build()
        reader = parquet.hadoop.ParquetFileReader.open(source, options)
        try:
            return reader.getFileMetaData().getSchema()
        finally:
            reader.close()
    except Py4JJavaError as error:
        raise OSError(f"The footer of {path} cannot be read: {error.java_exception}") from error


def schema_groups(spark: SparkSession, paths: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, paths) of the Parquet files with equal columns, by first path."""

    def described(path: str) -> tuple[str, object]:
        schema = parquet_schema(spark, path)
        # The first line names the writer's message, not a column.
        return schema.toString().split("\n", 1)[1], schema

    groups: dict[str, tuple[list[str], list[str]]] = {}
    for path, (kind, schema) in zip(paths, _read_each(paths, described)):
        if kind not in groups:
            groups[kind] = ([field.getName() for field in schema.getFields()], [])
        groups[kind][1].append(path)
    return list(groups.values())


def normalised_columns(columns="columns"):
    """Trimmed, alias-resolved header names of an array column."""
    aliases = F.create_map(*[F.lit(x) for pair in HEADER_ALIASES.items() for x in pair])
    source = columns if isinstance(columns, Column) else F.col(columns)
    return F.transform(source, lambda c: F.coalesce(F.try_element_at(aliases, strip(c)), strip(c)))


def inspect_headers(headers: DataFrame, required: Sequence[str]) -> DataFrame:
    """Header-only compatibility report, one row per file."""
    names = F.col("names")
    needed = F.array(*[F.lit(r) for r in required]).cast("array<string>")
    missing = F.array_sort(F.array_except(needed, names))
    repeated = F.array_sort(
        F.filter(F.array_distinct(names), lambda c: F.size(F.filter(names, lambda d: d == c)) > 1)
    )
    found = headers.withColumn("names", normalised_columns()).select(
        F.col("path").alias("file"),
        F.size(names).alias("columns_found"),
        F.exists(names, lambda c: F.lower(c) == "label").alias("label_column_present"),
        F.concat_ws("; ", missing).alias("missing_required_features"),
        F.size(missing).alias("missing_feature_count"),
        F.concat_ws("; ", repeated).alias("duplicate_normalized_columns"),
    )
    return found.withColumn(
        "schema_compatible",
        F.col("label_column_present")
        & (F.col("missing_feature_count") == 0)
        & (F.col("duplicate_normalized_columns") == ""),
    )


def preflight_folder(spark: SparkSession, folder: str, required: Sequence[str]) -> DataFrame:
    """Header report for every CSV of a folder."""
    files = [p for p, _, _ in list_files(spark, folder, ".csv")]
    if not files:
        raise FileNotFoundError(f"The folder {folder} holds no CSV file.")
    return inspect_headers(csv_headers(spark, files), required)


def preflight_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("files_inspected"), F.every("schema_compatible").alias("all_files_schema_compatible")
    )


def write_preflight(spark: SparkSession, folder: str, required: Sequence[str], output: str) -> DataFrame:
    """Header report of a folder as a CSV table and a JSON summary."""
    report = preflight_folder(spark, folder, required)
    save_data(report, f"{output}/schema_preflight", "csv")
    summary = preflight_summary(report).first().asDict()
    summary["required_features"] = list(required)
    write_text(spark, f"{output}/schema_preflight.json", json.dumps(summary, indent=2))
    return report


def plain_name(encoded: Column) -> Column:
    """A path or name of the file metadata, which escapes blanks and the like, as it is listed."""
    return F.url_decode(F.regexp_replace(encoded, r"\+", "%2B"))


def attack_name():
    """File name up to its first underscore or its suffix."""
    name = F.regexp_replace(plain_name(F.col("_metadata.file_name")), r"\.[^.]*$", "")
    return F.substring_index(name, "_", 1)


def place_in_folder() -> Column:
    """Name of the Parquet file and position in it: the same however files are cut into tasks, sorted as stored."""
    position = F.lpad(F.col("_metadata.row_index").cast("string"), 19, "0")
    return F.concat(plain_name(F.col("_metadata.file_name")), F.lit(":"), position)


def union_files(
    spark: SparkSession, folder: str, source_column: str | None = None, place_column: str | None = None
) -> DataFrame:
    """All Parquet files of ``folder/raw`` (else of ``folder``) combined by column name.

    Files without a label column take the attack name from their file name.
    ``source_column`` notes that name, ``place_column`` each row's file and position.  Files
    are read together per distinct schema, so there is one scan per schema, not per
    file.
    """
    raw = f"{folder.rstrip('/')}/raw"
    files = [p for p, _, _ in list_files(spark, raw if exists(spark, raw) else folder, ".parquet")]
    if not files:
        raise FileNotFoundError(f"The folder {folder} holds no Parquet file.")
    combined = None
    for names, members in schema_groups(spark, files):
        part = spark.read.parquet(*members)
        extra = {}
        if not {"Label", "label"} & set(names):
            extra["Label"] = attack_name()
        if source_column:
            extra[source_column] = attack_name()
        if place_column:
            extra[place_column] = place_in_folder()
        part = part.select(*[quoted(c) for c in names if c not in extra], *[v.alias(k) for k, v in extra.items()])
        combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    return combined
