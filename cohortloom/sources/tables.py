"""Delimited tables: text-first readers with explicit schemas, one-row metric files, path columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortloom.functions.text import blank_missing
from cohortloom.operators import checks
from cohortloom.sources import digests


def text_schema(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def _plain(reader, header: bool):
    return (
        reader.option("sep", "\t")
        .option("header", str(header).lower())
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("enforceSchema", "true")
    )


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of a headered table: one line of one file reaches the driver."""
    first = spark.read.text(path).limit(1).first()
    return [] if first is None else first.value.split("\t")


def read_text_table(
    spark: SparkSession, path: str, names: list[str] | None = None, missing_to_blank: bool = False
) -> DataFrame:
    """Headered TSV, every column text; blanks stay ''. ``missing_to_blank`` also blanks NA tokens."""
    names = names or header_names(spark, path)
    df = _plain(spark.read, True).schema(text_schema(names)).csv(path).na.fill("")
    return df.select(*[blank_missing(f"`{n}`").alias(n) for n in names]) if missing_to_blank else df


def read_headerless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Headerless TSV with given names, every column text."""
    return _plain(spark.read, False).schema(text_schema(names)).csv(path)


def read_typed_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headered TSV under an explicit schema; never inferred."""
    return _plain(spark.read, True).schema(schema).csv(path)


def with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def read_one_row_files(spark: SparkSession, path: str, names: list[str], verify: bool = True) -> DataFrame:
    """Many one-row metric files at once, with ``file_path``. A file with another row count is an error."""
    df = with_path(_plain(spark.read, True).schema(text_schema(names)).csv(path))
    if verify:
        per_file = df.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
        checks.require(checks.violations(per_file, F.col("n") == 1, "one row per metric file"))
    return df


def read_metric_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file_path, condition, names) of the one-row files below a folder, each named by its condition and read once.

    A file with several rows is an error that the result raises. The folder is listed as one tree, not path by path.
    """
    reader = _plain(spark.read, True).schema(text_schema(names)).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv")
    counted = with_path(reader.csv(path)).groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"), *[F.first(n).alias(n) for n in names])
    several = F.raise_error(F.concat(F.lit("one row per metric file: "), F.col("file_path"))).cast("string")
    stem = F.regexp_extract("file_path", r"([^/]+)\.tsv$", 1)
    # the name was encoded on writing, and the path of a file is given as a URI
    condition = F.url_decode(F.url_decode(stem))
    return counted.select("file_path", F.when(F.col("_n") == 1, condition).otherwise(several).alias("condition"), *names)


def path_columns(df: DataFrame, pattern: str, names: list[str], path: str = "file_path") -> DataFrame:
    """Columns from the groups of a pattern found in the path; a path that does not match is an error."""
    p = F.col(path)
    ok = p.rlike(pattern)

    def group(i: int) -> Column:
        return F.when(ok, F.regexp_extract(p, pattern, i)).otherwise(F.raise_error(F.concat(F.lit("unexpected file name: "), p)))

    return df.withColumns({n: group(i + 1) for i, n in enumerate(names)})


def file_stem(path: Column) -> Column:
    """Last path part without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def sample_and_route(path: Column, routes: list[str]) -> tuple[Column, Column]:
    """(sample, route) of a '<sample>_<route>' file name; an unknown route is an error."""
    stem = file_stem(path)
    route = F.regexp_extract(stem, r"_([^_]+)$", 1)
    return (
        F.regexp_replace(stem, r"_[^_]+$", ""),
        F.when(route.isin(*routes), route).otherwise(F.raise_error(F.concat(F.lit("unknown route: "), path))),
    )


def read_identity_rows(spark: SparkSession, path: str) -> DataFrame:
    """Pairwise identity rows: query, reference, ani, fraction = matched / total. Under 5 fields is an error."""
    fields = F.split(F.rtrim(F.col("value")), "\t")
    rows = with_path(spark.read.text(path)).filter(F.trim("value") != "").withColumn("_f", fields)
    checked = F.when(F.size("_f") >= 5, F.col("_f")).otherwise(
        F.raise_error(F.concat(F.lit("malformed identity row in "), F.col("file_path"))).cast("array<string>")
    )
    rows = rows.withColumn("_f", checked)
    return rows.select(
        "file_path",
        F.col("_f")[0].alias("query"),
        F.col("_f")[1].alias("reference"),
        F.col("_f")[2].cast("double").alias("ani"),
        F.try_divide(F.col("_f")[3].cast("double"), F.col("_f")[4].cast("double")).alias("fraction"),
    )


def read_log_number(spark: SparkSession, path: str, pattern: str, name: str) -> DataFrame:
    """One number per log file by pattern; a log without it is an error. Lines are scanned in parallel."""
    lines = with_path(spark.read.text(path))
    found = lines.select(
        "file_path", F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast("double").alias("_v"),
        F.monotonically_increasing_id().alias("_line"),
    )
    per_file = found.groupBy("file_path").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_line"))).alias(name))
    value = F.when(F.col(name).isNotNull(), F.col(name)).otherwise(
        F.raise_error(F.concat(F.lit("number not found in "), F.col("file_path"))).cast("double")
    )
    return per_file.select("file_path", value.alias(name))


def file_manifest(spark: SparkSession, path: str, expected: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(file_name, path, size_bytes, md5, sha256) of every file under a folder, of any size.

    Each file is one partition and is hashed in pieces. A name in ``expected`` (file_name) without a file is an error that the
    result raises when its row is read; files that are not expected are listed all the same.
    """
    digests.register(spark)
    manifest = spark.read.format(digests.FORMAT).option("suffix", suffix).load(path)
    if expected is None:
        return manifest
    wanted = expected.select("file_name").distinct().withColumn("_wanted", F.lit(True))
    joined = manifest.join(wanted, "file_name", "full_outer")
    missing = F.raise_error(F.concat(F.lit("every expected file exists: "), F.coalesce("file_name", F.lit("null"))))
    return joined.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).otherwise(missing.cast("string"))).drop("_wanted")


def record_manifest(df: DataFrame, key: str, content: str, name: Column) -> DataFrame:
    """Name, size, MD5 and SHA-256 of the content of every row; an absent content counts as empty."""
    body = F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))
    return df.select(
        key, name.alias("file_name"), F.octet_length(body).cast("bigint").alias("size_bytes"), F.md5(body).alias("md5"), F.sha2(body, 256).alias("sha256")
    )
