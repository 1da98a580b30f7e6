"""Sequence, read-pair, alignment and evidence text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.text import first_token, mate_key
from cohortloom.operators.joins import mate_verdict
from cohortloom.operators.skew import carry_before
from cohortloom.session import cut_lineage
from cohortloom.sources.read_records import numbered_records
from cohortloom.sources.tables import with_path


def read_fasta(spark: SparkSession, path: str, whole_name: bool = False) -> DataFrame:
    """(file_path, ordinal, name, seq): one row per record; the name is the header or its first token.

    Records are split by the reader on the record mark, so a large file is read by many tasks.
    """
    raw = with_path(spark.read.option("lineSep", "\n>").text(path)).withColumn("ordinal", F.monotonically_increasing_id())
    body = F.regexp_replace("value", r"^\s*>", "")
    header = F.rtrim(F.regexp_extract(body, r"^([^\n]*)", 1))
    sequence = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*", ""), r"\s", "")
    name = header if whole_name else first_token(header)
    return raw.filter(F.trim("value") != "").select("file_path", "ordinal", name.alias("name"), sequence.alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line_no, value) with dense 0-based line numbers inside each file.

    Lines get reader ids (growing inside a read split); split sizes are then cumulated per file. One
    row per split is ranked, never the lines. The read is checkpointed so that ids stay fixed.
    """
    lines = with_path(spark.read.text(path)).select(
        "file_path", "value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    lines = cut_lineage(lines)
    splits = lines.groupBy("file_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    offsets = carry_before(splits, ["file_path"], "_block", {"_before": ("sum", "_n")}).join(
        splits.select("file_path", "_block", "_first"), ["file_path", "_block"]
    )
    return lines.join(offsets, ["file_path", "_block"]).select(
        "file_path", (F.col("_id") - F.col("_first") + F.coalesce("_before", F.lit(0).cast("bigint"))).alias("line_no"), "value"
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, position, header, seq, qual): 4-line records by 0-based position.

    Large plain files are read by many tasks (``read_records``). A file whose lines do not form whole records is an error. Compressed files are read by one
    task each, so conversion is parallel over files; store the result as parquet and read that.
    """
    return numbered_records(spark, path)


def count_records(fastq: DataFrame) -> DataFrame:
    return fastq.groupBy("file_path").agg(F.count("header").alias("records"))


def paired_reads(first: DataFrame, second: DataFrame, sample: str) -> DataFrame:
    """(sample, position, key, mates): mates of one position must share a key; otherwise an error."""
    a = first.withColumn("key", mate_key(F.regexp_replace("header", "^@", "")))
    b = second.withColumn("key", mate_key(F.regexp_replace("header", "^@", "")))
    keys, fields = [sample, "position"], ["key", "header", "seq", "qual"]
    joined = a.select(*keys, *[F.col(f).alias(f"{f}_1") for f in fields]).join(
        b.select(*keys, *[F.col(f).alias(f"{f}_2") for f in fields]), keys, "full_outer"
    )
    verdict = mate_verdict(F.col("key_1"), F.col("key_2"))
    checked = F.when(verdict == "paired", F.col("key_1")).otherwise(
        F.raise_error(F.concat(verdict, F.lit(" at record "), F.col("position")))
    )
    return joined.select(*keys, checked.alias("key"), *[f"{f}_{i}" for f in fields[1:] for i in (1, 2)])


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of at least 12 fields; shorter rows are ignored."""
    fields = F.split(F.rtrim("value"), "\t")
    rows = with_path(spark.read.text(path)).withColumn("_f", fields).filter(F.size("_f") >= 12)
    whole = {"qlen": 1, "qstart": 2, "qend": 3, "nmatch": 9, "block": 10}
    return rows.select(
        "file_path",
        F.monotonically_increasing_id().alias("ordinal"),
        F.col("_f")[0].alias("qname"),
        F.col("_f")[5].alias("target"),
        *[F.col("_f")[i].cast("bigint").alias(n) for n, i in whole.items()],
    )


def evidence_fields(lines: DataFrame) -> DataFrame:
    """(contig, pos, ref, depth, pile) from evidence text; rows under 5 fields after right-strip are ignored."""
    fields = F.split(F.rtrim(F.col("value")), "\t")
    rows = lines.withColumn("_f", F.transform(fields, lambda x: x)).filter(F.size("_f") >= 5)
    kept = [c for c in lines.columns if c != "value"]
    return rows.select(
        *kept,
        F.col("_f")[0].alias("contig"),
        F.col("_f")[1].try_cast("bigint").alias("pos"),
        F.col("_f")[2].alias("ref"),
        F.col("_f")[3].try_cast("bigint").alias("depth"),
        F.col("_f")[4].alias("pile"),
    )


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return evidence_fields(with_path(spark.read.text(path)))


def read_tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of rooted trees from parquet."""
    schema = "panel string, node string, parent string, branch_length double, support double, is_tip boolean"
    return spark.read.schema(schema).parquet(path)
