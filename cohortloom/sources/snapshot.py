"""Nested snapshot records (JSON lines) to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions import text as tx
from cohortloom.functions.numeric import number, whole

RECORD_SCHEMA = """
accession string, current_accession string, paired_accession string, type_material string,
assembly_info struct<assembly_level string, assembly_name string, refseq_category string, release_date string,
  bioproject_accession string, paired_assembly struct<accession string>,
  biosample struct<accession string, strain string, host string, geo_loc_name string, isolation_source string,
    attributes array<struct<name string, value string>>, bioprojects array<struct<accession string>>>>,
assembly_stats struct<total_sequence_length string, gc_percent string, number_of_contigs string, contig_n50 string>,
average_nucleotide_identity struct<submitted_species string, taxonomy_check_status string>,
checkm_info struct<completeness string, contamination string>,
organism struct<organism_name string, tax_id string, infraspecific_names struct<strain string>>
"""


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under an explicit schema; blank lines give no row, numbers may be text."""
    return spark.read.schema(RECORD_SCHEMA).json(path).withColumn("ordinal", F.monotonically_increasing_id())


def flatten_snapshot(records: DataFrame) -> DataFrame:
    """One flat row per record; absent paths become blank text or zero."""
    info, sample, stats = "assembly_info", "assembly_info.biosample", "assembly_stats"
    accession = tx.first_nonblank("current_accession", "accession")
    paired = tx.first_nonblank("paired_accession", f"{info}.paired_assembly.accession")
    organism = tx.text("organism.organism_name")
    first_archive, other_archive = fv.ARCHIVE_NAMES
    zero = F.lit(0).cast("bigint")
    type_text = tx.text("type_material")

    def attribute(name: str):
        return tx.first_nonblank(f"{sample}.{name}", tx.attribute_value(f"{sample}.attributes", name))

    return records.select(
        "ordinal",
        accession.alias("assembly_accession"),
        paired.alias("paired_accession"),
        tx.pair_key(accession, paired, accession).alias("pair_key"),
        F.when(accession.startswith(fv.FIRST_ARCHIVE_PREFIX), F.lit(first_archive)).otherwise(F.lit(other_archive)).alias("source_database"),
        organism.alias("organism_name"),
        tx.first_nonblank("average_nucleotide_identity.submitted_species", organism).alias("reporting_species"),
        tx.text("organism.tax_id").alias("tax_id"),
        tx.first_nonblank("organism.infraspecific_names.strain", f"{sample}.strain").alias("strain"),
        tx.text(f"{sample}.accession").alias("biosample"),
        tx.first_nonblank(f"{info}.bioproject_accession", F.get(F.col(f"{sample}.bioprojects"), F.lit(0))["accession"]).alias("bioproject"),
        attribute("host").alias("host"),
        attribute("geo_loc_name").alias("geo_loc_name"),
        attribute("isolation_source").alias("isolation_source"),
        tx.text(f"{info}.assembly_level").alias("assembly_level"),
        tx.text(f"{info}.assembly_name").alias("assembly_name"),
        tx.text(f"{info}.refseq_category").alias("refseq_category"),
        tx.text(f"{info}.release_date").alias("release_date"),
        F.when(type_text.isin("", "false", "0", "{}", "[]"), F.lit("false")).otherwise(F.lit("true")).alias("type_material"),
        F.coalesce(whole(f"{stats}.total_sequence_length"), zero).alias("total_length"),
        F.coalesce(number(f"{stats}.gc_percent"), F.lit(0.0)).alias("gc_percent"),
        F.coalesce(whole(f"{stats}.number_of_contigs"), zero).alias("number_of_contigs"),
        F.coalesce(whole(f"{stats}.contig_n50"), zero).alias("contig_n50"),
        tx.text("checkm_info.completeness").alias("checkm_completeness"),
        tx.text("checkm_info.contamination").alias("checkm_contamination"),
        tx.text("average_nucleotide_identity.taxonomy_check_status").alias("taxonomy_check_status"),
    )
