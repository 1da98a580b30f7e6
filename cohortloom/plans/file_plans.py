"""Round trips through files that Spark writes from the tables, in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import text as tx
from cohortloom.functions.numeric import number, whole
from cohortloom.operators import checks, evidence, joins
from cohortloom.plans.evidence_plans import _BURDEN_COLUMNS, _PILE_BURDEN_SQL, _pile_rows, _rounded
from cohortloom.plans.registry import Tables, query
from cohortloom.plans.selection_plans import snapshot_selection
from cohortloom.session import ensure_checkpoint_dir
from cohortloom.sources import records, sinks, snapshot, tables
from cohortloom.streaming import burden, state


def _folder(df: DataFrame, name: str) -> tuple[SparkSession, str]:
    """A new folder under the shared checkpoint folder."""
    spark = df.sparkSession
    return spark, f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


@query(
    "table_round_trip",
    """select c_custkey, c_name, c_mktsegment, case when c_acctbal >= 0 then c_acctbal end as balance, case when c_acctbal < 0 then '' else 'ok' end as note from customer""",
)
def table_round_trip(t: Tables) -> DataFrame:
    """Write a headered table and read it back as text; blanks and NA tokens are blank, numbers cast at use."""
    rows = t.customer.withColumns(
        {"balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "note": F.when(F.col("c_acctbal") < 0, F.lit("NA")).otherwise(F.lit("ok"))}
    )
    spark, path = _folder(rows, "customer")
    names = ["c_custkey", "c_name", "c_mktsegment", "balance", "note"]
    sinks.write_tsv(rows, path, names)
    back = tables.read_text_table(spark, path, names, missing_to_blank=True)
    return back.select(whole("c_custkey").alias("c_custkey"), "c_name", "c_mktsegment", number("balance").alias("balance"), "note")


@query(
    "headerless_round_trip",
    "select p_brand as cluster_id, 'part' || p_partkey as sequence_id, p_size::bigint as size from part",
)
def headerless_round_trip(t: Tables) -> DataFrame:
    """Headerless cluster map joined to a typed table; every member must be known."""
    pairs = t.part.select("p_brand", F.concat(F.lit("part"), "p_partkey"), "p_size", "p_partkey")
    spark, path = _folder(pairs, "clusters")
    pairs.select(pairs.columns[:2]).write.option("sep", "\t").csv(path)
    typed_path = f"{path}-sizes"
    sizes = t.part.select(F.concat(F.lit("part"), "p_partkey").alias("sequence_id"), F.col("p_size").alias("size"))
    sinks.write_tsv(sizes, typed_path)
    clusters = tables.read_headerless(spark, path, ["cluster_id", "sequence_id"])
    typed = tables.read_typed_table(spark, typed_path, "sequence_id string, size bigint")
    checks.require(checks.no_unmatched(clusters, typed, ["sequence_id"], "cluster members known"))
    return clusters.join(typed, "sequence_id").select("cluster_id", "sequence_id", "size")


@query(
    "metric_files",
    """select s_suppkey::varchar as sample, n_name as route, s_acctbal as value from supplier join nation on n_nationkey = s_nationkey""",
)
def metric_files(t: Tables) -> DataFrame:
    """One-row metric files named by condition; the names become columns again."""
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = t.supplier.join(nation, "s_nationkey").select(
        F.concat_ws("__", F.col("s_suppkey"), F.col("n_name")).alias("condition"), F.col("s_acctbal").cast("string").alias("value")
    )
    spark, path = _folder(rows, "metrics")
    sinks.write_metric_files(rows, path, "condition", "value")
    read = tables.read_metric_files(spark, path, ["value"])
    named = tables.path_columns(read, r"^(.+?)__(.+)$", ["sample", "route"], path="condition")
    return named.select("sample", "route", number("value").alias("value"))


_SNAPSHOT_SQL = """
with r as (select doc_id, case when doc_id % 2 = 0 then 'GCF_' else 'GCA_' end || (doc_id // 2) as acc, case when doc_id % 2 = 0 then 'GCA_' else 'GCF_' end || (doc_id // 2) as other,
    'SAMN' || (doc_id // 6) as sample, 3500000 + n_chars * 400 as len, 65.0 + (doc_id * 7 % 70) / 10.0 as gc, (n_chars % 1200)::bigint as contigs, 15000 + doc_id * 13 % 90000 as n50,
    80 + doc_id % 21 as comp, doc_id % 7 as cont, lang from documents),
d as (select *, concat_ws(';', case when not (len between 4000000 and 7500000) then 'genome_size' end, case when not (gc between 66.0 and 71.0) then 'gc' end,
    case when contigs > 1000 then 'contigs' end, case when n50 < 20000 then 'n50' end, case when comp < 90 then 'checkm_completeness' end, case when cont > 5 then 'checkm_contamination' end) as reasons,
   round(case when doc_id % 2 = 0 then 100.0::double else 0.0::double end + case lang when 'en' then 25.0::double when 'fr' then 10.0::double else 0.0::double end
      + comp - 2.0::double * cont + least(20.0::double, log10(n50::double) * 3.0::double), 6) as score, 'GCA_' || (doc_id // 2) || '|GCF_' || (doc_id // 2) as pk from r),
q as (select *, row_number() over (partition by pk order by score desc, doc_id) as rn, min(doc_id) over (partition by pk) as pf from d where reasons = ''),
p as (select * from q where rn = 1),
e as (select *, row_number() over (partition by sample order by score desc, pf) as rn2 from p)
select d.acc as assembly_accession, d.pk as pair_key, d.sample as biosample, d.score as selection_score, d.reasons as qc_failure_reasons,
  case when d.reasons <> '' then 'excluded_qc' when d.acc <> p.acc then 'excluded_paired_accession_dedup' when d.acc <> e.acc then 'excluded_biosample_dedup' else 'selected_qc_first' end as selection_decision,
  case d.lang when 'de' then 'Mycobacterium chimaera legacy subgroup' when 'en' then 'Mycobacterium avium subsp. hominissuis' else 'Mycobacterium avium' end as fine_label
from d left join p on p.pk = d.pk left join (select * from e where rn2 = 1) e on e.sample = d.sample
"""


@query("snapshot_selection", _SNAPSHOT_SQL)
def snapshot_round_trip(t: Tables) -> DataFrame:
    """Nested JSON lines to flat, scored, flagged and selected records."""
    i, n = F.col("doc_id"), F.col("n_chars")
    accession = lambda even, odd: F.concat(F.when(i % 2 == 0, F.lit(even)).otherwise(F.lit(odd)), F.floor(i / 2))
    level = F.when(F.col("lang") == "en", F.lit("Complete Genome")).when(F.col("lang") == "fr", F.lit("Scaffold")).otherwise(F.lit("other"))
    organism = F.when(F.col("lang") == "de", F.lit("M. Chimaera x")).when(F.col("lang") == "en", F.lit("avium subsp. Hominissuis")).otherwise(F.lit(""))
    nested = t.documents.select(
        accession("GCF_", "GCA_").alias("accession"),
        F.struct(
            level.alias("assembly_level"), F.struct(accession("GCA_", "GCF_").alias("accession")).alias("paired_assembly"),
            F.struct(F.concat(F.lit("SAMN"), F.floor(i / 6)).alias("accession")).alias("biosample"),
        ).alias("assembly_info"),
        F.struct(
            (n * 400 + 3500000).cast("string").alias("total_sequence_length"), (F.lit(65.0) + (i * 7 % 70) / 10.0).alias("gc_percent"),
            (n % 1200).alias("number_of_contigs"), (i * 13 % 90000 + 15000).alias("contig_n50"),
        ).alias("assembly_stats"),
        F.struct(F.lit("Mycobacterium avium").alias("submitted_species")).alias("average_nucleotide_identity"),
        F.struct((i % 21 + 80).alias("completeness"), (i % 7).alias("contamination")).alias("checkm_info"),
        F.struct(organism.alias("organism_name")).alias("organism"),
    )
    spark, path = _folder(nested, "snapshot")
    nested.write.json(path)
    ledger = snapshot_selection(snapshot.flatten_snapshot(snapshot.read_snapshot(spark, path)))
    return ledger.select(
        "assembly_accession", "pair_key", "biosample", "selection_score", "qc_failure_reasons", "fine_label",
        F.col("selection_decision"),
    )


@query(
    "fasta_stats",
    r"""with s as (select source, doc_id, regexp_replace(text, '\s', '', 'g') as seq from documents),
    l as (select source, doc_id, length(seq)::bigint as len, length(regexp_replace(seq, '[^GgCc]', '', 'g'))::bigint as gc from s where length(seq) >= 500),
    r as (select source, len, sum(len) over (partition by source order by len desc, doc_id rows unbounded preceding) as run, sum(len) over (partition by source) as tot from l),
    n as (select source, max(len) as n50 from r where run * 2 >= tot group by source)
    select l.source as sample, sum(len)::bigint as total_length, count(*) as records, max(len) as longest, n.n50, round(100.0::double * sum(gc)::double / sum(len)::double, 6) as gc_percent
    from l join n using (source) group by l.source, n.n50""",
)
def fasta_stats(t: Tables) -> DataFrame:
    """Whole texts written as wrapped sequence records, read back and summarised per sample."""
    ids = t.documents.select(
        F.concat_ws(":", "source", "doc_id").alias("name"), F.col("doc_id").alias("ordinal"), F.regexp_replace("text", r"\s", "").alias("seq")
    )
    spark, path = _folder(ids, "fasta")
    sinks.write_fasta(ids.select("name", "ordinal"), ids.select("name", "seq"), path)
    read = records.read_fasta(spark, path).withColumn("sample", F.substring_index("name", ":", 1))
    return evidence.sequence_stats(read, ["sample"], "seq", min_length=500).withColumn("gc_percent", F.round("gc_percent", 6))


@query(
    "read_pairs",
    "select 'doc' || doc_id as key, length(md5(text)) + doc_id % 9 as seq_length, n_chars as second_length from documents",
)
def read_pairs(t: Tables) -> DataFrame:
    """Four-line records of two mates, numbered per file, paired by position and key, stored as parquet."""
    rows = t.documents.select("doc_id", "n_chars", F.md5("text").alias("hash"))
    spark, path = _folder(rows, "reads")
    placed = rows.repartition(4, "doc_id").sortWithinPartitions("doc_id")
    for mate in (1, 2):
        sequence = F.concat("hash", F.expr("repeat('A', cast(doc_id % 9 as int))")) if mate == 1 else F.col("n_chars").cast("string")
        record = F.concat(F.format_string(f"@doc%d/{mate} x", "doc_id"), F.lit("\n"), sequence, F.lit("\n+\n"), F.lit("I"))
        placed.select(record.alias("value")).write.option("compression", "gzip").text(f"{path}/{mate}")

    def mate_of(n: int) -> DataFrame:
        return records.read_fastq(spark, f"{path}/{n}").withColumn("sample", F.regexp_extract("file_path", r"part-(\d+)", 1))

    sinks.write_pairs(records.paired_reads(mate_of(1), mate_of(2), "sample"), f"{path}/pairs")
    pairs = spark.read.parquet(f"{path}/pairs")
    return pairs.select("key", F.length("seq_1").cast("bigint").alias("seq_length"), F.col("seq_2").cast("bigint").alias("second_length"))


@query(
    "first_pairs",
    """select doc_id as position, 'doc' || doc_id as first_key, 'doc' || doc_id as second_key from documents order by doc_id limit 150""",
)
def first_pairs(t: Tables) -> DataFrame:
    """The first 150 record pairs of two mate lists by position, cut by counts and not by a sort."""

    def mate(n: int) -> DataFrame:
        return t.documents.select(F.col("doc_id").alias("position"), tx.mate_key(F.format_string(f"doc%d/{n} extra", "doc_id")).alias("key"))

    return joins.first_pairs(mate(1), mate(2), "position", "key", 150)


@query(
    "pair_text_files",
    """select lang as sample, 'doc' || doc_id as key, 32 + doc_id % 9 as seq_length, n_chars as second_length from documents""",
)
def pair_text_files(t: Tables) -> DataFrame:
    """Record pairs written as compressed text per sample and mate, then read back record by record and paired again."""
    hashed = F.concat(F.md5(F.coalesce("text", F.lit(""))), F.expr("repeat('A', cast(doc_id % 9 as int))"))
    pairs = t.documents.select(
        F.col("lang").alias("sample"), F.col("doc_id").alias("position"), F.format_string("doc%d/1 x", "doc_id").alias("header_1"), hashed.alias("seq_1"),
        F.lit("I").alias("qual_1"), F.format_string("doc%d/2 x", "doc_id").alias("header_2"), F.col("n_chars").cast("string").alias("seq_2"), F.lit("J").alias("qual_2"),
    )
    spark, path = _folder(pairs, "pairs")
    sinks.write_pair_text(pairs, path)

    def mate_of(n: int) -> DataFrame:
        part = F.concat_ws("/", F.regexp_extract("file_path", r"sample=([^/]+)/", 1), F.regexp_extract("file_path", r"part-(\d+)", 1))
        return records.read_fastq(spark, f"{path}/{n}/sample=*").withColumn("place", part)

    back = records.paired_reads(mate_of(1), mate_of(2), "place")
    return back.select(
        F.substring_index("place", "/", 1).alias("sample"), "key", F.length("seq_1").cast("bigint").alias("seq_length"), F.col("seq_2").cast("bigint").alias("second_length")
    )


def _evidence_lines(t: Tables) -> DataFrame:
    return _pile_rows(t).select(
        F.concat_ws("\t", F.concat_ws("/", "l_suppkey", "l_linestatus"), "l_orderkey", "ref", "q", "pile", F.lit("*")).alias("value")
    )


def _keyed(lines: DataFrame) -> DataFrame:
    """Sample and route of an evidence line are the parts of its container name."""
    place = F.split(F.substring_index("value", "\t", 1), "/")
    return lines.select("value", place[0].cast("bigint").alias("sample"), place[1].alias("route"))


@query("evidence_file", _PILE_BURDEN_SQL + f"select sample, route, {_BURDEN_COLUMNS} from burdens")
def evidence_file(t: Tables) -> DataFrame:
    """Evidence text files to burden rows."""
    lines = _evidence_lines(t)
    spark, path = _folder(lines, "evidence")
    lines.write.text(path)
    decoded = evidence.decode_rows(records.evidence_fields(_keyed(spark.read.text(path))))
    return _rounded(evidence.mixture_burden(decoded, ["sample", "route"]))


@query("evidence_stream", _PILE_BURDEN_SQL + f"select sample, route, {_BURDEN_COLUMNS} from burdens")
def evidence_stream(t: Tables) -> DataFrame:
    """The same burden from a stream of evidence files; the stream keeps only the depth profile."""
    lines = _evidence_lines(t)
    spark, path = _folder(lines, "stream")
    lines.write.text(f"{path}/in")
    keys = ["sample", "route"]
    profile = burden.stream_profile(_keyed(spark.readStream.text(f"{path}/in")), keys)
    burden.run_profile(profile, f"{path}/profile", f"{path}/state").awaitTermination()
    return _rounded(burden.burden_of_stored_profile(spark.read.parquet(f"{path}/profile"), keys))


@query("evidence_state", _PILE_BURDEN_SQL + f"select sample, route, {_BURDEN_COLUMNS} from burdens")
def evidence_state(t: Tables) -> DataFrame:
    """The same burden and median kept as state while the files arrive in two runs of one stream."""
    lines = _evidence_lines(t)
    spark, path = _folder(lines, "state")
    keys, store = ["sample", "route"], "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, state.STATE_STORE)
    try:
        for half in (0, 1):
            lines.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == half).write.mode("append").text(f"{path}/in")
            stream = state.stream_burden(_keyed(spark.readStream.text(f"{path}/in")), keys)
            state.run_burden(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(store, before)
    return _rounded(state.latest(spark.read.parquet(f"{path}/out"), keys))


@query(
    "identity_and_logs",
    """select n_name as sample, (n_nationkey + 90.5)::double as ani, round((n_nationkey + 1) / 30.0::double, 6) as fraction, (n_regionkey * 10 + 0.25)::double as rate from nation""",
)
def identity_and_logs(t: Tables) -> DataFrame:
    """Pairwise identity rows and one number per log file, matched by sample name."""
    nation = t.nation
    spark, path = _folder(nation, "identity")
    fields = F.concat_ws("\t", "n_name", F.lit("ref.fa"), (F.col("n_nationkey") + 90.5).cast("string"), F.col("n_nationkey") + 1, F.lit(30))
    nation.select(fields.alias("value")).write.text(f"{path}/ani")
    log = F.format_string("begin\n%s%% overall alignment rate\nend", (F.col("n_regionkey") * 10 + 0.25).cast("string"))
    nation.select("n_name", log.alias("value")).repartition("n_name").write.partitionBy("n_name").text(f"{path}/logs")
    from cohortloom.fixed_values import ALIGNMENT_RATE_PATTERN

    rates = tables.path_columns(
        tables.read_log_number(spark, f"{path}/logs/n_name=*", ALIGNMENT_RATE_PATTERN, "rate"), r"n_name=([^/]+)/", ["sample"]
    )
    identity = tables.read_identity_rows(spark, f"{path}/ani").withColumnRenamed("query", "sample")
    return identity.join(rates.select("sample", "rate"), "sample").select("sample", "ani", F.round("fraction", 6).alias("fraction"), "rate")


@query(
    "alignment_file",
    """with h as (select l_partkey, l_quantity::bigint as m, l_quantity::bigint + round(l_discount * 100)::bigint as b from lineitem)
    select 'q' || l_partkey as qname, count(*) as hits, sum(m)::bigint as matches, sum(b)::bigint as block from h group by l_partkey""",
)
def alignment_file(t: Tables) -> DataFrame:
    """Alignment rows of 12 fields, with short rows mixed in that must be ignored."""
    q = F.col("l_quantity").cast("bigint")
    full = F.concat_ws(
        "\t", F.concat(F.lit("q"), "l_partkey"), F.lit(1000), F.lit(0), q, F.lit("+"), F.concat(F.lit("t"), "l_suppkey"), F.lit(900), F.lit(0), q, q,
        q + F.round(F.col("l_discount") * 100).cast("bigint"), F.lit(60),
    )
    lines = t.lineitem.select(F.explode(F.array(full, F.lit("short\trow"))).alias("value"))
    spark, path = _folder(lines, "paf")
    lines.write.text(path)
    hits = records.read_alignments(spark, path)
    return hits.groupBy("qname").agg(F.count(F.lit(1)).alias("hits"), F.sum("nmatch").alias("matches"), F.sum("block").alias("block"))


@query(
    "file_manifest",
    """select doc_id, 'doc' || doc_id || '.txt' as file_name, octet_length(encode(coalesce(text, '')))::bigint as size_bytes, md5(coalesce(text, '')) as md5,
         sha256(coalesce(text, '')) as sha256 from documents""",
)
def file_manifest(t: Tables) -> DataFrame:
    """Size, MD5 and SHA-256 of every record, each hashed where it lies."""
    return tables.record_manifest(t.documents, "doc_id", "text", F.format_string("doc%d.txt", "doc_id"))


@query(
    "delivered_files",
    """select 'c' || c_nationkey as folder, count(*) as lines, sum(octet_length(encode(c_name || chr(9) || c_mktsegment)) + 1)::bigint as size_bytes,
         md5(string_agg(c_name || chr(9) || c_mktsegment || chr(10), '' order by c_custkey)) as md5, sha256(string_agg(c_name || chr(9) || c_mktsegment || chr(10), '' order by c_custkey)) as sha256
       from customer group by c_nationkey""",
)
def delivered_files(t: Tables) -> DataFrame:
    """Customers written as one text file per nation; the manifest hashes these files, and every expected one must be there."""
    rows = t.customer.select(F.concat(F.lit("c"), "c_nationkey").alias("folder"), "c_custkey", F.concat_ws("\t", "c_name", "c_mktsegment").alias("value"))
    spark, path = _folder(rows, "delivered")
    rows.repartition("folder").sortWithinPartitions("folder", "c_custkey").select("folder", "value").write.partitionBy("folder").text(path)
    counts = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("lines"))
    found = tables.file_manifest(spark, path, suffix=".txt").withColumn("folder", F.regexp_extract("path", r"folder=([^/]+)/", 1))
    return counts.join(found, "folder", "left").select("folder", "lines", "size_bytes", "md5", "sha256")
