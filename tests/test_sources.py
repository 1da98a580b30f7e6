"""Readers and writers on temporary files."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import evidence
from cohortloom.plans.selection_plans import snapshot_selection
from cohortloom.sources import records, sinks, snapshot, tables
from cohortloom.streaming import burden, state


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def lines_of(folder):
    parts = sorted(p for p in folder.iterdir() if p.name.startswith("part-") and p.suffix != ".crc")
    return [line for p in parts for line in p.read_text().splitlines()]


def test_text_table(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "id\tmixed_sites_maf_0.10_0.90\tnote\n1\tNA\t x \n2\t\t\n")
    kept = tables.read_text_table(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in kept] == [("1", "NA", " x "), ("2", "", "")]
    blanked = tables.read_text_table(spark, path, missing_to_blank=True).orderBy("id").collect()
    assert [tuple(r) for r in blanked] == [("1", "", " x "), ("2", "", "")]


def test_headerless_and_typed(spark, tmp_path):
    path = put(tmp_path, "h.tsv", "c1\ts1\nc2\ts2\n")
    assert [r.sequence_id for r in tables.read_headerless(spark, path, ["cluster_id", "sequence_id"]).orderBy("cluster_id").collect()] == ["s1", "s2"]
    typed = put(tmp_path, "n.tsv", "a\tb\n1\t2.5\n")
    assert tuple(tables.read_typed_table(spark, typed, "a bigint, b double").first()) == (1, 2.5)


def test_one_row_files_and_path_columns(spark, tmp_path):
    for seed, sites in ((101, 18), (202, 19)):
        put(tmp_path, f"conditions/pairA__Mi1_major__Ma20_minor__p00__s{seed}/x.burden.tsv", f"callable\tsites\n100000\t{sites}\n")
    from cohortloom.fixed_values import CONDITION_PATTERN

    df = tables.read_one_row_files(spark, str(tmp_path / "conditions/*/*.burden.tsv"), ["callable", "sites"])
    got = tables.path_columns(df, CONDITION_PATTERN, ["pair", "major", "minor", "percent", "seed"]).orderBy("seed").collect()
    assert [(r.pair, r.major, r.minor, r.percent, r.seed, r.sites) for r in got] == [("pairA", "Mi1", "Ma20", "00", "101", "18"), ("pairA", "Mi1", "Ma20", "00", "202", "19")]
    put(tmp_path, "conditions/other/x.burden.tsv", "callable\tsites\n1\t2\n3\t4\n")
    with pytest.raises(ValueError, match="one row per metric file"):
        tables.read_one_row_files(spark, str(tmp_path / "conditions/*/*.burden.tsv"), ["callable", "sites"])
    loose = tables.read_one_row_files(spark, str(tmp_path / "conditions/*/*.burden.tsv"), ["callable", "sites"], verify=False)
    with pytest.raises(Exception, match="unexpected file name"):
        tables.path_columns(loose, CONDITION_PATTERN, ["pair"]).collect()


def test_sample_and_route(spark):
    df = spark.createDataFrame([("/x/S_1_strict.fasta",), ("/x/S2_meta.fa",)], "p string")
    sample, route = tables.sample_and_route(F.col("p"), ["strict", "meta"])
    assert [tuple(r) for r in df.select(sample, route).collect()] == [("S_1", "strict"), ("S2", "meta")]
    bad = spark.createDataFrame([("/x/S2_other.fa",)], "p string")
    with pytest.raises(Exception, match="unknown route"):
        bad.select(route).collect()


def test_identity_and_log(spark, tmp_path):
    path = put(tmp_path, "i.tsv", "q.fa\tr.fa\t99.5\t80\t100\n")
    r = tables.read_identity_rows(spark, path).first()
    assert (r.ani, r.fraction) == (99.5, 0.8)
    short = put(tmp_path, "short.tsv", "q.fa\tr.fa\t99.5\n")
    with pytest.raises(Exception, match="malformed identity row"):
        tables.read_identity_rows(spark, short).collect()
    from cohortloom.fixed_values import ALIGNMENT_RATE_PATTERN

    log = put(tmp_path, "a.log", "100 reads\n96.25% overall alignment rate\n10.0% overall alignment rate\n")
    assert tables.read_log_number(spark, log, ALIGNMENT_RATE_PATTERN, "rate").first().rate == 96.25
    empty = put(tmp_path, "b.log", "nothing here\n")
    with pytest.raises(Exception, match="number not found"):
        tables.read_log_number(spark, empty, ALIGNMENT_RATE_PATTERN, "rate").collect()


def test_manifest(spark, tmp_path):
    put(tmp_path, "m/a.bin", "hello")
    r = tables.file_manifest(spark, str(tmp_path / "m")).first()
    assert (r.file_name, r.size_bytes, r.md5, r.sha256) == ("a.bin", 5, hashlib.md5(b"hello").hexdigest(), hashlib.sha256(b"hello").hexdigest())
    wanted = spark.createDataFrame([("a.bin",), ("b.bin",)], "file_name string")
    with pytest.raises(Exception, match="every expected file exists: b.bin"):
        tables.file_manifest(spark, str(tmp_path / "m"), wanted).collect()
    assert tables.file_manifest(spark, str(tmp_path / "m"), wanted.limit(1)).count() == 1


def test_manifest_of_large_and_nested_files(spark, tmp_path):
    """Files longer than a piece, empty ones, folders in folders, hidden ones left out; one partition per file."""
    body = bytes(range(256)) * 70_000  # over two pieces
    for name, data in (("a/big.bin", body), ("a/b/empty.bin", b""), ("c.bin", b"x"), ("_SUCCESS", b""), ("other.txt", b"y")):
        path = tmp_path / "m" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = tables.file_manifest(spark, str(tmp_path / "m"), suffix=".bin")
    assert {(r.file_name, r.size_bytes, r.md5, r.sha256) for r in found.collect()} == {
        (n, len(d), hashlib.md5(d).hexdigest(), hashlib.sha256(d).hexdigest()) for n, d in (("big.bin", body), ("empty.bin", b""), ("c.bin", b"x"))
    }
    assert found.rdd.getNumPartitions() == 3
    assert tables.file_manifest(spark, f"file://{tmp_path}/m", suffix="c.bin").first().sha256 == hashlib.sha256(b"x").hexdigest()
    with pytest.raises(Exception, match="FileNotFoundError"):
        tables.file_manifest(spark, str(tmp_path / "nothing")).collect()


def test_metric_files_by_condition(spark, tmp_path):
    """Names with blanks, percent and plus signs come back; one file per condition, no folder per condition; two rows are an error."""
    rows = [(f"{i}__A {i}+%2F/é", None if i == 7 else f"{i}.5") for i in range(600)]
    df = spark.createDataFrame(rows, "condition string, value string")
    sinks.write_metric_files(df, str(tmp_path / "m"), "condition", "value")
    assert len(list((tmp_path / "m").iterdir())) <= 256 and len(list((tmp_path / "m").rglob("*.tsv"))) == 600
    got = tables.read_metric_files(spark, str(tmp_path / "m"), ["value"])
    assert sorted(map(str, got.select("condition", "value").collect())) == sorted(map(str, df.collect()))
    sinks.write_metric_files(df.union(df.limit(1)), str(tmp_path / "two"), "condition", "value")
    with pytest.raises(Exception, match="one row per metric file"):
        tables.read_metric_files(spark, str(tmp_path / "two"), ["value"]).collect()


def test_burden_with_state_over_restarts(spark, tmp_path):
    """Three runs of the stream over one folder give the batch rows each time; a batch that runs again changes nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STATE_STORE)
    keys = ["sample", "route"]
    for n, more in enumerate(("one", "two", "three")):
        depth = 12 + 9 * n
        put(tmp_path, f"ev/{more}.txt", EVIDENCE + "\n".join(f"ctg\t{i}\tG\t{depth}\t{'.' * depth}\t*" for i in range(100, 103 + n)) + "\n")
        lines = spark.readStream.text(str(tmp_path / "ev")).withColumns({"sample": F.lit("s"), "route": F.col("value").contains("\t101\t").cast("string")})
        query = state.run_burden(state.stream_burden(lines, keys), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(120)
        got = state.latest(spark.read.parquet(str(tmp_path / "out")), keys)
        batch = records.evidence_fields(spark.read.text(str(tmp_path / "ev")).withColumns({"sample": F.lit("s"), "route": F.col("value").contains("\t101\t").cast("string")}))
        want = evidence.mixture_burden(evidence.decode_rows(batch), keys)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    query = state.run_burden(state.stream_burden(lines, keys), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(map(str, state.latest(spark.read.parquet(str(tmp_path / "out")), keys).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_idle_keys_lose_their_state():
    """The processor against a state in memory: a timer moves with every input, and clears the histogram when it fires."""
    import pandas as pd

    class Depths(dict):
        containsKey, updateValue, getValue, iterator = dict.__contains__, dict.__setitem__, dict.__getitem__, dict.items

    class Handle:
        timers: list[int] = []
        depths = Depths()

        def getMapState(self, *_):
            return self.depths

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    handle, processor = Handle(), state.BurdenState(500)
    processor.init(handle)
    rows = pd.DataFrame([[30, 2, 2, 1, 0], [5, 4, 0, 0, 0]], columns=["depth", *state.COUNTS])
    for times in (1, 2):
        (out,) = processor.handleInputRows(("s",), iter([rows]), Clock())
        assert out.iloc[0].tolist() == ["s", 6 * times, 2 * times, 30, times, 0] and handle.timers == [1500]
    list(processor.handleExpiredTimer(("s",), Clock(), None))
    assert not handle.depths


def test_a_batch_costs_a_key_few_state_writes():
    """Of 5,000 depths in two pieces, each batch reads the state once and writes it once a piece; sums and median are exact."""
    import numpy as np
    import pandas as pd

    class Store(dict):
        calls = 0

        def iterator(self):
            self.calls += 1
            return iter(list(self.items()))

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    class Handle:
        depths = Store()

        def getMapState(self, *_):
            return self.depths

    processor = state.BurdenState(0)
    processor.init(Handle())
    rows = pd.DataFrame({"depth": np.arange(5_000), "positions": 2, "callable": (np.arange(5_000) >= 20).astype(int), "mixed_wide": 1, "mixed_narrow": 0})
    for times in (1, 2):
        (out,) = processor.handleInputRows(("s",), iter([rows[:1_000], rows[1_000:]]), None)
        assert out.iloc[0].tolist() == ["s", 10_000 * times, 4_980 * times, 2_509, 5_000 * times, 0]
        assert Handle.depths.calls == 3 * times


def test_keys_that_never_expire_need_no_python_state(spark, tmp_path):
    put(tmp_path, "ev/one.txt", EVIDENCE)
    lines = spark.readStream.text(str(tmp_path / "ev")).withColumn("sample", F.lit("s"))
    plans = [state.stream_burden(lines, ["sample"], idle)._jdf.queryExecution().analyzed().toString() for idle in (0, 500)]
    assert ["TransformWithState" in p for p in plans] == [False, True]


def test_lower_median_of_a_histogram():
    assert state.lower_median({1: 1, 2: 1, 3: 1, 10: 1}) == 2 and state.lower_median({}) == 0 and state.lower_median({5: 0, 7: 3}) == 7


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "s.fa", ">a first record\nACGT\nACG\n\n>b\n" + "T" * 200 + "\n>c\nGG")
    df = records.read_fasta(spark, path)
    assert [(r.name, len(r.seq)) for r in df.orderBy("ordinal").collect()] == [("a", 7), ("b", 200), ("c", 2)]
    assert records.read_fasta(spark, path, whole_name=True).orderBy("ordinal").first().name == "a first record"
    ids = spark.createDataFrame([("b", 0), ("zz", 1), ("a", 2)], "name string, ordinal int")
    sinks.write_fasta(ids, df, str(tmp_path / "out"))
    text = lines_of(tmp_path / "out")
    assert text == [">b", "T" * 80, "T" * 80, "T" * 40, ">a", "ACGTACG"]
    stats = evidence.sequence_stats(df.withColumn("sample", F.lit("s")), ["sample"]).first()
    assert (stats.total_length, stats.records, stats.n50, stats.longest) == (209, 3, 200, 200)


def test_sequences_are_read_once_for_their_stats(spark, tmp_path):
    path = put(tmp_path, "s.fa", ">a\nGgCcéAT\n>b\nGGNN\n>c\nTT\n")
    stats = evidence.sequence_stats(records.read_fasta(spark, path).withColumn("sample", F.lit("s")), ["sample"], min_length=3)
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") <= 1
    got = stats.first()
    assert (got.total_length, got.records, got.n50, got.longest, got.gc_percent) == (11, 2, 7, 7, 600 / 11)


def fastq(n, mate, offset=0):
    return "".join(f"@r{i + offset}/{mate} x\nACG{i}\n+\nIII{i}\n" for i in range(n))


def test_fastq_pairs(spark, tmp_path):
    for mate in (1, 2):
        with gzip.open(tmp_path / f"S_R{mate}.fastq.gz", "wt") as handle:
            handle.write(fastq(7, mate))
    first, second = (records.read_fastq(spark, str(tmp_path / f"S_R{m}.fastq.gz")).withColumn("sample", F.lit("S")) for m in (1, 2))
    assert records.count_records(first).first().records == 7
    pairs = records.paired_reads(first, second, "sample")
    got = pairs.orderBy("position").collect()
    assert [(r.position, r.key, r.seq_1, r.qual_2) for r in got] == [(i, f"r{i}", f"ACG{i}", f"III{i}") for i in range(7)]
    sinks.write_pairs(pairs, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 7
    shifted = second.withColumn("header", F.concat(F.lit("@other"), "position"))
    with pytest.raises(Exception, match="key_mismatch"):
        records.paired_reads(first, shifted, "sample").collect()
    with pytest.raises(Exception, match="missing_mate"):
        records.paired_reads(first, second.filter("position < 6"), "sample").collect()
    broken = put(tmp_path, "broken.fastq", fastq(2, 1) + "@half\nAC\n")
    with pytest.raises(Exception, match="incomplete record"):
        records.read_fastq(spark, broken).collect()


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = put(tmp_path, "big.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = records.numbered_lines(spark, path).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.line_no, r.value) for r in got] == [(i, f"line {i}") for i in range(5000)]


def test_alignments(spark, tmp_path):
    good = "q1\t100\t0\t60\t+\tt1\t500\t0\t60\t57\t60\t60"
    path = put(tmp_path, "x.paf", good + "\nshort\trow\n" + good.replace("t1", "t2").replace("\t57\t", "\t30\t") + "\n")
    hits = records.read_alignments(spark, path)
    assert hits.count() == 2
    queries = spark.createDataFrame([("q1", 600), ("q2", 900)], "qname string, length bigint")
    out = evidence.weighted_support(
        hits, queries, "qname", "length", target="target", start="qstart", end="qend", matches="nmatch", block="block",
        ordinal="ordinal", min_identity=0.9, min_fraction=0.1, min_length=500,
    ).orderBy("qname").collect()
    assert (out[0].best_target, out[0].supporting, out[0].retained) == ("t1", 1, True)
    assert out[0].weighted_identity == pytest.approx(0.95)
    assert (out[1].best_target, out[1].supporting, out[1].retained) == (None, 0, False)


EVIDENCE = "\n".join(
    f"ctg\t{i}\tG\t{a + b}\t{'.' * a}{'A' * b}\t*" for i, (a, b) in enumerate([(15, 5), (14, 5), (45, 5), (20, 0)])
) + "\nctg\t9\tG\n"


def test_evidence_batch_and_stream(spark, tmp_path):
    put(tmp_path, "ev/one.txt", EVIDENCE)
    put(tmp_path, "ev/two.txt", EVIDENCE)
    batch = records.read_evidence(spark, str(tmp_path / "ev")).withColumns({"sample": F.lit("s"), "route": F.lit("r")})
    want = evidence.mixture_burden(evidence.decode_rows(batch), ["sample", "route"]).first()
    assert (want.total_positions, want.callable_positions, want.mixed_wide, want.mixed_narrow, want.median_depth) == (8, 6, 4, 2, 20)
    stream = spark.readStream.text(str(tmp_path / "ev")).withColumns({"sample": F.lit("s"), "route": F.lit("r")})
    keys = ["sample", "route"]
    query = burden.run_profile(burden.stream_profile(stream, keys), str(tmp_path / "profile"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = burden.burden_of_stored_profile(spark.read.parquet(str(tmp_path / "profile")), keys).first()
    assert got == want
    put(tmp_path, "ev/three.txt", EVIDENCE)
    query = burden.run_profile(burden.stream_profile(stream, keys), str(tmp_path / "profile"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    more = burden.burden_of_stored_profile(spark.read.parquet(str(tmp_path / "profile")), keys).first()
    assert (more.total_positions, more.callable_positions, more.mixed_narrow) == (12, 9, 3)


def snapshot_record(accession, pair, contamination):
    return {
        "accession": accession, "current_accession": accession, "paired_accession": pair,
        "assembly_info": {
            "assembly_level": "Scaffold", "assembly_name": "x", "refseq_category": "na", "release_date": "2020-01-01",
            "biosample": {"accession": "SAMN1", "attributes": [{"name": "HOST", "value": "Homo"}], "bioprojects": [{"accession": "PRJ1"}]},
        },
        "assembly_stats": {"total_sequence_length": "5200000", "gc_percent": 68.5, "number_of_contigs": 100, "contig_n50": 50000},
        "average_nucleotide_identity": {"submitted_species": "Mycobacterium avium"},
        "checkm_info": {"completeness": 96, "contamination": contamination},
        "organism": {"organism_name": "Mycobacterium avium subsp. hominissuis", "tax_id": 1764},
    }


def test_snapshot_quality_runs_before_pair_choice(spark, tmp_path):
    a, b = "GCF_000000001.1", "GCA_000000001.1"
    path = put(tmp_path, "s.jsonl", json.dumps(snapshot_record(a, b, 10)) + "\n\n" + json.dumps(snapshot_record(b, a, 1)) + "\n" + json.dumps({"accession": "GCA_2"}) + "\n")
    flat = snapshot.flatten_snapshot(snapshot.read_snapshot(spark, path))
    assert flat.count() == 3
    row = flat.filter(F.col("assembly_accession") == b).first()
    assert (row.pair_key, row.host, row.bioproject, row.source_database, row.gc_percent) == (f"{b}|{a}", "Homo", "PRJ1", "GenBank", 68.5)
    ledger = {r.assembly_accession: r for r in snapshot_selection(flat).collect()}
    assert ledger[b].selection_decision == "selected_qc_first" and ledger[b].selected_after_entity
    assert ledger[a].selection_decision == "excluded_qc" and ledger[a].selection_reason == "checkm_contamination"
    assert ledger[a].pair_winner == b and ledger[a].fine_label == "Mycobacterium avium subsp. hominissuis"
    assert ledger[a].selection_score == pytest.approx(round(100 + 10 + 96 - 20 + 3 * 4.698970004336019, 6))
    bare = ledger["GCA_2"]
    assert bare.selection_reason == "genome_size;gc;n50;checkm_completeness;checkm_contamination"


def test_tsv_sink_keeps_header_when_empty(spark, tmp_path):
    df = spark.createDataFrame([("b", None, True), ("a", 1.5, False)], "id string, v double, f boolean")
    sinks.write_tsv(df, str(tmp_path / "full"), ["f", "id", "v"], order=["id"])
    assert lines_of(tmp_path / "full") == ["f\tid\tv", "false\ta\t1.5", "true\tb\t"]
    sinks.write_tsv(df.filter("id = 'zz'"), str(tmp_path / "empty"), ["f", "id", "v"], order=["id"])
    assert lines_of(tmp_path / "empty") == ["f\tid\tv"]


def test_lists_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n bigint")
    sinks.write_list(df, "id", str(tmp_path / "ids"))
    assert lines_of(tmp_path / "ids") == ["a", "b"]
    sinks.write_report(sinks.report_lines(df, "- %s: %d", ["id", "n"], [F.desc("n"), "id"]), str(tmp_path / "rep"))
    assert lines_of(tmp_path / "rep") == ["- b: 2", "- a: 1"]
