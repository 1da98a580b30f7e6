"""Writers: TSV, FASTA, id lists, text reports and partitioned record pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.fixed_values import FASTA_WIDTH
from cohortloom.session import cut_lineage
from cohortloom.sources.read_records import _open_folder


def write_tsv(df: DataFrame, path: str, fields: list[str] | None = None, order: list[str] | None = None) -> None:
    """TSV folder with a header in a fixed column order; an empty table still has its header.

    Nulls become blanks and booleans 'true'/'false' only here. ``order`` range-sorts across part files.
    """
    fields = fields or df.columns
    out = df.orderBy(*order) if order else df
    out.select(*[F.col(f"`{f}`").cast("string").alias(f) for f in fields]).write.mode("overwrite").option("sep", "\t").option(
        "header", "true"
    ).option("nullValue", "").option("emptyValue", "").csv(path)


def write_metric_files(df: DataFrame, path: str, condition: str, value: str, folders: int = 256) -> None:
    """One headered file per condition, ``path``/<folder>/<condition, url-encoded>.tsv, written where the rows lie.

    Tasks write the files themselves: a partitioned Spark write makes a folder and a task folder per condition and renames each.
    A condition's rows meet in one task, so a condition with several rows is one file of several rows.
    """
    spread = F.lpad(F.hex(F.pmod(F.crc32(F.col(condition).cast("binary")), F.lit(folders))), 2, "0")
    place = F.concat(spread, F.lit("/"), F.url_encode(condition), F.lit(".tsv"))
    rows = df.select(place.alias("place"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_folder(path)
        made: set[str] = set()

        def put(file: str, lines: list[str]) -> None:
            folder = file.split("/")[0]
            if folder not in made:
                system.create_dir(f"{root}/{folder}", recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{root}/{file}") as out:
                quoted = (x if x and not any(c in x for c in '"\t\r\n') else '"' + x.replace('"', '""') + '"' for x in lines)
                out.write("".join(f"{x}\n" for x in (value, *quoted)).encode())

        now, held, files = None, [], 0
        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != now and held:
                    put(now, held)
                    held, files = [], files + 1
                now = file
                held.append(line)
        if held:
            put(now, held)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    rows.repartition("place").sortWithinPartitions("place").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def fasta_text(name: Column, sequence: Column, width: int = FASTA_WIDTH) -> Column:
    """One record as text: header line, then the sequence in lines of a fixed width."""
    wrapped = F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"))
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(wrapped, r"\n+$", ""))


def write_fasta(ids: DataFrame, sequences: DataFrame, path: str, name: str = "name", sequence: str = "seq", ordinal: str = "ordinal") -> None:
    """Sequences of chosen ids in id order; ids without a sequence are skipped. Ids are hashed, so only the final order sorts sequences."""
    chosen = sequences.select(name, sequence).join(ids.select(name, F.col(ordinal).alias("_o")).hint("shuffle_hash"), name)
    (
        chosen.filter(F.coalesce(F.col(sequence), F.lit("")) != "")
        .orderBy("_o")
        .select(fasta_text(F.col(name), F.col(sequence)).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def write_list(df: DataFrame, column: str, path: str) -> None:
    """One id per line, sorted."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def report_lines(df: DataFrame, template: str, columns: list[str], order: list[Column | str]) -> DataFrame:
    """One formatted line per row of a small aggregate."""
    return df.orderBy(*order).select(F.format_string(template, *columns).alias("value"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, path: str, sample: str = "sample") -> None:
    """Record pairs as compressed parquet, one folder per sample, records of a sample in position order.

    Rows are range-partitioned on (sample, position), so a sample with most records has many files.
    """
    pairs.repartitionByRange(sample, "position").sortWithinPartitions(sample, "position").write.mode("overwrite").partitionBy(
        sample
    ).parquet(path)


def write_pair_text(pairs: DataFrame, path: str, sample: str = "sample") -> None:
    """Record pairs as gzip text of four-line records, ``path``/1 and ``path``/2, one folder per sample, in position order.

    Both mates are cut into files at the same records, since both are dealt by the same ranges of (sample, position); a
    sample with most records has many files, and file names follow the order.
    """
    placed = cut_lineage(pairs.repartitionByRange(sample, "position"))
    for mate in ("1", "2"):
        fields = [F.concat(F.lit("@"), F.regexp_replace(f"header_{mate}", "^@", "")), F.col(f"seq_{mate}"), F.lit("+"), F.col(f"qual_{mate}")]
        lines = placed.sortWithinPartitions(sample, "position").select(sample, F.concat_ws("\n", *fields).alias("value"))
        lines.write.mode("overwrite").option("compression", "gzip").partitionBy(sample).text(f"{path}/{mate}")


def write_nested(df: DataFrame, path: str, flags: dict[str, str]) -> dict[str, str]:
    """``all`` and one table per flag, each filtered from the one before; the paths by name."""
    places, current = {"all": f"{path}/all"}, df
    current.write.mode("overwrite").parquet(places["all"])
    for name, flag in flags.items():
        current = df.sparkSession.read.parquet(list(places.values())[-1]).filter(F.col(flag))
        places[name] = f"{path}/{name}"
        current.write.mode("overwrite").parquet(places[name])
    return places
