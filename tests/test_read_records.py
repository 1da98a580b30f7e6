"""Read records in byte ranges of every size against a plain reading of the lines."""

from __future__ import annotations

import gzip
import random

import pytest

from cohortloom.sources import read_records


def text_of(n: int, seed: int = 3) -> tuple[str, list[tuple[str, str, str]]]:
    """Records with empty sequences, and qualities that begin with the marks of other lines."""
    rng = random.Random(seed)
    records = []
    for i in range(n):
        size = rng.choice([0, 1, 7, 60])
        quality = "".join(rng.choice("@+IJ#") for _ in range(size))
        records.append((f"@r{i} x", "ACGT"[i % 4] * size, quality))
    return "".join(f"{h}\n{s}\n+{h[1:] if i % 3 == 0 else ''}\n{q}\n" for i, (h, s, q) in enumerate(records)), records


def ranged(path: str, size: int, what: str = "records") -> list[tuple]:
    reader = read_records.RecordReader(path, size, what)
    if what == "counts":
        return [row for part in reader.partitions() for row in reader.read(part)]
    return [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_ranges_of_every_size(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(read_records, "PIECE", piece)
    text, records = text_of(60)
    path = tmp_path / "a.fastq"
    for body in (text, text.removesuffix("\n") + "I", text.replace("\n", "\r\n")):
        path.write_bytes(body.encode())
        want = [*records[:-1], (*records[-1][:2], records[-1][2] + "I")] if body.endswith("I") else records
        for size in (1, 5, 33, 100, 1000, 1 << 20):
            rows = ranged(str(path), size)
            assert [r[3:] for r in rows] == want, (size, piece)
            starts = sorted({r[1] for r in rows})
            counts = {r[1]: r[2] for r in ranged(str(path), size, "counts")}
            if counts:
                assert sum(counts.values()) == len(want) and all(counts[s] == sum(r[1] == s for r in rows) for s in starts)


def test_numbered_over_ranges_files_and_patterns(spark, tmp_path):
    expected = {}
    for k in range(3):
        folder = tmp_path / f"sample={k}"
        folder.mkdir()
        text, records = text_of(40 + k, seed=k)
        (folder / "part-0.fastq").write_text(text)
        with gzip.open(folder / "part-1.fastq.gz", "wt") as handle:
            handle.write(text)
        (folder / "_SUCCESS").write_text("")
        (folder / "part-2.fastq").write_text("")
        for name in ("part-0.fastq", "part-1.fastq.gz"):
            expected |= {(str(folder / name), i): r for i, r in enumerate(records)}
    for path in (str(tmp_path), f"{tmp_path}/sample=*", f"file://{tmp_path}/sample=*"):
        frame = read_records.numbered_records(spark, path, range_bytes=500)
        assert {(r.file_path, r.position): (r.header, r.seq, r.qual) for r in frame.collect()} == expected
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Join" not in read_records.numbered_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_ragged_files_and_missing_ones(spark, tmp_path):
    text, _ = text_of(8)
    lines = text.splitlines(keepends=True)
    for name, body in {"short": text + "@half\nAC\n", "extra": "".join([*lines[:9], "ACGT\n", *lines[9:]]), "blank": text + "\n"}.items():
        (tmp_path / f"{name}.fastq").write_text(body)
        with pytest.raises(Exception, match="incomplete record"):
            read_records.numbered_records(spark, str(tmp_path / f"{name}.fastq")).collect()
    with pytest.raises(Exception, match="nowhere"):
        read_records.numbered_records(spark, str(tmp_path / "nowhere")).collect()
