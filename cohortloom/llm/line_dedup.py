"""Line dedup by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 25


def line_words(line: Column) -> Column:
    """Pieces between single spaces; a blank line has none."""
    return F.when(F.trim(line) == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _needed(counts: str, start: Column, least: int, back: bool) -> Column:
    """Lines from ``start`` (0-based) on, forwards or back, until they hold ``least`` words; null if they never do.

    Every counted line has a word, so ``least`` lines are looked at and no more.
    """
    if back:
        first = F.greatest(start - (least - 1), F.lit(0))
        piece = F.reverse(F.slice(F.col(counts), first + 1, start - first + 1))
    else:
        piece = F.slice(F.col(counts), start + 1, F.lit(least))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    step = F.aggregate(
        piece, zero,
        lambda acc, n: F.when(acc["sum"] >= least, acc).otherwise(
            F.struct((acc["sum"] + n).alias("sum"), (acc["n"] + 1).alias("n"))
        ),
    )
    return F.when(step["sum"] >= least, step["n"])


def _numbered(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    counted = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.cast("int").alias("i"), F.xxhash64(line).alias("h"), line_words(line).cast("int").alias("n"))),
        lambda x: x["n"] > 0,
    )
    return documents.select(
        F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(F.col(text_col)).alias("mark"), counted.alias("lines")
    ).select("doc", "mark", F.col("lines.h").alias("h"), F.col("lines.n").alias("n"), F.col("lines.i").alias("i"))


def repeated_lines(documents: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, mark, gone): 0-based numbers of the lines to delete, of documents that lose any; see ``drop_repeated_lines``.

    A window is the shortest run of lines, forwards from a line or back from one, that holds ``min_words`` words. Any
    repeated run of that many words is the union of windows inside it, so the least line hash of each window
    (its fingerprint) is guaranteed to be shared. Windows meet on (fingerprint, hash of the lines left of it, hash
    of the lines right of it), which extends the match both ways to the whole window; overlapping windows
    join into the maximal run. Only the first place of each key is kept per key (merged map-side), never a list.
    """
    base = _numbered(documents, id_col, text_col)
    at = F.sequence(F.lit(0), F.size("h") - 1)
    windows = F.when(F.size("h") > 0, F.array_distinct(F.concat(
        F.transform(at, lambda s: F.struct(s.alias("s"), _needed("n", s, min_words, False).alias("k"))),
        F.transform(at, lambda e: F.struct((e - _needed("n", e, min_words, True) + 1).alias("s"), _needed("n", e, min_words, True).alias("k"))),
    )))
    placed = base.select("doc", "mark", "h", "i", F.explode(windows).alias("w")).filter("w.k is not null")
    run = F.slice("h", F.col("w.s") + 1, F.col("w.k"))
    cut = placed.withColumn("run", run).withColumn("fp", F.array_min("run")).withColumn("p", F.array_position("run", F.col("fp")).cast("int"))
    keyed = cut.select(
        "doc", "mark", "fp",
        F.xxhash64(F.slice("run", 1, F.col("p") - 1), F.col("w.k")).alias("left"),
        F.xxhash64(F.lit(1), F.slice("run", F.col("p") + 1, F.size("run"))).alias("right"),
        F.element_at("i", F.col("w.s") + 1).alias("start"),
        F.transform(F.slice("i", F.col("w.s") + 1, F.col("w.k")), lambda x: x).alias("at"),
    )
    place = F.struct("doc", "mark", "start")
    first = (
        keyed.groupBy("fp", "left", "right")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first != last")
    )
    later = keyed.join(first, ["fp", "left", "right"]).filter(place > F.col("first"))
    return later.groupBy("doc", "mark").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def drop_repeated_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Documents with shortened texts, and columns ``lines_total`` and ``lines_removed`` (BIGINT).

    A line is deleted if it lies in a run of consecutive lines with at least ``min_words`` words in all that occurs
    earlier, in the order of id, text hash and line; the first occurrence stays. Lines are what stands between line feeds;
    blank lines neither count nor break a run, and stay. A null text stays null with one (blank) line. Rows repeated with the
    same id and text are one document and are all shortened alike. A null id sorts first. All other columns are kept; columns of
    the input named like the two added ones are replaced. The line numbers of one document are the largest value
    held together.
    """
    gone = repeated_lines(documents, id_col, text_col, min_words)
    kept_cols = [c for c in documents.columns if c not in ("lines_total", "lines_removed")]
    left = documents.select(
        F.struct(*kept_cols).alias("_row"), F.col(id_col).cast("bigint").alias("_doc"), F.xxhash64(F.col(text_col)).alias("_mark"), F.col(text_col).alias("_text")
    )
    marks = gone.select(F.col("doc").alias("_gone_doc"), F.col("mark").alias("_mark"), F.col("gone").alias("_gone"))
    joined = (
        left.join(marks, F.col("_doc").eqNullSafe(F.col("_gone_doc")) & (left["_mark"] == marks["_mark"]), "left")
        .withColumn("_lines", F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"))
    )
    kept = F.array_join(F.filter("_lines", lambda line, i: ~F.array_contains("_gone", i.cast("int"))), "\n")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in kept_cols],
        F.size("_lines").cast("bigint").alias("lines_total"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("lines_removed"),
    )


ORACLE = f"""
with l as (
  select doc_id, text, i, t, case when trim(t, ' ') = '' then 0 else length(t) - length(replace(t, ' ', '')) + 1 end as n
  from (select doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i,
               unnest(string_split(coalesce(text, ''), chr(10))) as t from documents)),
c as (select doc_id, i, t, n, row_number() over w as p, sum(n) over w as s from l where n > 0 window w as (partition by doc_id order by i)),
f as (select a.doc_id, a.p as s, min(b.p) as e from c a join c b on a.doc_id = b.doc_id and b.p between a.p and a.p + {MIN_WORDS - 1}
      and b.s - a.s + a.n >= {MIN_WORDS} group by 1, 2
      union
      select a.doc_id, max(b.p), a.p from c a join c b on a.doc_id = b.doc_id and b.p between a.p - {MIN_WORDS - 1} and a.p
      and a.s - b.s + b.n >= {MIN_WORDS} group by a.doc_id, a.p),
k as (select f.doc_id, f.s, f.e, string_agg(c.t, chr(10) order by c.p) as body from f join c on c.doc_id = f.doc_id and c.p between f.s and f.e group by 1, 2, 3),
m as (select *, row_number() over (partition by body order by doc_id, s) as r from k),
g as (select distinct c.doc_id, c.i from m join c on c.doc_id = m.doc_id and c.p between m.s and m.e where m.r > 1)
select l.doc_id, count(*) as lines_total, count(g.i) as lines_removed,
       md5(coalesce(string_agg(l.t, chr(10) order by l.i) filter (where g.i is null), '')) as kept_md5
from l left join g on g.doc_id = l.doc_id and g.i = l.i group by 1
"""
