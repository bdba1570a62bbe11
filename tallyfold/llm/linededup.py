"""Line dedup by content-defined chunks, in DataFrame functions only.

Lines are the parts between ``\\n``.  A line's hash is the first 32 bits of its
MD5; the rolling hash at a line is its hash plus 31 times the hash of the line
before (0 at the start).  A chunk ends after a line whose rolling hash is
divisible by ``DIVISOR``, and at the end of the text, so boundaries depend on
two lines only and survive shifts.  A chunk of two lines or more with a word
that occurs elsewhere before (least doc_id, then position) is removed.

Two steps find the repeats: a 64-bit hash count drops the chunks that occur
once, then the rest is grouped by the chunk's own bytes, which is the byte
comparison.  Both are grouped aggregates with map-side combination and joins
that AQE can split, so a chunk in a third of all documents is no single task.

Null text stays null and has no line; empty text is one empty line.  Rows that
repeat a doc_id with the same text are one occurrence: both keep or lose the
same lines.  A null doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIVISOR = 3
MIN_LINES = 2
# Fixed value: a character that is no white space of the contracts.
WORD = r"[^\x20\x09-\x0D]"


def _hold(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a one-row ``explode``: they become attributes, so a
    lambda that reads them does not compute them again for every element."""
    for name, c in cols.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def chunked(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_lines``, ``_spans`` (start, n) and ``_chunks`` (bodies) of the
    text; null text has null in all."""
    df = _hold(df, _lines=F.split(text, "\n", -1))
    df = _hold(df, _hash=F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("_hash", F.lit(1), F.greatest(F.size("_hash") - 1, F.lit(0))))
    cut = F.zip_with("_hash", before, lambda a, b: F.pmod(a + 31 * b, F.lit(DIVISOR)) == 0)
    ends = F.filter(F.transform(cut, lambda c, i: F.when(c, i + 1)), lambda x: x.isNotNull())
    df = _hold(df, _ends=F.array_union(ends, F.array(F.size("_lines"))))
    starts = F.concat(F.array(F.lit(0)), F.slice("_ends", F.lit(1), F.size("_ends") - 1))
    df = _hold(df, _spans=F.zip_with(starts, "_ends", lambda a, b: F.struct(a.alias("start"), (b - a).alias("n"))))
    return _hold(df.drop("_hash", "_ends"), _chunks=F.transform(
        "_spans", lambda s: F.array_join(F.slice(F.col("_lines"), s["start"] + 1, s["n"]), "\n")))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, body, h) of every multi-line chunk with a word."""
    keyed = docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    parts = chunked(keyed, F.col("text")).select(
        "doc_id", "t", F.posexplode(F.arrays_zip(F.col("_spans"), F.col("_chunks"))).alias("pos", "c"))
    return (parts.where((F.col("c._spans.n") >= MIN_LINES) & F.col("c._chunks").rlike(WORD))
            .select("doc_id", "t", "pos", F.col("c._chunks").alias("body"), F.xxhash64("c._chunks").alias("h")))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, t, gone): positions of the chunks to remove from each text."""
    every = _occurrences(docs)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("t"), F.col("pos"))).alias("first")
    often = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    some = every.join(often, "h", "left_semi")
    least = some.groupBy("h", "body").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "body", "first")
    again = some.join(least, ["h", "body"]).where(
        ~((F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("first.d")) & (F.col("t") == F.col("first.t"))
          & (F.col("pos") == F.col("first.pos"))))
    return again.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """All columns of ``docs`` with the text rebuilt; with ``counts`` the id and
    text alone, plus ``n_lines`` and ``n_removed`` (lines)."""
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]  # renamed, so that no name clashes
    base = docs.select(*own, F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"),
                       F.xxhash64(F.col(text_col)).alias("_t"))
    gone = repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    gone = gone.select(F.col("doc_id").alias("_gid"), F.col("t").alias("_gt"), F.col("gone").alias("_gone"))
    df = base.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_t") == F.col("_gt")), "left").drop("_gid", "_gt")
    df = chunked(df, F.when(F.col("_gone").isNotNull(), F.col("_text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_chunks") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("_chunks"), i)), "\n"))
    if not counts:
        return df.select(*((text if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)))
    lines = F.length("_text") - F.length(F.regexp_replace("_text", "\n", "")) + 1
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(
        F.aggregate("_gone", F.lit(0), lambda a, i: a + F.get(F.col("_spans"), i)["n"]))
    return df.select(F.col(f"_c{docs.columns.index(id_col)}").alias(id_col), text.alias(text_col),
                     F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_md5) of every row."""
    return dedup(docs.select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLE = rf"""
with l as (
  select d.doc_id, unnest(string_split(d.text, chr(10))) as line, generate_subscripts(string_split(d.text, chr(10)), 1) as i
  from documents d where d.text is not null),
h as (select *, ('0x' || substr(md5(line), 1, 8))::BIGINT as v from l),
r as (select *, (v + 31 * coalesce(lag(v) over (partition by doc_id order by i), 0)) % {DIVISOR} = 0 as cut from h),
c as (select *, coalesce(sum(cut::INT) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from r),
k as (select doc_id, chunk, count(*) as n, string_agg(line, chr(10) order by i) as body from c group by doc_id, chunk),
m as (select *, n >= {MIN_LINES} and regexp_matches(body, '[^\x20\x09-\x0D]')
        and row_number() over (partition by body order by doc_id, chunk) > 1 as gone from k),
a as (select doc_id, sum(n) as n_lines, coalesce(sum(n) filter (where gone), 0) as n_removed,
             coalesce(string_agg(body, chr(10) order by chunk) filter (where not gone), '') as kept from m group by doc_id)
select d.doc_id, coalesce(a.n_lines, 0)::BIGINT as n_lines, coalesce(a.n_removed, 0)::BIGINT as n_removed, md5(a.kept) as kept_md5
from documents d left join a using (doc_id)
"""
