"""Secret scan with corpus-wide ownership frequency.

Base spans follow three fixed patterns.  The method adds wider candidates
(private keys, bearer-like and mixed random strings) and judges every
candidate value by its owners over the whole corpus: a hash of each value is
aggregated by distinct owner, distinct document and distinct text.  A value
seen under more than ``max_owners`` owners, or in more than ``max_repos``
documents with as many different texts, is a widely copied example; a value
within both bounds that looks random is reported as ``live``.  Base spans are always reported;
added spans only if they are live.

The value of a private key is what stands between its header and its END line
(without one: the key lines after the header), without white space, quotes and
escapes, so that every key is judged on its own.  Its span is the whole key.  A
header with nothing after it has itself as value.

Null text is empty and has no span; a null owner counts as one owner of its
own and a null document as one document.  Repeated rows of one document, and
copies of one whole text under many documents, count as one.  Only hashes
of values and counts are shuffled, pre-aggregated per task, so a value held by
a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the base contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
# Added kinds, judged by ownership.
PRIVATE = r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----"
KEY_LINES = r"""(?:(?:[\s"'`#>*|,;]|\\[nrt])*(?:[A-Za-z0-9+/=]{24,}|(?:Proc-Type|DEK-Info):[^\n\\]*))*"""
KEY_WRAP = r"""\\[nrt]|[\s"'`#>*|,;]+"""
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "private", "random")
MAX_OWNERS = 2
MAX_REPOS = 10  # documents of different text in which an owner may repeat a value of its own
MIN_BITS = 3.0
SPAN = "array<struct<kind:string,start:long,stop:long,value:string,digest:string,bits:double>>"


def entropy(s: str) -> float:
    """Bits per character of the value's own characters."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in map(s.count, set(s))) if n else 0.0


def scanner():
    """A function text -> list of (kind, start, end, value)."""
    assign = re.compile(ASSIGN, re.I | re.A)
    access, hexa = re.compile(ACCESS), re.compile(r"[0-9a-f]{%d,}" % HEX_CHARS)
    private, rand = re.compile(PRIVATE), re.compile(RANDOM)
    key_lines, key_wrap = re.compile(KEY_LINES), re.compile(KEY_WRAP)

    def keys(t: str) -> list[tuple[str, int, int, str]]:
        out, marks = [], list(private.finditer(t))
        for m, after in zip(marks, [*marks[1:], None]):
            if m.group(1) == "BEGIN":
                closed = after is not None and after.group(1) == "END"
                end = after.start() if closed else key_lines.match(t, m.end()).end()
                value = key_wrap.sub("", t[m.end():end])
                stop = after.end() if closed else end if value else m.end()
                out.append(("private", m.start(), stop, value or m.group()))
        return out

    def scan(t: str) -> list[tuple[str, int, int, str]]:
        out = []
        low = t.lower()
        if ("=" in t or ":" in t) and any(k in low for k in ("passw", "secret", "token", "key")):
            out += [("assign", *m.span(), m.group(2)) for m in assign.finditer(t) if len(m.group(2)) >= ASSIGN_VALUE]
        if "AKIA" in t:
            out += [("access", *m.span(), m.group()) for m in access.finditer(t) if len(m.group()) >= ACCESS_CHARS]
        out += [("hex", *m.span(), m.group()) for m in hexa.finditer(t)]
        if "PRIVATE KEY-----" in t:
            out += keys(t)
        # A key too uniform to be judged live hides nothing that stands in it.
        taken = [(s, e) for k, s, e, v in out if k != "private" or entropy(v) >= MIN_BITS]
        for m in rand.finditer(t):
            v = m.group()
            if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= MIN_BITS \
                    and not any(s < m.end() and m.start() < e for s, e in taken):
                out.append(("random", *m.span(), v))
        out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        return out

    return scan


def scan_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but the text, plus ``spans``: every candidate of the whole text."""
    rest = [c for c in docs.columns if c not in (text_col, "spans")]

    def run(batches):
        scan = scanner()
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                rows.append([{"kind": k, "start": s, "stop": e, "value": v,
                              "digest": hashlib.sha256(v.encode()).hexdigest()[:32], "bits": entropy(v)}
                             for k, s, e, v in scan(t or "")])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                                       ("value", pa.string()), ("digest", pa.string()), ("bits", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=[*rest, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return docs.select(*rest, text_col).mapInArrow(run, f"{schema}, spans {SPAN}")


def ownership(scanned: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text_hash",
              max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per value digest: distinct owners, repositories and texts, and the verdict.

    Spark groups by (digest, owner), (digest, repository) and (digest, text)
    first, so one hot value is spread over them before it meets in one row."""
    one = scanned.select(F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.col(text_col).alias("text"),
                         F.explode("spans").alias("s"))
    count = lambda c: F.count_distinct(F.struct(c))  # noqa: E731  # null is a value of its own
    own = one.groupBy(F.col("s.digest").alias("digest")).agg(
        count("owner").alias("n_owners"), count("repo").alias("n_repos"), count("text").alias("n_texts"),
        F.max("s.bits").alias("bits"))
    copied = (F.col("n_owners") > max_owners) | (F.least("n_repos", "n_texts") > max_repos)
    return own.select("digest", "n_owners", "n_repos", "n_texts", (~copied & (F.col("bits") >= MIN_BITS)).alias("live"))


def secret_report(docs: DataFrame, checkpoint: str, owner_col: str = "source") -> DataFrame:
    """One row per input row: base counts, base digest, all spans, and how many
    candidates are live or widely copied.  ``checkpoint`` is a fresh folder in
    the shared checkpoint dir: the scan (spans, no text) is written there once,
    because both the ownership counts and the report read it."""
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long"), F.col(owner_col).alias("source"),
                         F.xxhash64("text").alias("text_hash"), "text")
    scan_documents(picked).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(checkpoint)
    scanned = spark.read.parquet(checkpoint)
    own = ownership(scanned, "source")
    one = scanned.select("row", F.posexplode("spans").alias("i", "s")).select("row", "i", F.col("s.digest").alias("digest"))
    judged = one.join(own.select("digest", "live"), "digest").groupBy("row").agg(
        F.collect_list(F.when(F.col("live"), F.col("i"))).alias("live"), F.count(F.lit(1)).alias("n"))
    word = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    of_kind = lambda k: lambda x: x["kind"] == k
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:3]))
    every = F.filter("spans", lambda x, i: x["kind"].isin(*KINDS[:3]) | F.coalesce(F.array_contains("live", i), F.lit(False)))
    live = F.coalesce(F.size("live"), F.lit(0)).cast("long")
    return scanned.join(judged, "row", "left").select(
        "doc_id",
        *(F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, word), ",").alias("spans"),
        F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(live).alias("n_live"),
        F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(F.col("n") - live).alias("n_copied"))
