"""Removal of repeated 50-word passages with suffix automata.

A window is 50 consecutive words of a document.  A word is removed if a window
covers it whose word sequence also starts in a document of smaller doc_id.

1. Copies collapse: of equal texts only the least doc_id goes on; every other
   copy of 50 words or more is removed whole.
2. Anchors: in every window the 30-word shingle of least hash is an anchor
   (winnowing), so equal windows hold equal anchors wherever they stand.
   Anchors of one document only are dropped by a grouped minimum and maximum.
3. Each remaining anchor is cut with the 20 words before and after it that a
   window around it can reach.  Equal contexts of one anchor collapse to one
   with the least doc_id.  The contexts of an anchor are the reference shard
   of all documents that hold the anchor.
4. A suffix automaton is built per shard (``SHARD`` contexts at most).  Its
   states carry the least doc_id among their occurrences.  Streaming a context
   gives the matching statistics, and wherever they reach 50 words the state of
   that window tells the least document that holds it.  An anchor with more
   contexts (a passage shared by very many documents) is split by a second key:
   the 128-bit digest of each window of its contexts, whose grouped minimum is
   the least document.  That is linear in the contexts and no single task.
   Anchors in more than 1 / ``HOT`` of all rows, and contexts in more than
   16 / ``HOT``, are looked up by a broadcast of fewer than ``HOT`` (``HOT``
   / 16) rows, so none of them is dealt to one task; the rest by a shuffle.
5. Windows whose least document is smaller are covered, and the words left are
   joined.

The automata compare whole words, not hashes; only the windows of split anchors
are told apart by their digests.  An automaton goes only to the
documents that hold its anchor, by a shuffle on the anchor, rather than to
every executor: what would be broadcast grows with the corpus.

Null text has no word.  Texts under 50 words keep everything.  A null doc_id
is smaller than none and never removed.  Rows that repeat a doc_id do not
remove each other's words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U, Blob, blobs, window_hashes

WINDOW = 50
ANCHOR = 30
SHARD = 4000
HOT = 1 << 18
_REACH = WINDOW - ANCHOR  # words a window can reach beyond its anchor
_SPREAD = _REACH + 1  # anchors in a window


def _sliding(f, a: np.ndarray, k: int) -> np.ndarray:
    """``f`` (minimum or maximum) of every ``k`` neighbours, by doubling."""
    size = 1
    while 2 * size <= k:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (k - size)], a[k - size:]) if k > size else a


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of one document's word hashes.

    Every window holds a chosen shingle whose hash is the least of the window.
    Of equal least shingles one is enough for all windows that it lies in, so
    a run of one repeated word does not make every position an anchor."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = window_hashes(words, ANCHOR)
    best = _sliding(np.minimum, h, _SPREAD)
    pad = np.zeros(_SPREAD - 1, U)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([pad, best, pad]), _SPREAD) == h)
    value = h[at]
    if (value[1:] == value[:-1]).any():
        wide = np.concatenate([pad, best, pad])
        last_window = np.full(len(at), -1)
        for d in range(_SPREAD - 1, -1, -1):  # last window that holds it as its least
            last_window = np.where(wide[at - d + _SPREAD - 1] == value, at - d, last_window)
        keep, last, v0 = [], -1, None
        for i, (p, w, v) in enumerate(zip(at.tolist(), last_window.tolist(), value.tolist())):
            if v != v0 or last < w:
                keep.append(i)
                last, v0 = p, v
        at = at[keep]
    return at, h[at]


def _words(b: Blob, i: int) -> list[bytes]:
    """The words of document ``i``."""
    lo, hi, base = b.word_offsets[i], b.word_offsets[i + 1], int(b.offsets[i])
    doc = b.data[base: b.offsets[i + 1]].tobytes()
    return [doc[s:e] for s, e in zip((b.starts[lo:hi] - base).tolist(), (b.ends[lo:hi] - base).tolist())]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n_words, sha, at, anchor): the whole text's digest and anchors."""
    out = "doc_id long, t1 long, t2 long, n_words long, sha string, at array<long>, anchor array<long>"

    def run(batches):
        for batch in batches:
            n, sha, at, anchor = [], [], [], []
            for _, _, b in blobs(batch.column(3)):
                data = b.data.tobytes()
                for i in range(b.n):
                    lo, hi = b.word_offsets[i], b.word_offsets[i + 1]
                    p, h = anchors(b.hashes[lo:hi])
                    n.append(hi - lo)
                    sha.append(hashlib.sha256(b" ".join(data[b.offsets[i]: b.offsets[i + 1]].split())).hexdigest())
                    at.append(p)
                    anchor.append(h.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(at, longs), pa.array(anchor, longs)],
                                             names=[c.split()[0] for c in out.split(", ")])

    return _keyed(docs).mapInArrow(run, out)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"),
                       F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def cut_contexts(candidates: DataFrame) -> DataFrame:
    """(anchor, c1, c2, context, doc_id, t1, t2, start, split) of every anchor
    of (doc_id, t1, t2, text, at, anchor, split)."""
    out = "anchor long, context string, doc_id long, t1 long, t2 long, start long, split boolean"

    def run(batches):
        for batch in batches:
            ats, keys, splits = (batch.column(j).to_pylist() for j in (4, 5, 6))
            for a, z, b in blobs(batch.column(3)):
                rows: list[list] = [[], [], [], [], []]
                for i in range(b.n):
                    words = _words(b, i)
                    for p, f, split in zip(ats[a + i], keys[a + i], splits[a + i]):
                        s = max(0, p - _REACH)
                        rows[0].append(f)
                        rows[1].append(b" ".join(words[s: p + ANCHOR + _REACH]).decode())
                        rows[2].append(a + i)
                        rows[3].append(s)
                        rows[4].append(split)
                take = pa.array(rows[2], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                     *(batch.column(j).take(take) for j in range(3)), pa.array(rows[3], pa.int64()),
                     pa.array(rows[4], pa.bool_())],
                    names=[c.split()[0] for c in out.split(", ")])

    return candidates.mapInArrow(run, out).withColumns(
        {"c1": F.xxhash64("context"), "c2": F.xxhash64(F.lit(1), "context")})


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows the least
    document among its occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [1 << 63]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.low.append(1 << 63)
        return len(self.link) - 1

    def _split(self, p: int, x, q: int) -> int:
        """The state of length(p)+1 on the way from p by x, cut off q if needed."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, doc: int) -> None:
        last, nxt, link = 0, self.next, self.link
        for x in words:
            q = nxt[last].get(x)
            if q is not None:
                last = self._split(last, x, q)
            else:
                cur = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and x not in nxt[p]:
                    nxt[p][x] = cur
                    p = link[p]
                if p >= 0:
                    link[cur] = self._split(p, x, nxt[p][x])
                last = cur
            if doc < self.low[last]:
                self.low[last] = doc

    def close(self) -> None:
        """Hand each state's least document up its suffix links."""
        low, link = self.low, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if low[v] < low[link[v]]:
                low[link[v]] = low[v]

    def least(self, words: list, window: int) -> list[int]:
        """For each window of ``words``: the least document that holds it."""
        out = [1 << 63] * max(0, len(words) - window + 1)
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for i, x in enumerate(words):
            while v and x not in nxt[v]:
                v = link[v]
                n = length[v]
            if x in nxt[v]:
                v = nxt[v][x]
                n += 1
            if n >= window:
                while length[link[v]] >= window:  # matches stay at least this long
                    v = link[v]
                n = min(n, length[v])
                out[i - window + 1] = self.low[v]
        return out


def match(contexts: list[tuple[list[str], int]], window: int = WINDOW) -> list[list[int]]:
    """Least document of every window of each (words, least doc) of one anchor."""
    if len(contexts) == 1:  # a shard of one string: every window is its own
        words, doc = contexts[0]
        return [[doc] * max(0, len(words) - window + 1)]
    best: list[list[int]] | None = None
    for a in range(0, len(contexts), SHARD):
        automaton = SuffixAutomaton()
        for words, doc in contexts[a: a + SHARD]:
            automaton.add(words, doc)
        automaton.close()
        got = [automaton.least(words, window) for words, _ in contexts]
        best = got if best is None else [list(map(min, x, y)) for x, y in zip(best, got)]
    return best or []


def _matched(batches):
    """Rows sorted by anchor -> (anchor, c1, c2, least) of contexts that some
    of their documents must give up."""
    held: list[tuple] = []

    def finish():
        rows = [r + (m,) for r, m in zip(held, match([(r[3].split(" "), r[4]) for r in held]))]
        rows = [r for r in rows if r[6] and min(r[6]) < r[5]]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[6] for r in rows], pa.list_(pa.int64()))],
            names=["anchor", "c1", "c2", "least"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield finish()
            held.append(row)
    if held:
        yield finish()


def _windows(batches):
    """(anchor, c1, c2, context, lo, hi) -> every window of the context with its digest."""
    names = ["anchor", "c1", "c2", "lo", "hi", "i", "k1", "k2"]
    for batch in batches:
        take, at, digests = [], [], []
        for j, context in enumerate(batch.column(3).to_pylist()):
            words = context.encode().split(b" ")
            for i in range(len(words) - WINDOW + 1):
                take.append(j)
                at.append(i)
                digests.append(hashlib.sha256(b" ".join(words[i: i + WINDOW])).digest()[:16])
        k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        rows = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in (0, 1, 2, 4, 5)), pa.array(at, pa.int64()),
             pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=names)


def strike(covered: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_removed, kept_sha256, kept) of (key, text, starts): the words
    that no window at ``starts`` covers, joined by one space."""
    out = "".join(f"{c} long, " for c in key) + "n_removed long, kept_sha256 string, kept string"

    def run(batches):
        for batch in batches:
            starts = batch.column(len(key) + 1).to_pylist()
            for a, z, b in blobs(batch.column(len(key))):
                removed, sha, kept = [], [], []
                for i in range(b.n):
                    words = _words(b, i)
                    cover = np.zeros(len(words) + 1, np.int64)
                    s = np.unique(np.array(starts[a + i], np.int64))
                    cover[s] += 1
                    cover[s + WINDOW] -= 1
                    gone = np.cumsum(cover)[:-1] > 0
                    left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).slice(a, z - a) for j in range(len(key))), pa.array(removed, pa.int64()),
                     pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=[c.split()[0] for c in out.split(", ")])

    return covered.select(*key, "text", "starts").mapInArrow(run, out)


def covered_windows(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(prints, covered): the stored digest of every row with ``copy`` set for
    later copies, and (doc_id, t1, t2, text, starts) of every other document
    with a repeated anchor."""
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    key = ["doc_id", "t1", "t2"]
    raw = stored(fingerprint(docs), "prints")
    first = raw.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"))
    prints = raw.join(first, ["t1", "t2"]).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    single = stored(prints.where("not copy and n_words >= 50 and doc_id is not null")
                    .select(*key, F.explode(F.arrays_zip("at", "anchor")).alias("a")).select(*key, "a.at", "a.anchor"), "anchors")
    total = single.count()
    repeated = stored(single.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
                      .where("lo < hi").select("anchor", "n", (F.col("n") > SHARD).alias("split")), "repeated")
    # More than total / HOT rows: fewer than HOT anchors, which are broadcast; their rows stay where they are.
    frequent = F.col("n") > max(SHARD, total // HOT)
    known = single.join(F.broadcast(repeated.where(frequent).select("anchor", "split")), "anchor", "left")
    rare = known.where("split is null").drop("split").join(repeated.where(~frequent).select("anchor", "split"), "anchor")
    found = known.where("split is not null").unionByName(rare)
    wanted = (found.groupBy(*key).agg(F.array_distinct(F.collect_list(F.struct("at", "anchor", "split"))).alias("a"))
              .select(*key, *(F.col(f"a.{c}").alias(c) for c in ("at", "anchor", "split"))))
    texts = stored(_keyed(docs).join(wanted, key).select(*key, "text", "at", "anchor", "split").dropDuplicates(key), "candidates")
    contexts = stored(cut_contexts(texts), "contexts")
    distinct = (contexts.groupBy("anchor", "c1", "c2", "context", "split").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                .select("anchor", "c1", "c2", "context", "lo", "hi", "split"))
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = (distinct.where("not split").drop("split").repartition(shards, "anchor")
             .sortWithinPartitions("anchor", "lo").mapInArrow(_matched, "anchor long, c1 long, c2 long, least array<long>")
             .select("anchor", "c1", "c2", F.transform("least", lambda x, i: F.struct(x.alias("d"), i.cast("long").alias("i"))).alias("least")))
    windows = stored(distinct.where("split").drop("split").mapInArrow(
        _windows, "anchor long, c1 long, c2 long, lo long, hi long, i long, k1 long, k2 long"), "windows")
    again = windows.groupBy("k1", "k2").agg(F.min("lo").alias("d"), F.max("hi").alias("top")).where("d < top").drop("top")
    split = (windows.join(again, ["k1", "k2"]).where("d < hi")
             .groupBy("anchor", "c1", "c2").agg(F.collect_list(F.struct("d", "i")).alias("least")))
    one = ["anchor", "c1", "c2"]
    least = stored(least.unionByName(split), "least")
    # The same for contexts that very many documents share: fewer than HOT // 16, each with 21 windows at most.
    often = contexts.groupBy(*one).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(SHARD, total // (HOT // 16)))
    often = often.join(least, one, "left").select(*one, F.coalesce("least", F.array()).alias("least"))
    held = contexts.select(*one, *key, "start").join(F.broadcast(often), one, "left")
    seldom = held.where("least is null").drop("least").join(least, one)
    hit = (held.where("least is not null").unionByName(seldom)
           .select(*key, F.transform(F.filter("least", lambda s: s["d"] < F.col("doc_id")), lambda s: s["i"] + F.col("start")).alias("s"))
           .where(F.size("s") > 0).groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts")))
    hit = stored(hit, "covered")
    return prints.select(*key, "n_words", "sha", "copy"), texts.select(*key, "text").join(hit, key)


def remove_repeats(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.  ``folder`` is a
    fresh place in shared storage for the intermediate tables."""
    prints, covered = covered_windows(docs, folder)
    key = ["doc_id", "t1", "t2"]
    struck = strike(covered, key).drop("kept")
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    return prints.join(struck, key, "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
