"""Near-duplicate classes by Order MinHash and banded alignment.

A text's words are the maximal runs of non-space bytes (A-Z as a-z); its
k-mers are five consecutive words, each labelled with its occurrence number so
that repeats count.  A text of one to four words is one k-mer.  For each of
``SKETCHES`` hash functions the ``PICK`` k-mers with the least hashes are kept
*in text order*; the hash of that ordered list is a bucket key.  Two texts
share a key with probability near s**4 for ordered similarity s, so at 0.8 a
pair misses every one of the 28 buckets with probability (1-0.41)**28, about
4e-7, while texts that share a passage alone seldom meet.

Candidates are verified exactly: the number of k-mers matched in order is the
longest common subsequence of the two k-mer sequences, aligned within the band
that a similarity of 0.8 allows, and similarity is matched over (a + b -
matched).  0.8 or more is a link; classes are connected components.

Equal word sequences collapse first (grouped by a 128-bit digest), so a large
group of copies is one row from there on.  Buckets are then worked off in two
steps.  First each bucket's ``LEADERS`` members that share most buckets meet
the bucket, which joins a group of near copies at a cost linear in its size.
Then every pair of a bucket that is still in different classes is tested by
two exact bounds: the lengths, and the number of common 16-bit marks of the
labelled k-mers, which is never less than the number of common k-mers.
Pairs that pass are verified; a pair with several common buckets is tested in
the least one only.  So no link between texts that share a bucket is lost, and
dissimilar texts of one bucket never become rows.  Buckets are cut into blocks
of ``BLOCK`` members, and pairs of blocks are tested by different tasks.

Null or empty texts have no word: each stays alone.  Repeated doc_ids keep one
row each; if their texts differ, the id takes part with the text of the least
digest and all its rows get that class.  Class id: the least doc_id of the
class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import connected, relabel
from .text import U, blobs, mix, window_hashes

K = 5
SIMILARITY = 0.8
SKETCHES = 28
PICK = 4
LEADERS = 3
BLOCK = 1000


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers in text order (occurrences not yet labelled)."""
    return window_hashes(words, min(K, len(words))) if len(words) else np.zeros(0, U)


def labelled(h: np.ndarray) -> np.ndarray:
    """Each k-mer hash mixed with its occurrence number in the text."""
    o = np.argsort(h, kind="stable")
    s = h[o]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = np.empty_like(h)
    out[o] = mix(s + U(0x9E3779B97F4A7C15) * (np.arange(len(s)) - start).astype(U))
    return out


def sketch(h: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """One key per salt: the PICK least k-mers, in text order."""
    x = labelled(h)
    pick = min(PICK, len(x))
    order = (x[None, :] ^ salts[:, None]) * U(0x9E3779B97F4A7C15)
    order ^= order >> U(29)
    order *= U(0xBF58476D1CE4E5B9)
    at = np.argpartition(order, pick - 1, axis=1)[:, :pick] if pick < len(x) else np.tile(np.arange(pick), (len(salts), 1))
    at.sort(axis=1)
    key = salts.copy()
    for j in range(pick):
        key = mix(key + x[at[:, j]])
    return key


def _salts() -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, SKETCHES, dtype=U)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, keys): the digest of the word sequence, the number
    of k-mers and the bucket keys; a text without words has a null digest."""
    out = "doc_id long, digest binary, n long, keys array<long>"

    def run(batches):
        salts = _salts()
        for batch in batches:
            digest, n, keys = [], [], []
            for _, _, b in blobs(batch.column(1), lower=True):
                for i in range(b.n):
                    w = b.hashes[b.word_offsets[i]: b.word_offsets[i + 1]]
                    h = kmers(w)
                    n.append(len(h))
                    digest.append(_digest(w))
                    keys.append(sketch(h, salts).view(np.int64) if len(w) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def needed(a: int, b: int) -> int:
    """Least number of matched k-mers with matched/(a+b-matched) >= 0.8."""
    return -(-4 * (a + b) // 9)


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """K-mers matched in order: longest common subsequence within the band.

    Common ends are matched first.  The rest is aligned bit-parallel: bit j of
    ``v`` is 0 where the common length grows at b[j].  Row i may use only the
    columns within ``band`` of its diagonal; an alignment that reaches the
    needed count leaves at most ``band`` k-mers of either side unmatched and so
    never leaves the band."""
    short = min(len(a), len(b))
    d = np.flatnonzero(a[:short] != b[:short])
    head = int(d[0]) if len(d) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    d = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(d[0]) if len(d) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    total_a, total_b = len(a) + head + tail, len(b) + head + tail
    band = total_a + total_b - 2 * needed(total_a, total_b)
    if head + tail + int(np.isin(a, b).sum()) < needed(total_a, total_b):
        return head + tail  # too few common k-mers in any order
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    width = (1 << (2 * band + 1)) - 1
    for i, x in enumerate(a.tolist()):
        m = where.get(x)
        if m:
            m &= width << (i - band) if i >= band else width >> (band - i)
            u = v & m
            if u:
                v = ((v + u) | (v - u)) & full
    return head + tail + len(b) - v.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    need = needed(len(a), len(b))
    if min(len(a), len(b)) < need:
        return False
    return aligned(a, b) >= need


def _digest(words: np.ndarray) -> bytes | None:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text, marks) of the wanted (id, digest): one row per id; ``marks``
    holds 16 bits of every labelled k-mer."""
    def run(batches):
        for batch in batches:
            digests, marks = [], []
            for _, _, b in blobs(batch.column(2), lower=True):
                for i in range(b.n):
                    w = b.hashes[b.word_offsets[i]: b.word_offsets[i + 1]]
                    digests.append(_digest(w))
                    marks.append((labelled(kmers(w)) >> U(48)).astype("<u2").tobytes())
            same = pa.array([x == y for x, y in zip(digests, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, pa.binary())],
                                             names=["id", "text", "marks"]).filter(same)

    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id")
    return picked.select("id", "digest", "text").mapInArrow(run, "id long, text string, marks binary").dropDuplicates(["id"])


def _verified(pairs: DataFrame) -> DataFrame:
    """Links among (a, b, ta, tb): texts are aligned exactly."""
    def rows(col: pa.Array) -> list[np.ndarray]:
        return [kmers(b.hashes[b.word_offsets[i]: b.word_offsets[i + 1]])
                for _, _, b in blobs(col, lower=True) for i in range(b.n)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keep = [similar(x, y) for x, y in zip(rows(part.column(2)), rows(part.column(3)))]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _open_pairs(batches):
    """Rows (key, p, q, block, id, class, n, keys, marks) sorted by (key, p, q)
    -> pairs of different classes that pass both bounds."""
    held: list[pa.Table] = []

    def finish() -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        held.clear()
        n = t["n"].to_numpy()
        t = t.take(pa.array(np.argsort(n, kind="stable")))
        key, two = t["key"][0].as_py(), t["p"][0].as_py() != t["q"][0].as_py()
        ids, cls, n, block = (t[c].to_numpy() for c in ("id", "class", "n", "block"))
        keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        marks = np.frombuffer(b"".join(t["marks"].to_pylist()), "<u2")
        at = np.concatenate([[0], np.cumsum(n)])
        seen = np.zeros(1 << 16, bool)
        a, b = [], []
        for i in range(len(ids) - 1):
            z = int(np.searchsorted(n, n[i] * 5 // 4, "right"))  # the length bound
            meet = cls[i + 1: z] != cls[i]
            if two:
                meet &= block[i + 1: z] != block[i]
            if not meet.any():
                continue
            seen[marks[at[i]: at[i + 1]]] = True
            most = np.add.reduceat(seen[marks[at[i + 1]: at[z]]], at[i + 1: z] - at[i + 1], dtype=np.int64)
            seen[marks[at[i]: at[i + 1]]] = False
            j = i + 1 + np.flatnonzero(meet & (9 * most >= 4 * (n[i + 1: z] + n[i])))
            smaller = keys[i][keys[i] < key]
            if len(j) and len(smaller):
                j = j[~np.isin(keys[j], smaller).any(axis=1)]
            a += [ids[i]] * len(j)
            b += ids[j].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
            now = tuple(group[a])
            if held and now != last:
                yield finish()
            held.append(pa.Table.from_batches([batch.slice(a, z - a)]))
            last = now
    if held:
        yield finish()


def near_duplicates(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_copies): one row per input row.

    ``folder`` is a fresh place in shared storage; fingerprints, candidate
    texts, links and classes are written there, so no step depends on
    executor-local data."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    prints = stored(fingerprint(docs), "prints")
    words = prints.where("digest is not null and doc_id is not null")
    copies = stored(words.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_copies")), "copies")
    chosen = copies.groupBy("id").agg(F.min("digest").alias("digest"))
    reps = stored(words.join(chosen, "digest").where("doc_id = id").dropDuplicates(["id"])
                  .select("id", "digest", "n", "keys"), "reps")
    entry = reps.select("id", "n", F.explode("keys").alias("key"))
    # Keys that two texts share; everything else is settled.
    shared = entry.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(entry.join(shared, "key"), "members")
    central = members.groupBy("id").agg(F.sum("size").alias("weight"))
    wanted = reps.select("id", "digest").join(central.select("id"), "id")
    texts = stored(_texts_of(docs, wanted), "texts")

    def merged(classes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """Verify the pairs and join the classes that they link."""
        with_b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(pairs, "b")
        both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        links = stored(_verified(both.select("a", "b", "ta", "tb")), f"links-{name}")
        linked = (links.join(classes.select(F.col("id").alias("a"), F.col("class").alias("x")), "a")
                  .join(classes.select(F.col("id").alias("b"), F.col("class").alias("y")), "b").select("x", "y"))
        return stored(relabel(classes, connected(linked, f"{folder}/merge-{name}")), f"classes-{name}")

    classes = central.select("id", F.col("id").alias("class"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "id"))
    leaders = (members.join(central, "id").withColumn("r", rank).where(F.col("r") <= LEADERS)
               .select("key", F.col("id").alias("a"), F.col("n").alias("na")))
    stars = (leaders.join(members.select("key", F.col("id").alias("b"), F.col("n").alias("nb")), "key")
             .where((F.col("a") != F.col("b")) & (9 * F.least("na", "nb") >= 4 * (F.col("na") + F.col("nb"))))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    classes = merged(classes, stars, "stars")

    now = members.join(classes, "id")
    mixed = (now.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
             .where("lo != hi").select("key"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = (now.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "class", "n"))
    rows = rows.join(reps.select("id", "keys"), "id").join(texts.select("id", "marks"), "id")
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = (rows.select("key", "p", "q", "block", "id", "class", "n", "keys", "marks").repartition(shards, "key", "p", "q")
             .sortWithinPartitions("key", "p", "q").mapInArrow(_open_pairs, "a long, b long"))
    classes = merged(classes, stored(pairs, "open-pairs"), "pairs")

    known = copies.join(classes, "id", "left").select("digest", F.coalesce("class", "id").alias("class_id"), "n_copies")
    return prints.select("doc_id", "digest").join(known, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
