"""Sequence packing by minimum bin slack.

Every document becomes token ids plus one closing id 0.  It is cut at
multiples of the window: the full pieces fill a window each, and what remains
(1 to window-1 ids) is packed with others.  Only the histogram of remaining
lengths (at most window-1 rows) reaches the driver.  There each window starts
with the longest remaining length, and a bitset subset-sum dynamic programme
over the multiset of remaining lengths finds the total closest to capacity;
backtracking gives the count of every length.  A found multiset is applied as
often as the counts allow, so the number of programmes depends on the window
and not on the rows.  Rows then find their window by their rank within their
length.

Null text is empty and packs as the single id 0.  Repeated rows are separate
documents.  An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import binary_parts, process_cache

WINDOW = 1024
CHUNK_BYTES = 1 << 23
ROWS_PER_BUCKET = 100_000
# White space of any Unicode version, and Python's \x1c-\x1f.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200C))) +
                  "\u2028\u2029\u202f\u205f\u3000"])


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of spaces between two non-spaces of one document.  A pre-token
    always starts there, so a text may be cut before such a space and each
    part encoded alone."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(data == 0x20)
    at = at[~(edge[at] | edge[at + 1])]
    left, right = data[at - 1], data[at + 1]
    ok = ~(_BLANK[left] | _BLANK[right])
    last = len(data) - 1
    for side, places in ((left, (-3, -2, -1)), (right, (1, 2, 3))):
        i = np.flatnonzero(side >= 0x80)
        a, b, c = (data[np.minimum(at[i] + d, last)].astype(np.int64) for d in places)
        two = b << 8 | c if places[0] < 0 else a << 8 | b
        ok[i[np.isin(two, _WIDE) | np.isin(a << 16 | b << 8 | c, _WIDE)]] = False
    return at[ok]


class Encoder:
    """Token ids of many texts at once: texts are cut into parts (``cuts``),
    and every distinct part is encoded once.

    The ids are those of the ``tokenizers`` file.  Parts without a special
    token's text go through the same vocabulary as ranks, which is faster and
    gives equal ids (tests/llm compares them)."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        c = process_cache()
        if ("encoder", name) not in c:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
            exact = Tokenizer.from_file(P.path(f"{name}.json"))
            sizes = {b: len(a) for a, b in ranks.items()} | {i: len(t.content.encode()) for i, t in exact.get_added_tokens_decoder().items()}
            size = np.zeros(max(sizes) + 1, np.int64)
            size[list(sizes)] = list(sizes.values())
            c["encoder", name] = (exact, tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), size)
        self.exact, self.fast, self.size = c["encoder", name]

    def part(self, s: str) -> list[int]:
        return self.exact.encode(s, add_special_tokens=False).ids if "<|" in s else self.fast.encode_ordinary(s)

    def distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and where each part's ids start.  Parts
        that may follow each other in a text are encoded in one call."""
        data, off = binary_parts(parts)
        alone = pc.match_substring(parts, "<|").to_numpy(zero_copy_only=False)
        joined = np.zeros(len(data) + 1, bool)
        joined[cuts(data, off[[0, -1]])] = True
        joined = joined[off]
        joined[:-1] &= ~alone
        joined[1:] &= ~alone
        joined &= np.diff(off >> 20, prepend=0) == 0  # at most a megabyte and a part per call
        stops, raw = off[~joined].tolist(), data.tobytes()
        ids = np.concatenate([np.zeros(0, "<u4")] + [np.array(self.part(raw[a:b].decode()), "<u4") for a, b in zip(stops, stops[1:])])
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        first = np.searchsorted(ends, off)
        if not np.array_equal(ends[first], off):
            raise ValueError("a part does not start at a token")
        return ids, first

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offsets[i]: offsets[i + 1]]`` in a row, and
        where each text's ids start."""
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        start[cuts(data, offsets)] = True
        bounds = np.flatnonzero(start)
        parts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        ids, first = self.distinct(coded.dictionary)
        which = coded.indices.to_numpy()
        n = np.diff(first)[which]
        at = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first[which] - at[:-1], n)
        take += np.arange(at[-1])
        return ids[take], at[np.searchsorted(bounds, offsets)]

    def __call__(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.ids(raw, np.array([0, len(raw)]))[0].tobytes()

    def column(self, texts: pa.Array):
        """Ids of every text as little-endian uint32 bytes; null is empty."""
        data, off = binary_parts(texts)
        a, n = 0, len(off) - 1
        while a < n:  # whole texts, at least one
            b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_BYTES, "right")) - 1)
            raw = data[off[a]: off[b]]
            if len(raw) > CHUNK_BYTES:  # one long text, in pieces
                at = cuts(raw, np.array([0, len(raw)]))
                stops = [0, *at[np.diff(at // CHUNK_BYTES, prepend=0) > 0].tolist(), len(raw)]
                yield b"".join(self.ids(raw[i:j], np.array([0, j - i]))[0].tobytes() for i, j in zip(stops, stops[1:]))
            else:
                ids, at = self.ids(raw, off[a: b + 1] - off[a])
                for i, j in zip(at, at[1:]):
                    yield ids[i:j].tobytes()
            a = b


def tokenize(docs: DataFrame, window: int = WINDOW, keep_ids: bool = False, tokenizer: str = "byte_bpe_50k",
             end_id: int = 0) -> DataFrame:
    """(doc_id, doc_tokens, crcs[, ids]): the length with the closing id, and
    the crc32 of every cut piece of ``window`` ids."""
    out = "doc_id long, doc_tokens long, crcs array<long>" + (", ids binary" if keep_ids else "")

    def run(batches):
        enc, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            n, crcs, ids = [], [], []
            for b in enc.column(batch.column(1)):
                b += end
                n.append(len(b) // 4)
                crcs.append([zlib.crc32(b[i: i + 4 * window]) for i in range(0, len(b), 4 * window)])
                if keep_ids:
                    ids.append(b)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if keep_ids else []),
                                             names=[c.split()[0] for c in out.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def fill(counts: dict[int, int], room: int) -> Counter:
    """The multiset of lengths, within ``counts``, whose sum comes closest to
    ``room`` from below: bit s of ``reach`` says that sum s can be made."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, 2 * k
        if reach >> room:
            break
    s, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> s & 1:
            used[length] += take
            s -= length * take
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, first window, uses per window, offset) and
    the number of windows: rank r of ``length`` from ``first rank`` on lies in
    window ``first + i // uses`` at ``offset + (i % uses) * length``."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    done: Counter = Counter()
    segments, windows = [], 0
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fill({k: v for k, v in counts.items() if v}, window - seed)
        counts[seed] += 1
        used[seed] += 1
        times = min(counts[k] // u for k, u in used.items())
        offset = 0
        for k, u in sorted(used.items(), reverse=True):
            segments.append((k, done[k], windows, u, offset))
            offset += k * u
            done[k] += u * times
            counts[k] -= u * times
            if not counts[k]:
                del counts[k]
        windows += times
    return segments, windows


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  ``tokens`` must be stored (it is read several times
    and its row order within files gives the ids of the full windows)."""
    spark = tokens.sparkSession
    t = tokens.select("doc_id", "doc_tokens", "crcs", F.monotonically_increasing_id().alias("row"))
    rest = t.select("doc_id", "row", "doc_tokens", (F.col("doc_tokens") % window).alias("length"),
                    F.element_at("crcs", -1).alias("crc")).where("length > 0")
    sizes = rest.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.collect()}  # at most window - 1 rows
    segments, windows = plan(histogram, window)
    buckets = max(1, -(-sum(histogram.values()) // ROWS_PER_BUCKET))

    # Rank within a length, without one task per length: count by (length,
    # bucket), prefix sums over buckets, and a local rank in each bucket.
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = rest.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    local = rest.withColumn("i", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = local.join(before, ["length", "bucket"]).select(
        "doc_id", "doc_tokens", "length", "crc", (F.col("base") + F.col("i")).alias("rank"))

    order = sorted(segments)
    table = {k: np.array([s[i] for s in order], np.int64) for i, k in enumerate(("length", "rank", "window", "uses", "offset"))}
    shared = spark.sparkContext.broadcast(table)  # bounded by the window, not by the rows

    def place(batches):
        s = shared.value
        key = s["length"] * (1 << 45) + s["rank"]
        for batch in batches:
            doc, total, length, crc, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            j = np.searchsorted(key, length * (1 << 45) + rank, "right") - 1
            i = rank - s["rank"][j]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total - length), pa.array(length), pa.array(crc), pa.array(total),
                 pa.array(s["window"][j] + i // s["uses"][j]),
                 pa.array(s["offset"][j] + i % s["uses"][j] * length)], names=[c.split()[0] for c in OUT.split(", ")])

    packed = ranked.mapInArrow(place, OUT)
    full = (t.where(F.col("doc_tokens") >= window)
            .select("doc_id", "doc_tokens", F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("doc_tokens") / window).cast("int"))).alias("j", "crc"))
            .select("doc_id", (F.col("j") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
                    F.col("crc").alias("ids_crc32"), "doc_tokens",
                    (F.monotonically_increasing_id() + F.lit(windows)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """Tokenise once into ``folder`` (shared storage; lengths and digests, no
    ids), then pack."""
    tokenize(docs, window).write.mode("overwrite").parquet(folder)
    return pack(docs.sparkSession.read.parquet(folder), window)
