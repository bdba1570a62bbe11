"""Cross-tokenizer alignment of a byte-level BPE (A) and a piece BPE (B).

Both encode the same bytes, `space + text`.  The character offsets of
``tokenizers`` and the byte spans of sentencepiece's proto are the coarse cuts:
positions that no token of either side straddles.  Inside a coarse segment the
spans give the token ends, unless a span and its token's own bytes differ in
length (a character split over tokens, byte fallback); such a segment is
refined with the decoded bytes of its tokens.  Ends that both sides share cut
the tokens into groups; every interval between two neighbouring ends of either
side is one link, the only overlap of its A and its B token.

A space between two non-spaces is an end on both sides: A starts a new
pre-token there, and no piece of B holds a space after another character
(checked when the model is loaded; otherwise texts are not split).  Texts are
therefore split there, and each distinct part is aligned once per worker.

The count of an id pair is corpus-wide.  Pairs are counted by a grouped sum
over the distinct pairs of every document.  The most frequent pairs (at most
``HEAD``) go to the tasks by broadcast; the others are looked up by a join on
the pair, whose rows per key lie below the head's least count.

Null or empty texts, and texts whose tokens do not decode to `space + text`
(one holds U+2581, say), have no tokens: zeros and ''.  Rows with a null
doc_id and repeated rows are documents of their own and count as such.  Texts
of any length are aligned whole.  An empty table gives no row.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import process_cache

CACHE_PARTS = 400_000
RUN_CHARS = 1 << 14
CHUNK_CHARS = 1 << 20
HEAD = 1 << 19
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_RISK = re.compile(r" (?:\s|\Z|(?<=\A )|(?<=\s ))")
SPACE = "▁"


def _byte_level() -> dict[str, int]:
    """Character -> byte of byte-level BPE entries: printable bytes stand for
    themselves, the others follow from U+0100 on in ascending order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        table = _byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            self.a_bytes[i] = bytes(table[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, texts: list[str]):
        """Per text the ids and the byte spans (starts, stops) within
        space + text, of A and of B."""
        whole = [" " + t for t in texts]
        for s, x, y in zip(whole, self.a.encode_batch(whole, add_special_tokens=False),
                           self.b.encode(texts, return_type="proto", num_threads=1)):
            a = np.array(x.offsets, np.int64).reshape(-1, 2)
            if not s.isascii():  # character to byte positions
                c = np.frombuffer(s.encode("utf-32-le"), np.uint32)
                a = np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])[a]
            pieces = y.pieces
            b = [np.array(v, np.int64) for v in ([p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces])]
            b[1] += 1
            b[1][:1] = 0  # the space that B adds has no place in the text
            b[2] += 1
            yield s.encode(), (np.array(x.ids, np.int64), a[:, 0], a[:, 1]), b


def _cuts(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose end no token straddles, and those ends."""
    reach = np.maximum.accumulate(stops)
    free = np.append(starts[1:] >= reach[:-1], True)
    return np.flatnonzero(free), reach[free]


def _ends(starts, stops, lengths, cuts) -> np.ndarray:
    """Byte end of every token: its span's, or from its own bytes in a segment
    between two ``cuts`` (tokens, positions) whose spans do not fit them."""
    own = np.cumsum(lengths)
    sure = own[cuts[0]] == cuts[1]  # tokens with empty spans may follow a position
    last, position = cuts[0][sure], cuts[1][sure]
    before = np.concatenate([[0], position])
    segment = np.searchsorted(last, np.arange(len(stops)))
    fits = (starts == np.concatenate([[0], stops[:-1]])) & (stops - starts == lengths)
    rough = np.bincount(segment, ~fits, len(before)) > 0
    begun = np.concatenate([[0], own[last]])
    return np.where(rough[segment], before[segment] + own - begun[segment], stops)


def token_ends(a, b, a_lengths, b_lengths) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of the A and B tokens of one text from (ids, starts, stops)
    and the lengths of the tokens' own bytes: coarse where both sides' spans
    have a common cut, refined between."""
    x, y = _cuts(a[1], a[2]), _cuts(b[1], b[2])
    cuts = [(t[k := q[np.searchsorted(q, p)] == p], p[k]) for (t, p), q in ((x, y[1]), (y, x[1]))]
    return _ends(a[1], a[2], a_lengths, cuts[0]), _ends(b[1], b[2], b_lengths, cuts[1])


class Aligner:
    """Alignments of parts, kept per worker: at most ``CACHE_PARTS``, of which
    the most used half stays when there are more."""

    def __init__(self, a_file: str, b_file: str):
        c = process_cache()
        if ("align", a_file, b_file) not in c:
            t = Tokenizers(a_file, b_file)
            name = [f"{i}{x}" for i in range(max(len(t.a_bytes), len(t.b_bytes))) for x in ",|;"]
            c["align", a_file, b_file] = t, name, np.array([len(x) for x in name], np.int64)
        self.t, self.name, self.width = c["align", a_file, b_file]
        self.known, self.groups = {}, []
        # per part: n_a, n_b, n_groups, links, first link, bad, uses
        self.info, self.links, self.used = np.zeros((7, 1024), np.int64), np.zeros(4096, np.int64), 0

    def shrink(self):
        uses = self.info[6, :len(self.groups)]
        keep = np.sort(np.argsort(-uses, kind="stable")[: CACHE_PARTS // 2])
        names = list(self.known)
        size, first = self.info[3, keep], self.info[4, keep]
        begin = np.cumsum(size) - size
        self.links = self.links[np.repeat(first - begin, size) + np.arange(int(size.sum()))]
        self.used = len(self.links)
        self.info = self.info[:, keep]
        self.info[4], self.info[6] = begin, self.info[6] // 2
        self.groups = [self.groups[i] for i in keep]
        self.known = {names[i]: k for k, i in enumerate(keep)}

    def store(self, parts: list[str], info: np.ndarray, groups: list[str], links: np.ndarray):
        """``info``: n_a, n_b, n_groups, links, bad of each part."""
        n, m = len(self.groups), len(parts)
        while self.info.shape[1] < n + m:
            self.info = np.concatenate([self.info, np.zeros_like(self.info)], 1)
        while len(self.links) < self.used + len(links):
            self.links = np.concatenate([self.links, np.zeros(max(len(links), len(self.links)), np.int64)])
        self.links[self.used: self.used + len(links)] = links
        self.info[:4, n: n + m], self.info[5, n: n + m], self.info[6, n: n + m] = info[:4], info[4], 0
        self.info[4, n: n + m] = self.used + np.cumsum(info[3]) - info[3]
        self.used += len(links)
        self.groups += groups
        self.known.update(zip(parts, range(n, n + m)))

    def add(self, parts: list[str]):
        """Aligns new parts.  Parts between non-spaces are encoded many at a
        time, one space between; the others alone."""
        alone = [p for p in parts if p[0].isspace() or p[-1].isspace() or SPACE in p or not self.t.splits]
        rest = set(alone)
        runs, run, size = [[p] for p in alone], [], 0
        for p in parts:
            if p not in rest:
                run.append(p)
                size += len(p)
                if size > RUN_CHARS:
                    runs.append(run)
                    run, size = [], 0
        if run:
            runs.append(run)
        self.encode(runs)

    def encode(self, runs: list[list[str]]):
        t = self.t
        for run, (text, a, b) in zip(runs, t.encode([" ".join(r) for r in runs])):
            if b"".join([t.a_bytes[i] for i in a[0]]) != text or b"".join([t.b_bytes[i] for i in b[0]]) != text:
                if len(run) > 1:
                    self.encode([[p] for p in run])
                else:
                    self.store(run, np.array([[0], [0], [0], [0], [1]]), [""], np.zeros(0, np.int64))
                continue
            a_ends, b_ends = token_ends(a, b, t.a_size[a[0]], t.b_size[b[0]])
            ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
            again = np.append(False, ends[1:] == ends[:-1])
            cut, ends = ends[again], ends[~again]
            links = a[0][np.searchsorted(a_ends, ends)] << 32 | b[0][np.searchsorted(b_ends, ends)]
            part = np.cumsum([len(p.encode()) + 1 for p in run])
            upto = [np.searchsorted(x, part, "right") for x in (a_ends, b_ends, cut, ends)]
            info = np.stack([*(np.diff(x, prepend=0) for x in upto), np.zeros(len(run), np.int64)])
            text, at = self.write(a[0], b[0], a_ends, b_ends, cut, upto[2])
            self.store(run, info, [text[x:y - 1] for x, y in zip(at, at[1:])], links)

    def write(self, a_ids, b_ids, a_ends, b_ends, cut, upto):
        """The groups of a run as one text, each followed by ';', and where
        each part begins (``upto``: groups up to the end of every part)."""
        group = np.concatenate([np.searchsorted(cut, a_ends), np.searchsorted(cut, b_ends)])
        n_a, n = len(a_ids), len(group)
        order = np.argsort(group, kind="stable")  # A tokens stand before B tokens
        group, is_a = group[order], order < n_a
        ids = np.concatenate([a_ids, b_ids])[order]
        mark = np.zeros(n, np.int64)  # 0 ',', 1 '|', 2 ';'
        mark[:-1][is_a[:-1] & ~is_a[1:]] = 1
        mark[np.append(group[1:] != group[:-1], True)] = 2
        code = ids * 3 + mark
        end = np.cumsum(self.width[code])[mark == 2]
        return "".join(map(self.name.__getitem__, code.tolist())), [0, *end[upto - 1].tolist()]

    def __call__(self, texts: list[str]):
        """Per text: n_a, n_b, n_groups, n_links (4 x n), the digests, and the
        distinct pairs with counts as (offsets, pairs, counts)."""
        split = [[] if not t else _SAFE.split(t) if _RISK.search(t) else t.split(" ") for t in texts] if self.t.splits else \
            [[t] if t else [] for t in texts]
        if len(self.known) > CACHE_PARTS:
            self.shrink()
        known = self.known
        self.add([p for p in dict.fromkeys(chain.from_iterable(split)) if p not in known])
        n = np.array([len(p) for p in split], np.int64)
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(texts)), n)
        bad = np.bincount(doc, self.info[5, flat], len(texts)) > 0
        if bad.any():  # a part alone may not decode where the whole text does
            for i in np.flatnonzero(bad & (n > 1)).tolist():
                if texts[i] not in known:
                    self.encode([[texts[i]]])
            rows = np.split(flat, np.cumsum(n)[:-1])
            for i in np.flatnonzero(bad).tolist():
                k = known[texts[i]]
                rows[i] = np.zeros(0, np.int64) if self.info[5, k] else np.array([k])
            n = np.array([len(r) for r in rows], np.int64)
            flat, doc = np.concatenate(rows), np.repeat(np.arange(len(texts)), n)
        self.info[6, :len(self.groups)] += np.bincount(flat, minlength=len(self.groups))
        groups, end, sha = self.groups, np.cumsum(n).tolist(), []
        listed = flat.tolist()
        for i, z in zip([0, *end], end):
            sha.append(hashlib.sha256(";".join([groups[k] for k in listed[i:z]]).encode()).hexdigest() if z > i else "")
        size = self.info[3, flat]
        owner = np.repeat(doc, size)
        pairs = self.links[np.repeat(self.info[4, flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        sums = np.stack([np.bincount(doc, self.info[k, flat], len(texts)) for k in range(4)]).astype(np.int64)
        o = np.lexsort((pairs, owner))
        pairs, owner = pairs[o], owner[o]
        first = np.ones(len(o), bool)
        first[1:] = (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        offsets = np.searchsorted(owner[at], np.arange(len(texts) + 1))
        return sums, sha, (offsets, pairs[at], np.diff(np.append(at, len(o))))


SPANS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pair array<long>, n array<long>")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _lists(offsets, *values):
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int64())) for v in values]


def align_documents(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Per row of (doc_id, text): token, group and link counts, the digest of
    the groups, and the distinct linked pairs (A id * 2^32 + B id) with counts."""

    def run(batches):
        do = Aligner(a_file, b_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, i = batch.column(0), 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j] or "") <= CHUNK_CHARS):
                    chars += len(texts[j] or "")
                    j += 1
                sums, sha, (offsets, pairs, counts) = do(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *map(pa.array, sums), pa.array(sha, pa.string()), *_lists(offsets, pairs, counts)],
                    names=_names(SPANS))
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def pair_counts(spans: DataFrame) -> DataFrame:
    """(pair, total, best): links of every id pair in the corpus, and whether
    it is its B id's highest (ties included).  The highest counts are one row
    per B id, bounded by B's vocabulary."""
    each = spans.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(
        F.sum("x.n").alias("total"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return each.withColumn("b", b)


def _head(counts: DataFrame, head: int):
    """The most frequent pairs, at most ``head``: all pairs from some count
    step (1/16 octave) on, so that no task sorts the pairs."""
    step, n, least = F.floor(F.log2("total") * 16), 0, None
    for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("s")).collect():
        n += r["c"]
        if n > head:
            break
        least = r["s"]
    top = counts.where(step >= least if least is not None else F.lit(False)).select("pair", "total", "best").toArrow()
    pair, total, best = (top[c].to_numpy() for c in ("pair", "total", "best"))
    o = np.argsort(pair)
    return pair[o], total[o], best[o].astype(np.int64)


PART = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "n_best long, count_sum long, pair array<long>, n array<long>")


def alignment(docs: DataFrame, folder: str, a_file: str, b_file: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    of every row; tokens are made once, into ``folder`` (shared storage)."""
    spark = docs.sparkSession
    align_documents(docs, a_file, b_file).write.mode("overwrite").parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans")
    pair_counts(spans).write.mode("overwrite").parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))  # at most B's vocabulary
    totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best")) \
        .write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    shared = spark.sparkContext.broadcast(_head(counts, head))

    def run(batches):
        pair, total, best = shared.value
        for batch in batches:
            x, n = (batch.column(i).flatten().to_numpy() for i in (6, 7))
            size = batch.column(6).value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(pair, x), max(len(pair) - 1, 0))
            hit = pair[at] == x if len(pair) else np.zeros(len(x), bool)
            sums = [np.zeros(len(size), np.int64) for _ in range(2)]
            for out, v in zip(sums, (best, total)):
                c = np.zeros(len(x) + 1, np.int64)
                np.cumsum(np.where(hit, n * v[at] if len(pair) else 0, 0), out=c[1:])
                end = np.cumsum(size)
                out += c[end] - c[end - size]
            rest = ~hit
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[rest], minlength=len(size)))])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), *map(pa.array, sums),
                                              *_lists(offsets, x[rest], n[rest])], names=_names(PART))

    spans.mapInArrow(run, PART).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/part")
    part = spark.read.parquet(f"{folder}/part")
    rare = part.select("row", F.explode(F.arrays_zip("pair", "n")).alias("x")).select("row", "x.pair", "x.n")
    more = rare.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("total")).alias("c"))
    return part.drop("pair", "n").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"), "groups_sha256")
