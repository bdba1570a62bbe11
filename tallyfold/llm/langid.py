"""Language identification by prediction by partial matching (PPM).

Training counts, for every language, the bytes that follow each context of 0
to ``ORDER`` bytes: a variable-order context tree.  With frozen counts the
code length of a byte after its context follows PPM method C: a context of
total ``n`` with ``d`` distinct followers codes a known follower ``s`` with
probability c(s)/(n+d) and escapes to the next shorter context with d/(n+d);
a context that was never seen costs nothing; below order 0 every byte has
probability 1/256.  A document's score under a language is the exact sum of
its bytes' code lengths, over the whole text; the lowest sum wins.

The trees are fitted on a bounded sample: about ``docs_per_lang`` whole
documents per language, chosen by a hash of the id.  Counting runs in Spark
(partial sums per task); the tree that reaches the driver is bounded by that
sample, and contexts of order 2 and more seen once are dropped.

Null text, or text without a letter: ``und``, score 0.  No training row at
all: ``und`` for every row.  Ties go to the language first in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import place, threshold
from .text import U, binary_parts

ORDER = 4
DOCS_PER_LANG = 1500
CHUNK = 1 << 18


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Key of the ``k`` bytes that end at each position from ORDER on."""
    n = len(data) - ORDER
    key = np.zeros(n, U)
    for j in range(k):
        key |= data[ORDER - j: ORDER - j + n].astype(U) << U(8 * j)
    return key


def _padded(text: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(ORDER, 10, np.uint8), text])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    held: dict[str, list[np.ndarray]] = {}

    def flush(lang: str) -> None:
        parts = held.pop(lang)
        for k in range(1, ORDER + 2):
            key, n = np.unique(np.concatenate([_grams(p, k) for p in parts]), return_counts=True)
            if (lang, k) in total:
                k0, n0 = total[lang, k]
                key, inv = np.unique(np.concatenate([k0, key]), return_inverse=True)
                n = np.bincount(inv, np.concatenate([n0, n]))
            total[lang, k] = key, n.astype(np.int64)

    for batch in batches:
        data, off = binary_parts(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            held.setdefault(lang, []).append(_padded(data[off[i]: off[i + 1]]))
            if sum(map(len, held[lang])) > 1 << 22:
                flush(lang)
    for lang in list(held):
        flush(lang)
    for (lang, k), (key, n) in total.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(key), "k": [k] * len(key),
                                          "gram": key.astype(np.int64), "n": n})


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id") -> dict:
    """Count tables of the sampled training documents (lang and text not null)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "bits": 0}
    share = F.lit(-1).cast("long")
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(threshold(min(1.0, docs_per_lang / sizes[lang])))).otherwise(share)
    grams = (known.where(place(id_col, 5) <= share).select("lang", "text").mapInArrow(_count, "lang string, k long, gram long, n long")
             .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).where((F.col("k") < 3) | (F.col("n") > 1)))
    t = grams.toArrow()
    lang, k = np.array(t["lang"].to_pylist(), object), t["k"].to_numpy()
    gram, n = t["gram"].to_numpy().astype(U), t["n"].to_numpy()
    return build(langs, {(a, j): (gram[m], n[m]) for a in langs for j in range(1, ORDER + 2)
                         for m in [(lang == a) & (k == j)]})


def _lookup(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Index in sorted ``keys`` or -1."""
    if not len(keys):
        return np.full(len(want), -1)
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[i] == want, i, -1)


def build(langs: list[str], counts: dict) -> dict:
    """For each order k: sorted grams of k+1 bytes with each language's full
    code length, and sorted contexts of k bytes with each language's escape cost.

    A gram that only other languages know takes the escape plus the shorter
    gram's cost, so a hit at any order needs no further lookup."""
    levels, cost0 = [], np.full((256, len(langs)), 8.0)
    below_keys = np.arange(256, dtype=U)
    for k in range(ORDER + 1):  # context length
        keys = np.unique(np.concatenate([counts[a, k + 1][0] for a in langs]))
        ctx_of = keys >> U(8)
        ctx = np.unique(ctx_of)
        at = np.searchsorted(ctx, ctx_of)
        escape = np.zeros((len(ctx), len(langs)))
        own = np.full((len(keys), len(langs)), np.nan)
        for j, a in enumerate(langs):
            g, n = counts[a, k + 1]
            i = np.searchsorted(keys, g)
            tot = np.bincount(at[i], n, len(ctx))
            dist = np.bincount(at[i], minlength=len(ctx))
            seen = tot > 0
            escape[seen, j] = -np.log2(dist[seen] / (tot[seen] + dist[seen]))
            own[i, j] = -np.log2(n / (tot[at[i]] + dist[at[i]]))
        if k == 0:
            lower = np.repeat(cost0[:1], len(keys), 0)
        else:
            lower = _cost({"levels": levels, "uniform": cost0[:1], "bits": len(langs)}, keys, k - 1)
        own = np.where(np.isnan(own), escape[at] + lower, own)
        levels.append((keys, own, ctx, escape))
    keys, own = levels[ORDER][:2]
    return {"langs": langs, "levels": levels, "uniform": cost0[:1], "bits": len(langs), "top": _hashed(keys),
            "own32": np.concatenate([np.zeros((1, len(langs))), own]).astype(np.float32)}


def _hashed(keys: np.ndarray) -> np.ndarray:
    """Direct table from a multiplicative hash to gram index + 1 (0: none; a
    gram that lost its slot to another is looked up by search)."""
    bits = max(16, int(len(keys) * 4).bit_length())
    table = np.zeros(1 << bits, np.int32)
    h = (keys * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
    table[h] = np.arange(1, len(keys) + 1)
    return table


def _cost(m: dict, want: np.ndarray, k: int) -> np.ndarray:
    """Code length of each gram's last byte after its last ``k`` context bytes."""
    if k < 0:
        return np.repeat(m["uniform"], len(want), 0)
    keys, own, ctx, escape = m["levels"][k]
    want = want & U((1 << (8 * (k + 1))) - 1)
    i = _lookup(keys, want)
    out = np.empty((len(want), m["bits"]))
    hit = i >= 0
    out[hit] = own[i[hit]]
    miss = ~hit
    if miss.any():
        w = want[miss]
        c = _lookup(ctx, w >> U(8))
        esc = np.where((c >= 0)[:, None], escape[np.maximum(c, 0)] if len(ctx) else 0.0, 0.0)
        out[miss] = esc + _cost(m, w, k - 1)
    return out


def code_lengths(m: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Bits of each whole text under each language, one row per text.

    The texts of a call are coded together; a long text goes in chunks that
    overlap by the context, so no byte loses its context."""
    total = np.zeros((len(texts), m["bits"]))
    parts: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        data = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        g = _grams(data, ORDER + 1)  # entry i codes byte i + ORDER
        own, keys, table = m["own32"], m["levels"][ORDER][0], m["top"]
        i = np.take(table, (g * U(0x9E3779B97F4A7C15)) >> U(64 - (len(table).bit_length() - 1)))
        miss = np.flatnonzero(np.take(keys, np.maximum(i, 1) - 1) != g) if len(keys) else np.arange(len(g))
        i[miss] = 0
        cost = np.take(own, i, axis=0)
        if len(miss):
            cost[miss] = _cost(m, g[miss], ORDER)
        begins = ends - [len(p) for p in parts]
        for e in ends[:-1]:  # the padding of the next part is context only
            cost[e - ORDER: e] = 0
        sums = np.add.reduceat(cost, begins, axis=0, dtype=np.float64)
        np.add.at(total, owner, sums)
        parts.clear(), owner.clear()

    for t, text in enumerate(texts):
        data = _padded(text)
        for a in range(0, len(text), CHUNK):
            parts.append(data[a: a + CHUNK + ORDER])
            owner.append(t)
            held += len(parts[-1])
            if held > CHUNK:
                flush()
                held = 0
    if parts:
        flush()
    return total


OUT = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte); score is the
    winner's posterior share under equal priors.  ``docs`` carries doc_id,
    held_out and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        m = shared.value
        for batch in batches:
            data, off = binary_parts(batch.column(2))
            texts = batch.column(2).to_pylist()
            clear = [i for i, t in enumerate(texts) if t and m["langs"] and any(map(str.isalpha, t))]
            pred, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            bits = code_lengths(m, [data[off[i]: off[i + 1]] for i in clear])
            for i, row in zip(clear, bits):
                j = int(np.argmin(row))
                pred[i] = m["langs"][j]
                score[i] = float(1.0 / np.exp2(np.maximum(row[j] - row, -1000.0)).sum())
                rate[i] = float(row[j] / (off[i + 1] - off[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                                             names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, OUT)
