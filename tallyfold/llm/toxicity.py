"""Toxicity classifier: FTRL-proximal logistic regression over hashed word
n-grams and skip-grams.

Features of a text are the distinct 64-bit hashes of its lower-cased words
(runs of letters, digits and non-ASCII characters), of the words' stems (their
first 4, 5 and 6 bytes, so inflected forms share a feature), of neighbouring
word pairs, and of word pairs one word apart.  FTRL keeps a learning rate for every
coordinate and its L1 term leaves most weights at zero, so the model is a
short list of (hash, weight) that is broadcast.

Training uses a bounded sample of the labelled rows: about ``max_toxic`` and
``max_clean`` documents, chosen by a hash of the id (documented parameters;
the broadcast and the one training task are bounded by them).  The intercept
is corrected for the two sampling shares.  Every row is scored on its whole
text.  Null or empty text has no feature and scores by the intercept alone.
A repeated label counts as toxic if any of its rows says so.  Without both
classes the model is empty and scores the prior.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import place, threshold
from .text import U, Blob, blobs, mix, not_alnum, range_hashes, space_table

MAX_TOXIC, MAX_CLEAN = 2500, 4000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.01
MIN_DOCS = 3
STEMS = (4, 5, 6)


def _features(b: Blob) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) arrays: words, their stems, pairs, pairs with one word between."""
    h, doc = b.hashes, b.doc
    out = [(doc, h)]
    values = b.table[b.data]
    for size in STEMS:
        long = b.ends - b.starts > size
        st = b.starts[long]
        out.append((doc[long], mix(range_hashes(values, st, st + size) + U(size))))
    for gap, salt in ((1, 0x51ED270B7A1F2C3D), (2, 0x2545F4914F6CDD1D)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            out.append((doc[gap:][same], mix(h[:-gap][same] * U(salt) + h[gap:][same])))
    return out


def _doc_features(batches):
    space = space_table(not_alnum)
    for batch in batches:
        rows = []
        for _, _, b in blobs(batch.column(2), lower=True, space=space):
            parts = _features(b)
            doc = np.concatenate([p[0] for p in parts])
            h = np.concatenate([p[1] for p in parts])
            o = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[o], np.arange(b.n + 1))
            rows += [np.unique(h[o[cut[i]: cut[i + 1]]]).tobytes() for i in range(b.n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())],
                                         names=["key", "toxic", "features"])


def _fit(batches):
    """FTRL over the sample, in the order of ``key``."""
    xs, ys = [], []
    for batch in batches:
        xs += [np.frombuffer(x, U) for x in batch.column(2).to_pylist()]
        ys += batch.column(1).to_pylist()
    seen = np.zeros(1 << 24, np.uint8)
    for x in xs:
        i = (x >> U(40)).astype(np.int64)
        seen[i] = np.minimum(seen[i], 200) + 1
    xs = [x[seen[(x >> U(40)).astype(np.int64)] >= MIN_DOCS] for x in xs]
    vocab = np.unique(np.concatenate(xs)) if xs else np.zeros(0, U)
    xs = [np.append(np.searchsorted(vocab, x), len(vocab)) for x in xs]  # last: intercept
    z, n = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)

    def weight(i):
        l1 = np.where(i == len(vocab), 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, y in zip(xs, ys):
            w = weight(i)
            g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange(len(vocab) + 1))
    live = np.flatnonzero(w[:-1])
    yield pa.RecordBatch.from_pydict({"hash": np.append(vocab[live], U(0)).view(np.int64), "weight": w[np.append(live, len(vocab))],
                                      "intercept": [False] * len(live) + [True]})


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> dict:
    """Weights from labelled documents; ``labels`` (doc_id, toxic) holds the
    rows that may be learned from.  The label counts and the final weights are
    the only values that reach the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return {"hash": np.zeros(0, U), "weight": np.zeros(0), "intercept": 20.0 if size.get(1) else -20.0}
    share = {1: min(1.0, max_toxic / size[1]), 0: min(1.0, max_clean / size[0])}
    bound = F.when(F.col("toxic") == 1, F.lit(threshold(share[1]))).otherwise(F.lit(threshold(share[0])))
    picked = known.where(place("doc_id", 3) <= bound)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded: max_toxic + max_clean rows
    got = (sample.select(F.xxhash64("doc_id", F.lit(9)).alias("key"), F.col("toxic").cast("long").alias("toxic"), "text")
           .mapInArrow(_doc_features, "key long, toxic long, features binary")
           .repartition(1).sortWithinPartitions("key", "features")
           .mapInArrow(_fit, "hash long, weight double, intercept boolean").toArrow())
    hs, ws, ic = got["hash"].to_numpy().view(U), got["weight"].to_numpy(), got["intercept"].to_numpy(zero_copy_only=False)
    o = np.argsort(hs[~ic])
    return {"hash": hs[~ic][o], "weight": ws[~ic][o],
            "intercept": float(ws[ic].sum()) - math.log(share[1] / share[0])}


class Scorer:
    """Scores blobs; a bitmap over the top bits of the known hashes lets most
    features go before the exact look-up."""

    def __init__(self, model: dict):
        self.m = model
        self.near = np.zeros(1 << 20, bool)
        self.near[(model["hash"] >> U(44)).astype(np.int64)] = True
        self.space = space_table(not_alnum)

    def __call__(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        hs, ws = self.m["hash"], self.m["weight"]
        for a, z, b in blobs(col, lower=True, space=self.space):
            docs, at = [], []
            for doc, h in _features(b) if len(hs) else []:
                i = np.flatnonzero(self.near[(h >> U(44)).astype(np.int64)])
                j = np.minimum(np.searchsorted(hs, h[i]), len(hs) - 1)
                hit = hs[j] == h[i]
                docs.append(doc[i[hit]])
                at.append(j[hit])
            logit = np.full(b.n, self.m["intercept"])
            if docs:
                pair = np.unique(np.concatenate(docs) * len(hs) + np.concatenate(at))
                logit += np.bincount(pair // len(hs), ws[pair % len(hs)], b.n)
            out[a:z] = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
        return out


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            s = scorer(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s),
                                              pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, OUT)


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
