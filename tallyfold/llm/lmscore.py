"""Language-model scoring with Brown class-based bigrams.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z as a-z, then one end token per
document.  All counts cover all training documents:

* token counts (a grouped sum over every training token);
* bigram counts among the ``CLUSTERED`` most frequent words, one shared symbol
  for every other word, and the end token.

Exchange clustering on those bigrams moves each word to the class that raises
the class-bigram likelihood most, sweep by sweep.  Every other word of the
training documents, however rare, then goes to the class in which it is most
likely given the classes beside all its occurrences (``place``; a shared symbol
stands for neighbours beyond the clustered ones).  Transitions are counted over
all training tokens with these classes.  The end token is a class of its own,
tokens unseen in training another.  The model is
P(token | before) = P(class | class before) * P(token | class): transitions
are smoothed by adding 0.5, and a token's emission is its share of its class.

Only bounded data is broadcast: at most ``HEAD`` of the most frequent tokens
with their counts and classes.  Every other token of a document is looked up by
a join with the full vocabulary, so no count or class is approximated however
large the vocabulary grows.

Null text is empty: one end token.  Repeated rows are scored each.  Without
any training row every token is unseen (N = 0, V = 0).  Tokens are told apart
by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U, Blob, blobs, process_cache

CLUSTERED = 1000
CLASSES = 48
SWEEPS = 6
HEAD = 1 << 18
END = np.int64(0x5EED0FE7D)  # the end token's own id
FLUSH = 2_000_000
SLICE = 1 << 20  # most tokens (or one document) worked on at once


def tokens(b: Blob) -> tuple[np.ndarray, np.ndarray]:
    """(token, document) of the blob, each document closed by END."""
    at = np.arange(len(b.hashes)) + b.doc
    out = np.full(len(b.hashes) + b.n, END)
    out[at] = b.hashes.view(np.int64)
    return out, np.repeat(np.arange(b.n), b.n_words + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    w = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    o = np.argsort(w, kind="stable")
    w, n = w[o], n[o]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    return w[first], np.add.reduceat(n, first)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(w, n) over all documents; combined per task before the shuffle."""
    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, b in blobs(batch.column(0), lower=True, limit=1 << 21):
                parts.append(np.unique(tokens(b)[0], return_counts=True))
                size += len(parts[-1][0])
                if size > FLUSH:
                    parts = [_merge(parts)]
                    size = len(parts[0][0])
                    if size > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, parts[0])], names=["w", "n"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _merge(parts))], names=["w", "n"])

    return docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Lookup:
    """Position of a token among sorted keys, through a direct table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, int(len(keys) * 4).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, w: np.ndarray) -> np.ndarray:
        return (w.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(w), -1)
        i = np.take(self.table, self._slot(w)).astype(np.int64)
        clash = np.flatnonzero((i >= 0) & (np.take(self.keys, np.maximum(i, 0)) != w))
        j = np.minimum(np.searchsorted(self.keys, w[clash]), len(self.keys) - 1)
        i[clash] = np.where(self.keys[j] == w[clash], j, -1)
        return i


def count_bigrams(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(a, b, n): symbols 0..len(words)-1 the sorted words, then the open
    symbol, then END; a document starts after END."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        find, m = Lookup(shared.value), len(shared.value)
        size = m + 2
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, b in blobs(batch.column(0), lower=True):
                t, _ = tokens(b)
                s = find(t)
                s[s < 0] = m
                s[t == END] = m + 1
                prev = np.concatenate([[m + 1], s[:-1]])
                total += np.bincount(prev * size + s, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(total[at])], names=["a", "b", "n"])

    return (docs.select("text").mapInArrow(run, "a long, b long, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol.  ``bigrams`` is the dense count matrix, the last
    two symbols (open, END) keep classes of their own."""
    m = len(bigrams) - 2
    c = min(classes, max(m, 1))
    order = np.argsort(-bigrams[:m].sum(1), kind="stable")
    cls = np.empty(m + 2, np.int64)
    cls[order] = np.arange(m) % c
    cls[m], cls[m + 1] = c, c + 1
    k = c + 2
    one = np.eye(k)[cls]
    n = one.T @ bigrams @ one
    right, left = bigrams @ one, bigrams.T @ one  # word -> class, class -> word
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, self_n = cls[w], bigrams[w, w]
            r, lf = right[w].copy(), left[w].copy()
            r[a] -= self_n
            lf[a] -= self_n
            n[a, :] -= r
            n[:, a] -= lf
            n[a, a] -= self_n
            gain_r = _g(n + r[None, :]) - _g(n)
            gain_l = _g(n + lf[:, None]) - _g(n)
            gain = gain_r.sum(1) - np.diag(gain_r) + gain_l.sum(0) - np.diag(gain_l)
            d = np.diag(n)
            gain += _g(d + r + lf + self_n) - _g(d)
            out, into = n.sum(1), n.sum(0)
            gain -= _g(out + r.sum() + self_n) - _g(out) + _g(into + lf.sum() + self_n) - _g(into)
            b = int(np.argmax(gain[:c]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b, :] += r
            n[:, b] += lf
            n[b, b] += self_n
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w, :]
                left[:, b] += bigrams[w, :]
        if not moved:
            break
    return cls


def count_contexts(docs: DataFrame, words: np.ndarray, cls: np.ndarray) -> DataFrame:
    """(w, slot, n) of all tokens but ``words`` and END: how often a token of
    class ``slot`` follows, and one of class ``slot - k`` stands before."""
    m, k = len(words), int(cls.max()) + 1
    shared = docs.sparkSession.sparkContext.broadcast((words, cls))

    def run(batches):
        words, cls = shared.value
        find = Lookup(words)
        for batch in batches:
            for _, _, b in blobs(batch.column(0), lower=True, limit=1 << 21):
                t, _ = tokens(b)
                s = find(t)
                s[s < 0] = m
                s[t == END] = m + 1
                c = cls[s]
                before, after = np.concatenate([cls[-1:], c[:-1]]), np.concatenate([c[1:], cls[-1:]])
                other = s == m
                w, i = np.unique(t[other], return_inverse=True)
                at, n = np.unique(np.concatenate([i * (2 * k) + after[other], i * (2 * k) + k + before[other]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w[at // (2 * k)]), pa.array((at % (2 * k)).astype(np.int32)), pa.array(n)],
                                                 names=["w", "slot", "n"])

    return (docs.select("text").mapInArrow(run, "w long, slot int, n long")
            .groupBy("w", "slot").agg(F.sum("n").alias("n")))


def place(contexts: DataFrame, gain: np.ndarray, size: np.ndarray) -> DataFrame:
    """(w, n, c): every token's count and the class of the greatest likelihood.
    ``gain`` (slot, class): log probability of a class beside one neighbour."""
    k = len(gain) // 2
    lone = np.log10(np.maximum(size, 1))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                lists = part.column(1)
                at, x = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
                slot, n = x.field("slot").to_numpy(), x.field("n").to_numpy()
                seen = np.bincount(at, np.where(slot < k, n, 0), part.num_rows)  # every token has one that follows
                like = np.zeros((part.num_rows, gain.shape[1]))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                like[at[first]] = np.add.reduceat(n[:, None] * gain[slot], first)
                best = np.argmax(like - seen[:, None] * lone[None, :], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seen.astype(np.int64)), pa.array(best.astype(np.int16))], names=["w", "n", "c"])

    by_word = contexts.groupBy("w").agg(F.collect_list(F.struct("slot", "n")).alias("s"))  # at most 2 k entries
    return by_word.mapInArrow(run, "w long, n long, c short")


def _transitions(pair: np.ndarray) -> np.ndarray:
    return np.log10((pair + 0.5) / (pair.sum(1, keepdims=True) + 0.5 * len(pair)))


def train(docs: DataFrame, folder: str, clustered: int = CLUSTERED, classes: int = CLASSES, head: int = HEAD) -> dict:
    """Counts and classes (stored under ``folder``), the head and the class model."""
    spark = docs.sparkSession
    count_tokens(docs).write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # The head by a count threshold: a histogram over steps of 1/16 octave (a few
    # hundred rows), then the tokens above it.  No task sorts the vocabulary.
    step = F.floor(F.log2("n") * 16)
    hist = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("s")).collect()

    def most_frequent(of: DataFrame, most: int):
        below, least = 0, None
        for row in hist:
            below += row["c"]
            if below > most:
                break
            least = row["s"]
        chosen = F.col("w") == END.item()  # END is always known
        if least is not None:
            chosen = chosen | (step >= least)
        return of.where(chosen).toArrow()  # bounded by ``most`` and END

    top = most_frequent(counts, head)
    w, n = top["w"].to_numpy(), top["n"].to_numpy()
    o = np.lexsort((w, -n))
    w, n = w[o], n[o]
    few = w != END
    words, sizes = w[few][:clustered], n[few][:clustered]
    o = np.argsort(words)
    words, sizes = words[o], sizes[o]
    rows = count_bigrams(docs, words).toArrow()  # bounded by (clustered + 2) ** 2
    m = len(words)
    big = np.zeros((m + 2, m + 2))
    big[rows["a"].to_numpy(), rows["b"].to_numpy()] = rows["n"].to_numpy()
    cls = exchange(big, classes)
    k, last = int(cls.max()) + 1, int(cls[m])  # classes below ``last`` take words
    one = np.eye(k)[cls]
    move = _transitions(one.T @ big @ one)
    gain = np.concatenate([move[:last].T, move[:, :last]])  # what follows, what stands before
    placed = place(count_contexts(docs, words, cls), gain, np.bincount(cls[:m], sizes, last))
    known = [(int(a), int(b), int(c)) for a, b, c in zip(words, sizes, cls)]  # at most ``clustered`` rows
    known += [(int(END), int(x), int(cls[m + 1])) for x in n[~few]]
    (placed.unionByName(spark.createDataFrame(known, "w long, n long, c short"))
     .write.mode("overwrite").parquet(f"{folder}/vocabulary"))
    vocabulary = spark.read.parquet(f"{folder}/vocabulary")
    size = np.ones(k)
    for row in vocabulary.groupBy("c").agg(F.sum("n").alias("n")).collect():
        size[row["c"]] = row["n"]
    top = most_frequent(vocabulary, head)
    w, n, c = (top[x].to_numpy() for x in ("w", "n", "c"))
    o = np.argsort(w)
    total = int(total or 0)
    model = {"w": w[o], "n": n[o], "cls": c[o], "size": np.log10(size), "transition": move, "open": last, "end": int(cls[m + 1]),
             "base_log": float(np.log10(total + 0.5 * (distinct + 1))), "train_tokens": total, "vocabulary": f"{folder}/vocabulary"}
    pair = np.zeros((k, k))
    found = _resolved(docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), model, f"{folder}/train")
    for row in count_classes(found, k).collect():  # at most k * k rows
        pair[row["a"], row["b"]] = row["n"]
    return model | {"transition": _transitions(pair)}


OUT = ("doc_id long, held_out boolean, n_tokens long, n_known long, logs double, names double, "
       "seq array<short>, w array<long>")


def _partial(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: everything the head decides, and the tokens beyond it.

    logs, names: sums of log10(c + 0.5) and log10(c) over head tokens; seq: the
    class of every token, -1 for those beyond the head, which ``w`` holds in
    their order."""
    token = model["vocabulary"]
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("w", "n", "cls")})

    def run(batches):
        m, c = shared.value, process_cache()
        if c.get("lm", (None,))[0] != (token, len(m["w"])):
            c["lm"] = ((token, len(m["w"])), Lookup(m["w"]))
        find = c["lm"][1]
        # one more entry, for what is not found (-1)
        known, names = np.append(np.log10(m["n"] + 0.5), 0), np.append(np.log10(m["n"]), 0)
        cls = np.append(m["cls"], -1).astype(np.int16)
        for batch in batches:
            cols = [np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float)]
            seq, rare, size = [], [], np.zeros(batch.num_rows, np.int64)
            for a, z, b in blobs(batch.column(2), lower=True):
                t, doc = tokens(b)
                i = find(t)
                miss = i < 0
                cols[0][a:z] = b.n_words + 1
                cols[1][a:z] = np.bincount(doc[~miss], minlength=b.n)
                cols[2][a:z] = np.bincount(doc, known[i], b.n)
                cols[3][a:z] = np.bincount(doc, names[i], b.n)
                size[a:z] = np.bincount(doc[miss], minlength=b.n)
                seq.append(cls[i])
                rare.append(t[miss])
            edge = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge(x), pa.array(np.concatenate(y) if y else [], z))
                     for x, y, z in ((cols[0], seq, pa.int16()), (size, rare, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols), *lists],
                                             names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, OUT)


def _resolved(docs: DataFrame, model: dict, folder: str) -> DataFrame:
    """Rows of ``_partial`` with what the full vocabulary says of the tokens
    beyond the head: sums ``more``, ``also`` and ``rest``, and ``late``, their
    classes in order."""
    spark = docs.sparkSession
    _partial(docs, model).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/partial")
    part = spark.read.parquet(f"{folder}/partial")
    vocabulary = spark.read.parquet(model["vocabulary"])
    rare = part.select("row", F.posexplode("w").alias("i", "w"))
    late = F.sort_array(F.collect_list(F.struct("i", F.coalesce("c", F.lit(model["open"]).cast("short")).alias("c"))))  # one document's own tokens
    found = rare.join(vocabulary, "w", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.5))).alias("more"), F.count("n").alias("also"),
        F.coalesce(F.sum(F.log10("n")), F.lit(0.0)).alias("rest"), F.transform(late, lambda x: x["c"]).alias("late"))
    return part.drop("w").join(found, "row", "left").drop("row")


def _sequences(seq: pa.Array, late: pa.Array):
    """(first row, end row, classes, document) in slices of whole documents."""
    n = seq.value_lengths().to_numpy().astype(np.int64)
    full = seq.flatten().to_numpy().copy()
    full[full < 0] = late.flatten().to_numpy()
    edge = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(edge, edge[a] + SLICE, "right")) - 1)
        yield a, z, full[edge[a]:edge[z]].astype(np.int64), np.repeat(np.arange(z - a), n[a:z])
        a = z


def count_classes(found: DataFrame, k: int) -> DataFrame:
    """(a, b, n): how often class b follows class a in the rows of ``_resolved``."""
    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for _, _, c, _ in _sequences(batch.column(0), batch.column(1)):
                before = np.concatenate([c[-1:], c[:-1]])  # every document ends with END
                total += np.bincount(before * k + c, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k), pa.array(total[at])], names=["a", "b", "n"])

    return found.select("seq", "late").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: dict, folder: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity) of every row of (doc_id, held_out, text)."""
    move, size = model["transition"], model["size"]

    def run(batches):
        for batch in batches:
            steps = np.zeros(batch.num_rows)
            for a, z, c, doc in _sequences(batch.column(0), batch.column(1)):
                before = np.concatenate([c[-1:], c[:-1]])
                steps[a:z] = np.bincount(doc, move[before, c] - size[c], z - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(steps)], names=[*batch.schema.names[2:], "steps"])

    more = F.coalesce("more", F.lit(0.0))
    part = _resolved(docs, model, folder).select(
        "seq", "late", "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(model["base_log"])).alias("base_score"),
        (F.col("names") + F.coalesce("rest", F.lit(0.0))).alias("names"))
    part = part.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, names double, steps double")
    value = F.col("names") + F.col("steps")
    return part.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["train_tokens"]).cast("long").alias("train_tokens"), "base_score",
                       value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"))
