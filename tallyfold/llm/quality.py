"""Quality rules as a short-circuit cascade.

Every rule is a pure test over one document's text.  ``plan_cascade`` runs all
rules on a bounded sample inside Spark tasks, measures each rule's seconds per
document and which rules reject it, and orders the rules by rejection per cost,
each rule counted on what the rules before it keep.
``apply_cascade`` then runs them in that order; a document that a rule rejects
never reaches the later rules.  The verdict is the conjunction of all rules
and so does not depend on the measured order.

Null or empty text has no words: it fails the base test.  Repeated rows are
judged each on its own.  An empty sample leaves the declared order.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import place, threshold
from .text import Blob, U, blobs, mix, range_hashes, space_table, window_hashes

REPEAT_WINDOW = 8
MIN_WORDS = 20
# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SAMPLE_DOCS = 2000
# Measures with one value per document: those of the base report, and the rest.
BASE = ("words", "word_chars", "symbols", "dup_lines", "repeat_words")
PER_DOC = (*BASE, "letters", "n_lines")


class Stats:
    """Per-document measures of a blob, each computed when a rule first asks."""

    def __init__(self, blob: Blob, known: dict[str, np.ndarray] | None = None):
        self.b = blob
        self.__dict__.update(known or {})

    def measure(self) -> None:
        """Compute every measure of the base report."""
        for name in BASE:
            getattr(self, name)

    def fresh(self) -> Stats:
        """The same documents with the measures of the base report alone."""
        return Stats(self.b, {k: v for k, v in self.__dict__.items() if k in BASE})

    def take(self, alive: np.ndarray, space: np.ndarray) -> Stats:
        """The documents ``alive`` alone, with what is known of them."""
        return Stats(_take(self.b, alive, space), {k: v[alive] for k, v in self.__dict__.items() if k in PER_DOC})

    @cached_property
    def words(self) -> np.ndarray:
        return self.b.n_words.astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.b.per_doc(self.b.word & ((self.b.data & 0xC0) != 0x80))

    @cached_property
    def symbols(self) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(SYMBOLS)] = True
        return self.b.per_doc(t[self.b.data])

    @cached_property
    def letters(self) -> np.ndarray:
        v = np.arange(256)
        t = ((v | 32) >= 97) & ((v | 32) <= 122) | (v >= 0xC0)  # lead bytes stand for their character
        return self.b.per_doc(t[self.b.data])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, starts, ends) of every line; a line never spans documents."""
        d, off = self.b.data, self.b.offsets
        nl = np.flatnonzero(d == 10)
        starts = np.concatenate([off[:-1], nl + 1])
        doc = np.concatenate([np.arange(self.b.n), np.searchsorted(off, nl, "right") - 1])
        o = np.lexsort((starts, doc))
        starts, doc = starts[o], doc[o]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        ends[last] = off[1:][doc[last]]
        return doc, starts, ends

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        doc, s, e = self._lines
        has = np.searchsorted(self.b.starts, s) < np.searchsorted(self.b.starts, e)
        return np.bincount(doc[has], minlength=self.b.n)

    @cached_property
    def dup_lines(self) -> np.ndarray:
        doc, s, e = self._lines
        has = np.searchsorted(self.b.starts, s) < np.searchsorted(self.b.starts, e)
        doc, s, e = doc[has], s[has], e[has]
        h = mix(range_hashes(self.b.table[self.b.data], s, e) ^ mix(doc.astype(U) + U(1)))
        _, first = np.unique(h, return_index=True)
        dup = np.ones(len(h), bool)
        dup[first] = False
        return np.bincount(doc[dup], minlength=self.b.n)

    @cached_property
    def repeat_words(self) -> np.ndarray:
        k, doc = REPEAT_WINDOW, self.b.doc
        if len(doc) < k:
            return np.zeros(self.b.n, np.int64)
        n = len(doc) - k + 1
        inside = np.flatnonzero(doc[:n] == doc[k - 1:])
        h = mix(window_hashes(self.b.hashes, k)[inside] ^ mix(doc[inside].astype(U) + U(1)))
        o = np.argsort(h)
        hs = h[o]
        same = hs[1:] == hs[:-1]
        rep = np.zeros(len(h), bool)
        rep[o[1:][same]] = True
        rep[o[:-1][same]] = True
        at = inside[rep]
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
        return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=self.b.n)


@dataclass(frozen=True)
class Rule:
    """``bad`` names the statistic test; thresholds are documented values."""

    name: str
    limit: float

    def rejects(self, s: Stats) -> np.ndarray:
        if self.name == "too_few_words":
            return s.words < self.limit
        if self.name == "symbols_per_word":
            return s.symbols > self.limit * np.maximum(s.words, 1)
        if self.name == "long_words":
            return s.word_chars > self.limit * np.maximum(s.words, 1)
        if self.name == "few_letters":
            return s.letters < self.limit * s.word_chars
        if self.name == "duplicate_lines":
            return s.dup_lines > self.limit * s.n_lines
        if self.name == "repeated_windows":
            return s.repeat_words > self.limit * s.words
        raise ValueError(self.name)


RULES = (
    Rule("too_few_words", MIN_WORDS),
    Rule("symbols_per_word", 0.25),
    Rule("long_words", 30.0),
    Rule("few_letters", 0.5),
    Rule("duplicate_lines", 0.5),
    Rule("repeated_windows", 0.3),
)


def _base_failed(s: Stats) -> np.ndarray:
    return (s.words < MIN_WORDS) | (100 * s.repeat_words > 30 * s.words)


def _measure(rules: tuple[Rule, ...], after_base: bool):
    """Texts -> (mask, rule, docs, seconds): how many documents each set of
    rules rejects (rule -1), and the seconds of each rule (mask -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_table()
        docs, seconds, masks = 0, [0.0] * len(rules), Counter()
        for batch in batches:
            for _, _, b in blobs(batch.column("text")):
                base = Stats(b)
                if after_base:
                    base.measure()
                    base = base.take(np.flatnonzero(~_base_failed(base)), space)
                docs += base.b.n
                mask = np.zeros(base.b.n, np.int64)
                for i, r in enumerate(rules):
                    own = base.fresh()
                    t0 = time.perf_counter()
                    mask |= r.rejects(own).astype(np.int64) << i
                    seconds[i] += time.perf_counter() - t0
                masks.update(mask.tolist())
        n = len(rules)
        yield pa.RecordBatch.from_pydict({"mask": [*masks, *[-1] * n], "rule": [*[-1] * len(masks), *range(n)],
                                          "docs": [*masks.values(), *[docs] * n], "seconds": [*[0.0] * len(masks), *seconds]})
    return run


def greedy(masks: dict[int, int], cost: list[float]) -> list[int]:
    """Rules by rejection per cost, each counted on what the rules before it
    keep; ``masks`` counts documents by the set of rules that reject them."""
    left, order = list(range(len(cost))), []
    while left:
        gain = {i: sum(n for m, n in masks.items() if m >> i & 1) for i in left}
        best = max(left, key=lambda i: (gain[i] / max(cost[i], 1e-12), -i))
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
        left.remove(best)
        order.append(best)
    return order


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS,
                 id_col: str = "doc_id", text_col: str = "text", after_base: bool = False) -> tuple[Rule, ...]:
    """Order ``rules`` by conditional rejection per cost, measured on about
    ``sample_docs`` documents chosen by a hash of the id.  With ``after_base``
    only those that pass the base test count, and what it has measured is free.
    One row per rule and per set of rejecting rules reaches the driver."""
    n = docs.count()
    if n == 0:
        return rules
    picked = (docs.where(place(id_col, 11) <= threshold(min(1.0, sample_docs / n)))
              .select(F.col(text_col).alias("text")))
    got = (picked.mapInArrow(_measure(rules, after_base), "mask long, rule long, docs long, seconds double")
           .groupBy("mask", "rule").agg(F.sum("docs").alias("docs"), F.sum("seconds").alias("seconds")).collect())
    cost = {r["rule"]: r["seconds"] / max(r["docs"], 1) for r in got if r["rule"] >= 0}
    masks = {r["mask"]: r["docs"] for r in got if r["rule"] < 0}
    return tuple(rules[i] for i in greedy(masks, [cost.get(i, 0.0) for i in range(len(rules))]))


def _take(b: Blob, alive: np.ndarray, space: np.ndarray) -> Blob:
    """The blob of the documents ``alive`` alone."""
    size = np.diff(b.offsets)
    keep = np.zeros(b.n, bool)
    keep[alive] = True
    data = b.data[np.repeat(keep, size)]
    return Blob(data, np.concatenate([[0], np.cumsum(size[alive])]), space, b.table)


def cascade(stats: Stats, ordered: tuple[Rule, ...], space: np.ndarray) -> np.ndarray:
    """Verdict of each document; later rules see the survivors only."""
    alive = np.arange(stats.b.n)
    kept = np.zeros(stats.b.n, bool)
    for r in ordered:
        bad = r.rejects(stats)
        if bad.any():
            alive = alive[~bad]
            if not len(alive):
                break
            stats = stats.take(np.flatnonzero(~bad), space)
    kept[alive] = True
    return kept


def apply_cascade(docs: DataFrame, ordered: tuple[Rule, ...], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, kept) of every row, judged by the ordered rules on whole texts."""
    def run(batches):
        space = space_table()
        for batch in batches:
            col, kept = batch.column(1), np.zeros(batch.num_rows, bool)
            for a, z, b in blobs(col):
                kept[a:z] = cascade(Stats(b), ordered, space)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept)], ["id", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, kept boolean")


OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean")


def quality_report(docs: DataFrame, ordered: tuple[Rule, ...] | None = None) -> DataFrame:
    """Base measures and the verdict for every document.

    base_failed: fewer than 20 words, or over 30 % of the words lie in 8-word
    windows found twice.  Only documents that pass it enter the cascade."""
    ordered = plan_cascade(docs, after_base=True) if ordered is None else ordered

    def run(batches):
        space = space_table()
        for batch in batches:
            n = batch.num_rows
            ints = np.zeros((5, n), np.int64)
            failed, kept = np.zeros(n, bool), np.zeros(n, bool)
            for a, z, b in blobs(batch.column(1)):
                s = Stats(b)
                ints[:, a:z] = s.words, s.word_chars, s.symbols, s.dup_lines, s.repeat_words
                bad = _base_failed(s)
                failed[a:z] = bad
                good = np.flatnonzero(~bad)
                if len(good):
                    kept[a + good] = cascade(s if len(good) == b.n else s.take(good, space), ordered, space)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, ints), pa.array(failed), pa.array(kept)],
                                             names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)
