"""Merkle manifest of a dataset: leaves, subroots per language, one root,
a proof per row, and the root folded from a proof.

Cogrouped subtree exchange.  The leaves of a language, in order, are cut into
superblocks of 512 consecutive ones (three levels of eight).  Upwards, every
superblock is reduced to its top node; the tops are the nodes of the next
layer, until each language has one node, and the languages' subroots are
reduced in the same way.  Downwards, each layer is cogrouped by superblock with
the outer nodes it requires (the siblings on the way from its top to the
root), which finishes the local reduction, joins the inner and outer parts of
every proof and folds it, in one ``applyInPandas``.  A group is at most 512
rows and one row of outer nodes, so no language, however large, meets in one
task; positions come from ranges of (lang, doc_id) (``ranks``).

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text.
A leaf covers doc_id, source, lang, n_chars and text: '-' for null, else the
UTF-8 byte count, ':' and the value.  Null doc_ids come first in a language;
rows that repeat a doc_id follow by their leaf, and equal leaves stand for
equal rows.  Null lang is a language of its own and comes first.  A proof
without siblings is H of nothing.  Texts of any length are hashed by the JVM
and go nowhere else.  Extra columns are ignored.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import join_null_safe, placed, ranked
from .registry import scratch

FAN = 8
LEVELS = 3  # of a superblock
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: dict[str, Column]) -> Column:
    parts = []
    for f in FIELDS:
        v = values[f].cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, tampered: Column, change=lower_ascii) -> DataFrame:
    """(doc_id, lang, leaf, tampered): ``tampered`` is the leaf of the row with
    a changed text where the condition holds, else null."""
    at = {f: F.col(f) for f in FIELDS}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(at).alias("leaf"),
                       F.when(tampered, leaf(at | {"text": change(F.col("text"))})).alias("tampered"))


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up to its top, in a layer of
    ``total`` nodes; a layer of one node stays as it is."""
    out = [nodes]
    while total > 1 and len(out) <= LEVELS:
        total, now = -(-total // FAN), out[-1]
        out.append([H(*now[i: i + FAN]) for i in range(0, len(now), FAN)])
    return out


def inner(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(left, right) siblings of node ``i``, level by level up to the top."""
    out = []
    for nodes in tree[:-1]:
        run = i // FAN * FAN
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1: run + FAN])))
        i //= FAN
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = H(left, node, right)
    return node


def pack(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in path)


def unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")] if path else []


def _tops(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("idx")
    n = int(g["n"].iloc[0])
    top = levels(g["digest"].tolist(), n)[-1][0]
    return pd.DataFrame({"g": g["g"].iloc[:1], "idx": g["idx"].iloc[:1] // BLOCK, "n": [-(-n // BLOCK)], "digest": [top]})


NODE = "g long, idx long, n long, digest string"
OUTER = "g long, sb long, path string, subroot string"
REPORT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def superblock() -> Column:
    return F.floor(F.col("idx") / F.lit(BLOCK)).cast("long").alias("sb")


def build(nodes: DataFrame, largest: int, folder: str) -> list[DataFrame]:
    """The layers (g, idx, n, digest) from ``nodes`` (stored, groups of at most
    ``largest``) to one node per group; each is written to ``folder``."""
    out = [nodes]
    while largest > 1:
        largest = -(-largest // BLOCK)
        at = f"{folder}/layer{len(out)}"
        out[-1].select("g", "idx", "n", "digest").groupBy("g", superblock()).applyInPandas(_tops, NODE).write.mode("overwrite").parquet(at)
        out.append(nodes.sparkSession.read.parquet(at))
    return out


def _descend(of_languages: bool):
    """Outer nodes of every node of a layer, from those of its superblocks.
    The nodes of the last layer of languages are the subroots, whose trees
    follow; all other nodes are tops of superblocks one layer below."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        digest, idx = nodes["digest"].tolist(), nodes["idx"].tolist()
        tree, above = levels(digest, int(nodes["n"].iloc[0])), unpack(outer["path"].iloc[0])
        path = [pack(inner(tree, i) + above) for i in range(len(digest))]
        if of_languages:
            return pd.DataFrame({"g": idx, "sb": 0, "path": path, "subroot": digest})
        return pd.DataFrame({"g": nodes["g"], "sb": idx, "path": path, "subroot": outer["subroot"].iloc[0]})

    return run


def descend(layers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """Outer nodes of the superblocks of ``layers[0]``, from those of the last
    layer (which holds one node per group, its own top)."""
    for layer in reversed(layers[1:]):
        outer = layer.groupBy("g", superblock()).cogroup(outer.groupBy("g", "sb")).applyInPandas(_descend(False), OUTER)
    return outer


def _report(root: str):
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        leaf = rows["digest"].tolist()
        tree, above = levels(leaf, int(rows["n"].iloc[0])), unpack(outer["path"].iloc[0])
        proof, folded = [], []
        for i, (own, other) in enumerate(zip(leaf, rows["tampered"].tolist())):
            path = inner(tree, i) + above
            proof.append(H(*(x for p in path for x in p)))
            folded.append(fold(other or own, path))
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": leaf, "subroot": outer["subroot"].iloc[0], "root": root,
                             "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

    return run


def manifest(docs: DataFrame, folder: str, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of
    every row.  Without ``tampered`` every row verifies."""
    spark = docs.sparkSession
    leaves(docs, F.lit(False) if tampered is None else tampered).write.mode("overwrite").parquet(f"{folder}/leaves")
    stored = spark.read.parquet(f"{folder}/leaves")
    # Rows of one (lang, doc_id, leaf) are alike; the place in the files spreads them.
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("place").asc()]
    rows, blocks = ranked(stored.withColumn("place", F.monotonically_increasing_id()), ["lang"], order, f"{folder}/ranked")
    blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    largest = blocks.agg(F.max("n")).first()[0]
    if largest is None:
        return spark.createDataFrame([], REPORT)

    # Languages are a group of their own: position g in the order of lang.
    blocks.groupBy("lang").agg(F.max("n").alias("rows")).withColumn("all", F.lit(0).cast("long")) \
        .write.mode("overwrite").parquet(f"{folder}/languages")
    languages = spark.read.parquet(f"{folder}/languages")
    by_lang, lang_blocks = ranked(languages, ["all"], [F.col("lang").asc_nulls_first()], f"{folder}/ranked-languages")
    names = placed(by_lang, lang_blocks, ["all"], "g").select("lang", "g", F.col("n").alias("n_lang"))
    placed(rows, join_null_safe(blocks, names, ["lang"]), ["lang"]).select("g", "idx", "n", "doc_id", F.col("leaf").alias("digest"), "tampered", "n_lang") \
        .write.mode("overwrite").parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")

    trees = build(nodes, largest, f"{folder}/trees")
    n_lang = nodes.agg(F.max("n_lang")).first()[0]
    top = trees[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_lang).cast("long").alias("n"), "digest")
    upper = build(top, n_lang, f"{folder}/upper")
    root = upper[-1].select("digest").first()[0]

    start = spark.range(1).select(F.col("id").alias("g"), F.col("id").alias("sb"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    outer = descend(upper, start)
    outer = top.groupBy("g", superblock()).cogroup(outer.groupBy("g", "sb")).applyInPandas(_descend(True), OUTER)
    outer = descend(trees, outer)
    outer.write.mode("overwrite").parquet(f"{folder}/outer")
    outer = spark.read.parquet(f"{folder}/outer")
    return (nodes.select("g", "idx", "n", "doc_id", "digest", "tampered").groupBy("g", superblock())
            .cogroup(outer.groupBy("g", "sb")).applyInPandas(_report(root), REPORT))


def op12_report(docs: DataFrame) -> DataFrame:
    """The manifest with a lower-cased text where 3 divides crc32(doc_id)."""
    third = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, F.lit(False))
    return manifest(docs, scratch(docs.sparkSession, "op12-manifest"), third)


ORACLE = r"""
with recursive
fields as (
  select row_number() over () as r, doc_id, lang, d.text as t,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) as head,
         translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from documents d),
-- crc32 of the decimal id: a byte enters, then eight shifts
third as (
  select *, list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
              lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))) as crc
  from fields),
hashed as (
  select r, doc_id, lang, sha256(head || coalesce(strlen(t) || ':' || t, '-')) as leaf,
         sha256(head || coalesce(strlen(u) || ':' || u, '-')) as changed
  from (select *, case when xor(crc, 4294967295) % 3 = 0 then low else t end as u from third)),
leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from hashed),
langs as (select lang, row_number() over (order by lang nulls first) - 1 as g, count(*) over () as n from (select distinct lang from leaves)),
up as (
  select g, 0 as lvl, i, l.n, leaf as h from leaves l join langs on l.lang is not distinct from langs.lang
  union all
  select g, lvl + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by i)) from up where n > 1 group by g, lvl, i // 8),
subroots as (select g, h from up where n = 1),
top as (
  select 0 as lvl, s.g as i, l.n, h from subroots s join langs l on s.g = l.g
  union all
  select lvl + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by i)) from top where n > 1 group by lvl, i // 8),
-- one table of nodes: a language's levels, then those of the languages
nodes as (
  select g, lvl, i, h from up where n > 1
  union all
  select langs.g, height + top.lvl, top.i, top.h from langs
  join (select g, max(lvl) as height from up group by g) using (g) cross join top where top.n > 1),
heights as (select g, max(lvl) as height from up group by g),
steps as (
  select r, l.g, x.lvl, case when x.lvl < height then i // (8::BIGINT ** x.lvl)::BIGINT else l.g // (8::BIGINT ** (x.lvl - height))::BIGINT end as pos
  from (select r, i, langs.g from leaves v join langs on v.lang is not distinct from langs.lang) l
  join heights using (g) join (select distinct g, lvl from nodes) x using (g)),
sides as (
  select r, s.lvl, coalesce(string_agg(h, '' order by n.i) filter (where n.i < pos), '') as l,
         coalesce(string_agg(h, '' order by n.i) filter (where n.i > pos), '') as u
  from steps s join nodes n on n.g = s.g and n.lvl = s.lvl and n.i // 8 = pos // 8 group by r, s.lvl),
fold as (
  select r, 0 as lvl, changed as h from leaves
  union all
  select f.r, f.lvl + 1, sha256(l || f.h || u) from fold f join sides s on s.r = f.r and s.lvl = f.lvl),
folded as (select r, max_by(h, lvl) as folded_root from fold group by r),
proofs as (select r, sha256(string_agg(l || u, '' order by lvl)) as proof_sha256 from sides group by r)
select doc_id, leaf, s.h as subroot, top.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = top.h as verified
from leaves v join langs on v.lang is not distinct from langs.lang join subroots s using (g) join folded using (r) left join proofs using (r)
cross join (select h from top where n = 1) top
"""
