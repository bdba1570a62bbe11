"""The registered ``opN_<name>`` queries (thin: operator plus digest columns)."""

from __future__ import annotations

from . import align, decontam, langid, linededup, lmscore, merkle, mixing, neardup, packing, quality, secret_scan, substring, toxicity
from .registry import documents, fold, query, scratch


@query("op1_language_id")
def op1(spark, sf_dir):
    """Language of every document; learned from fold != 1 only."""
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(fold(3) != 1).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", (fold(3) == 1).alias("held_out"), "text"), model)


@query("op9_secret_scan")
def op9(spark, sf_dir):
    """Secrets of every document, judged by corpus-wide owners (``source``)."""
    return secret_scan.secret_report(documents(spark, sf_dir), scratch(spark, "op9-spans"))


W = r"[^\x20\x09-\x0D]+"
OP10_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i
      from (select doc_id, regexp_extract_all(t, '{W}') as ws from d)),
v as (select *, case when count(*) over f = 8 then array_to_string(list(word) over f, ' ') end as win from w
      window f as (partition by doc_id order by i rows between current row and 7 following)),
r as (select *, win is not null and count(*) over (partition by doc_id, win) > 1 as rep from v),
c as (select doc_id, count(*) as n, sum(length(word)) as chars, count(*) filter (where cover) as again
      from (select *, bool_or(rep) over (partition by doc_id order by i rows between 7 preceding and current row) as cover from r)
      group by doc_id),
l as (select doc_id, count(*) as lines, count(distinct line) as kinds
      from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{W}') group by doc_id),
m as (select d.doc_id, coalesce(n, 0)::BIGINT as n_words, coalesce(chars, 0)::BIGINT as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT as n_symbols,
             coalesce(lines - kinds, 0)::BIGINT as n_dup_lines, coalesce(again, 0)::BIGINT as n_repeat_words,
             coalesce(lines, 0) as n_lines, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) as letters
      from d left join c using (doc_id) left join l using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_symbols <= 0.25 * n_words and word_chars <= 30 * n_words and letters >= 0.5 * word_chars
       and n_dup_lines <= 0.5 * n_lines and n_repeat_words <= 0.3 * n_words as kept
from b
"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark, sf_dir):
    """Base measures and cascade verdict of every document."""
    return quality.quality_report(documents(spark, sf_dir).select("doc_id", "text"))


@query("op4_packing")
def op4(spark, sf_dir):
    """Pieces of every document, packed into windows of 1024 ids."""
    return packing.pack_documents(documents(spark, sf_dir), scratch(spark, "op4-tokens"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    """Toxicity score of every document; labels of fold != 0 only."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(5) != 0).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs.select("doc_id", (fold(5) == 0).alias("held_out"), "text"), model)


@query("op2_decontamination")
def op2(spark, sf_dir):
    """Every (document, benchmark item) with similarity 0.8 or more."""
    return decontam.find_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op6_near_duplicates")
def op6(spark, sf_dir):
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(documents(spark, sf_dir), scratch(spark, "op6-classes"))


@query("op8_lm_score")
def op8(spark, sf_dir):
    """Class-based language-model score of every document."""
    docs, folder = documents(spark, sf_dir), scratch(spark, "op8-counts")
    model = lmscore.train(docs.where(fold(5) != 1), folder)
    return lmscore.score(docs.select("doc_id", (fold(5) == 1).alias("held_out"), "text"), model, folder)


OP7_SQL = rf"""
with w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i
           from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)),
v as (select *, case when count(*) over f = 50 then md5(array_to_string(list(word) over f, ' ')) end as win from w
      window f as (partition by doc_id order by i rows between current row and 49 following)),
r as (select *, win is not null and min(doc_id) over (partition by win) < doc_id as again from v),
c as (select *, bool_or(again) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from r),
g as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
             coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept from c group by doc_id)
select d.doc_id, coalesce(n_words, 0)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from documents d left join g using (doc_id)
"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark, sf_dir):
    """Words left in every document without repeated 50-word passages."""
    return substring.remove_repeats(documents(spark, sf_dir), scratch(spark, "op7-spans"))


@query("op3_line_dedup", linededup.ORACLE)
def op3(spark, sf_dir):
    """Lines left in every document without repeated multi-line chunks."""
    return linededup.report(documents(spark, sf_dir))


@query("op11_token_alignment")
def op11(spark, sf_dir):
    """Alignment of two tokenizers over every document."""
    import public_tokenizers as P
    return align.alignment(documents(spark, sf_dir), scratch(spark, "op11-spans"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@query("op12_merkle_manifest", merkle.ORACLE)
def op12(spark, sf_dir):
    """Leaf, proof and folded root of every document."""
    return merkle.op12_report(documents(spark, sf_dir))


@query("op13_source_mixing")
def op13(spark, sf_dir):
    """Words that a mix of target weights takes from every document."""
    return mixing.mix(documents(spark, sf_dir), scratch(spark, "op13-mix"))
