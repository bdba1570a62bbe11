"""Token alignment, Merkle manifest and mixing against plain Python."""

import collections
import os
import random
import sys
import zlib

import pytest

import __spark_entry__ as E

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

SF, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
Q = E.queries()
ODD = ["", None, "a", " ", "  x  y ", "日本語 テキスト", "☃☃ 🎉🎉x 👩\u200d👩\u200d👧", "▁a b", "x ▁y", "x\x00 y", "<|endoftext|> a <s> <0x41> <unk>",
       "a\u0085 b  c\u3000d", "é\u0301é", "\n\n\t x", "naïve café", "a" * 300, "\u200b \u200b", "𝔘𝔫𝔦 𐍈 x", "\ufffd \ufeffx", " ", "x ", " x", "\n"]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P

    from tallyfold.llm.align import Tokenizers
    files = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    return files, Tokenizers(*files)


def _odd(seed, n):
    rnd = random.Random(seed)
    pool = ["a", " ", " the", "é", "日", "🎉", "\n", "'s", "12", "𝔘", "\t", "ſ", "\u0301"]
    return ["".join(rnd.choice(pool + ["▁"] * (k % 9 == 0)) for _ in range(rnd.randrange(40))) for k in range(n)]


def test_alignment_of_parts(tokenizers, monkeypatch):
    from tallyfold.llm import align
    files, t = tokenizers
    texts = ODD + _odd(1, 400)
    for cache in (400_000, 150):  # without and with parts dropped from the cache
        monkeypatch.setattr(align, "CACHE_PARTS", cache)
        do = align.Aligner(*files)
        for i in range(0, len(texts), 90):
            got, sha, (at, pairs, counts) = do(texts[i: i + 90])
            for k, x in enumerate(texts[i: i + 90]):
                want = brute.alignment(x, t.a, t.b, t.a_bytes, t.b_bytes)
                assert (*got[:, k], sha[k]) == want[:5], x
                have = {(p >> 32, p & 0xFFFFFFFF): c for p, c in zip(pairs[at[k]: at[k + 1]].tolist(), counts[at[k]: at[k + 1]].tolist())}
                assert have == collections.Counter(want[5]), x


def _alignment_rows(texts, t):
    each = [(d, brute.alignment(x, t.a, t.b, t.a_bytes, t.b_bytes)) for d, x in texts]
    count = collections.Counter(p for _, r in each for p in r[5])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, *r[:4], sum(count[p] == best[p[1]] for p in r[5]), sum(count[p] for p in r[5]), r[4]) for d, r in each]


@pytest.mark.parametrize("head", [1 << 19, 40, 0])
def test_alignment(spark, tokenizers, tmp_path, head):
    from tallyfold.llm import align
    files, t = tokenizers
    texts = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += [(i, x) for i, x in enumerate(ODD + _odd(2, 60))] + [(None, "a null id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in align.alignment(docs, str(tmp_path), *files, head=head).collect()]
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(got, key=key) == sorted(_alignment_rows(texts, t), key=key)


def test_alignment_query(spark, tokenizers):
    got = Q["op11_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    files, t = tokenizers
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:  # links are the elementary intervals: n_a + n_b - common ends
        assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= r.count_sum
        want = t.a.encode(" " + texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_a in (0, len(want))


def _tampered(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 0


MERKLE_ROWS = {
    "one row": [(1, "Ab", "en", "s", 3)],
    "nulls, ties, repeats": [(i % 700 if i % 50 else None, f"Text {i % 900}" if i % 11 else None, [None, "en", "de", "é", "", "en"][i % 6],
                              None if i % 7 == 0 else "s", i % 900 if i % 5 else None) for i in range(2500)],
    "three layers, odd runs": [(i, f"T{i}", "en" if i % 5 else f"l{i % 17}", "s", i) for i in range(6000)],
    "many languages": [(i, f"T{i}", f"l{i % 530}", "s", i) for i in range(1100)],
}


@pytest.mark.parametrize("case", sorted(MERKLE_ROWS))
def test_merkle(spark, case):
    from tallyfold.llm import merkle
    rows = MERKLE_ROWS[case]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in merkle.op12_report(docs).collect()]
    key = lambda r: (r[0] is not None, r)
    rank = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(got, key=rank) == sorted(brute.merkle(rows, _tampered), key=rank), key


def test_merkle_finds_a_change(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyfold.llm import merkle
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = merkle.manifest(docs, str(tmp_path / "a")).collect()
    assert all(r.verified for r in clean)
    upper = {r.doc_id for r in docs.collect() if r.doc_id % 4 == 0 and r.text != r.text.translate(brute.LOWER)}
    got = merkle.manifest(docs, str(tmp_path / "b"), F.col("doc_id") % 4 == 0).collect()
    assert {r.doc_id for r in got if not r.verified} == upper and upper
    assert {r.root for r in got} == {r.root for r in clean}


def _mixed(spark, rows, folder):
    from tallyfold.llm import mixing
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mixing.mix(docs, str(folder)).collect()


def _check_mix(got, near):
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    want = brute.mixing_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert abs(taken[s] - target[s]) <= near(s, [r.size for r in got if r.source == s])
    assert all(r.source_size == size[r.source] for r in got)


def test_mixing_query(spark):
    got = Q["op13_source_mixing"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r.size == len(brute.words(texts[r.doc_id])) for r in got) and len(got) == len(texts)
    _check_mix(got, lambda s, sizes: 0.02 * sum(sizes))
    again = Q["op13_source_mixing"](spark, SMALL).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_edges(spark, tmp_path):
    rows = [(1, "a b c", "x"), (2, None, "x"), (None, "a b", None), (3, "", "y"), (4, "a " * 50, "z"), (4, "a " * 50, "z"), (5, "q", "z")]
    rows += [(i, "w " * (i % 40), f"s{i % 7}") for i in range(700)] + [(i, "hot hot", "s0") for i in range(500)]
    got = _mixed(spark, rows, tmp_path)
    assert len(got) == len(rows)
    _check_mix(got, lambda s, sizes: min(x for x in sizes if x) if any(sizes) else 0)


def test_rates_solve_the_dual(spark, tmp_path):
    """Unrounded rates are min(3, exp(lambda x)) and give the target."""
    import math

    from tallyfold.llm import mixing
    rnd = random.Random(5)
    h = [(s, k, rnd.randrange(1, 9)) for s in range(6) for k in rnd.sample(range(1, 4000), 60)]
    size = {s: sum(k * n for t, k, n in h if t == s) for s in range(6)}
    longest = {s: max(k for t, k, _ in h if t == s) for s in range(6)}
    factor = (0.02, 0.5, 1.0, 1.7, 2.95, 3.0)
    goal = spark.createDataFrame([(s, size[s], longest[s], size[s] * factor[s]) for s in range(6)], "s long, source_size long, longest long, target double")
    dual = {r["s"]: r["lambda"] for r in mixing.balance(spark.createDataFrame(h, "s long, size long, docs long"), goal, str(tmp_path)).collect()}
    assert dual[5] == math.inf and abs(dual[2]) < 1e-9
    for s in range(5):
        words = sum(n * k * min(3, math.exp(dual[s] * k / longest[s])) for t, k, n in h if t == s)
        assert words == pytest.approx(size[s] * factor[s], rel=1e-6)
