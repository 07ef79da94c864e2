"""Very long texts at production parameters, clashing extra columns, ties and hubs."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from xsecta.llm import ann, bpe, common, jaccard, mixing, suffix, urls


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_bpe_tree_at_its_real_leaves_equals_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    words = "".join(rng.choice(["the ", "naïve ", "x", "12 ", "\n", "  ", "日本", "ing "]) for _ in range(60_000))
    solid = "".join(rng.choice("abc") for _ in range(70_000))  # a pretoken above a leaf
    assert len(words) > 4 * bpe.LEAF and len(solid) > 4 * bpe.LEAF
    rows = [(1, words), (2, solid), (3, words[: 4 * bpe.LEAF + 1]), (4, "short")]
    frame = spark.createDataFrame([(i, t, "clash", b"clash") for i, t in rows], "doc_id long, text string, leaf string, ids binary")
    got = sorted(tuple(r) for r in bpe.encode_documents(frame, bpe.default_tokenizer()).collect())
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids)


def test_long_texts_of_mixing_joins_and_repeats(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40_000))
    rows = [(1, long, "a"), (2, long + " tail", "a"), (3, "few words", "b")]
    frame = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, source string, e string, size double")
    sizes = {r.doc_id: r["size"] for r in mixing.mix(frame).collect()}
    assert sizes == {1: 40_000, 2: 40_001, 3: 2}
    assert {r.doc_id: r.component_id for r in jaccard.link(frame).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r for r in suffix.deduplicate(frame).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len(long) and got[2].kept_sha256 == sha(" tail")


def test_neighbours_and_urls_ignore_clashing_columns_and_break_ties_by_id(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[30:] = x[:30]  # each vector twice
    shape = "vec_id long, embedding array<double>, head long, node string, sim float, packed binary, mark string"
    frame = spark.createDataFrame([(i, v.tolist(), 7, "n", 0.5, b"p", "m") for i, v in enumerate(x)], shape)
    got = ann.neighbours(frame, 10, 3).orderBy("query_id", "rank").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = np.round(unit @ unit[q], 12)
        best = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:3]
        assert [r.vec_id for r in got if r.query_id == q] == best
    pages = spark.createDataFrame([(1, "http://a.net/es/x", "h", "p", "r", 1), (2, None, "h", "p", "r", 1), (3, "http://b.com/q", "h", "p", "r", 1)], "page_id long, url string, host string, path string, rule string, bad int")
    assert {r.page_id: (r.host, r.rule) for r in urls.judge(pages).collect()} == {1: ("a.net", "net/es/"), 2: ("", None), 3: ("b.com", "com/")}


def test_pages_of_a_hot_path_get_the_same_verdicts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://x.net/{'es' if i % 3 else 'docs'}/{i % 4}") for i in range(80)] + [(100 + i, None) for i in range(40)], "page_id long, url string")
    plain = sorted(map(tuple, urls.judge(pages).collect()), key=repr)
    monkeypatch.setattr(urls, "HOT", 5)
    assert sorted(map(tuple, urls.judge(pages).collect()), key=repr) == plain


def test_a_hub_s_text_is_dealt_out(spark):
    pairs = spark.createDataFrame([(i, 1) for i in range(2, 60)] + [(70, 71)], "a long, b long")
    texts = spark.createDataFrame([(i, f"t{i}") for i in [*range(1, 60), 70, 71]], "e long, text string")
    for most in (1_000_000, 1):
        met = common.texts_of_pairs(pairs, texts, members=5, most=most)
        assert met.count() == 59 and met.filter(F.col("text_a") != F.concat(F.lit("t"), F.col("a"))).isEmpty() and met.filter(F.col("text_b") != F.concat(F.lit("t"), F.col("b"))).isEmpty()
