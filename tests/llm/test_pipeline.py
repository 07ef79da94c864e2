import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from xsecta.llm import common, mixing

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, __row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash") for i, t, s in rows], SHAPE).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(n))


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_one_of_each_group_stays(spark):
    rng = random.Random(1)
    long = words(rng, 80)
    near = long.replace(long.split()[40], "zz", 1)
    rows = [(3, long, "a"), (2, near, "a"), (9, words(rng, 50), "a"), (4, "", "a"), (5, None, "a"), (6, long.upper(), "b")]
    assert rows_of(cp.one_of_each(spark, table(spark, rows), "")) == Counter(rows[1:5])


def test_null_and_repeated_ids_keep_their_texts(spark):
    rng = random.Random(2)
    texts = [words(rng, 40) for _ in range(6)]
    rows = [(7, texts[0], "a"), (7, texts[1], "a"), (None, texts[2], "a"), (None, texts[3], "b"), (None, texts[4], None), (8, texts[5], "a")]
    again = [(7, texts[0], "a"), (None, texts[2], "a"), (None, None, "a"), (None, None, "a"), (8, "", "a")]
    got = rows_of(cp.one_of_each(spark, table(spark, rows + again), ""))
    assert got == Counter(rows + again[2:])


@pytest.mark.parametrize("bin_rows", [7, 50_000])
def test_mix_takes_each_row_as_often_as_said(spark, bin_rows):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(0, 30)), rng.choice(["a", "a", "b", "c", None])) for i in range(200)]
    rows += [(None, words(rng, k), "a") for k in range(1, 9)] + [(5, "x y z", "a")] * 9 + [(300, None, "b"), (301, " \t", "c")]
    docs = table(spark, rows)
    said = Counter()
    for r in mixing.mix(docs, bin_rows=bin_rows).collect():
        if r.taken:
            said[(r.doc_id, r.size)] += -(-r.taken // r.size)
    got = Counter()
    for r in mixing.mixed(docs, bin_rows=bin_rows).collect():
        assert (r.doc_id, r.text, r.source) in rows and r["__row"] == "clash"
        got[(r.doc_id, len(r.text.split()))] += 1
    assert got == said and max(got.values()) > 1


def test_mix_does_not_depend_on_the_bins(spark):
    rng = random.Random(4)
    docs = table(spark, [(i, words(rng, rng.randint(0, 30)), rng.choice("aab")) for i in range(150)])
    assert Counter(mixing.mix(docs, bin_rows=5).collect()) == Counter(mixing.mix(docs).collect())


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.co", "a"), (1, "mail a@b.co", "a"), (None, None, None), (2, "clean", "a")]
    got = cp.redacted(spark, table(spark, rows), "")
    assert got.columns == SHAPE.replace(" long", "").replace(" string", "").split(", ")
    assert rows_of(got) == Counter([(1, "mail [EMAIL]", "a")] * 2 + rows[2:])


def written():
    from pathlib import Path
    from urllib.parse import urlparse

    return {path for path, _ in common._written if Path(urlparse(path).path).exists()}


def test_scratch_goes_once_nothing_reads_it(spark):
    rng = random.Random(5)
    docs = table(spark, [(i, words(rng, 30), "a") for i in range(20)])
    common.sweep(spark)
    before = written()
    first = cp.one_of_each(spark, docs, "")
    made = written() - before
    assert first.count() == 20 and made
    del first
    second = cp.redacted(spark, docs, "")
    assert not made & written() and second.count() == 20


def test_results_of_several_stages_stay_readable(spark):
    rng = random.Random(7)
    docs = table(spark, [(i, words(rng, 30) + " a@b.co", "a") for i in range(20)])
    a = cp.redacted(spark, docs, "").filter("doc_id >= 0")
    b = cp.redacted(spark, docs.filter("doc_id < 5"), "")
    c = cp.mixed(spark, docs, "")
    common.sweep(spark)
    assert a.count() == 20 and b.count() == 5 and c.count() >= 20


def test_all_stages_take_empty_tables(spark):
    none = table(spark, [(1, "x", "a")]).limit(0)
    for name, function in cp.STAGES[1:]:
        assert function(spark, none, "").count() == 0, name


def test_the_whole_pipeline(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, words(rng, 40) if i % 3 else words(rng, 40).upper().replace(" ", "!! "), f"s{i % 3}") for i in range(150)]
    rows += [(1000 + i, rows[i + 1][1], "s1") for i in range(0, 30, 3)]
    table(spark, rows).drop("__row").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    good = {i for i in range(150) if i % 3}
    assert got <= good | {i for i in range(150)} and len(got & good) > 60 and not got & set(range(1000, 2000))
