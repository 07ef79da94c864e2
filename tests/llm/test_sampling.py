"""Importance resampling, the chosen-path join and conversation repair against plain versions of their contracts."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from xsecta.llm import chosenpath, conversations, resample

DOCS = "doc_id long, text string, lang string, weight double"


def plain_importance(docs, target, grams, buckets, least, percent, seed=2024):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for rank, row in enumerate(fit[: len(fit) * percent // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("grams", [1, 2])
def test_importance_equals_plain_version(spark, grams):
    r = random.Random(5)
    words = ["Der", "die", "x1", "naïve", "É", "42", "z", "日本", "end."]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(60)]
    docs += [(7, docs[7][1]), (7, "other words here now"), (None, "no id but x1 words"), (None, None), (90, ""), (91, " .,;\x00 "), (92, "lang " * 70_000)]
    target = ["die x1 x1 É", None, "naïve 日本"]
    frame = spark.createDataFrame([(*d, "de", 1.0) for d in docs], DOCS)
    wanted = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, item_id long")
    got = resample.importance(frame, wanted, grams=grams, buckets=50, least=4, percent=30)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_importance(docs, target, grams, 50, 4, 30)


def test_importance_of_empty_tables_and_drawn_rows(spark):
    frame = spark.createDataFrame([(i, f"one two three word{i}", "de", float(i)) for i in range(10)], DOCS)
    none, target = frame.filter("false"), spark.createDataFrame([], "text string")
    assert resample.importance(none, target).count() == 0
    rows = resample.resampled(frame, target, least=2, percent=40)
    assert rows.columns == ["doc_id", "text", "lang", "weight", "__rank"] and sorted(r["__rank"] for r in rows.collect()) == [1, 2, 3, 4]


def plain_classes(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}

    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def test_chosen_path_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou") for _ in range(n)]
    docs, bases = [], [text(60) for _ in range(8)]
    for k, base in enumerate(bases):
        for _ in range(40 if k == 0 else 6):  # a hub of near copies, above LIMIT
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice("XYZ")
            docs.append(" ".join(w))
    docs += [docs[0], docs[0].upper(), "", None, "one", "ONE", "two", "  \n", " ".join(text(30_000))]
    docs.append(docs[-1] + " tail")
    docs = list(enumerate(docs, 100))
    monkeypatch.setattr(chosenpath, "HUB", 7)
    frame = spark.createDataFrame([(*d, "de", 1.0) for d in docs], DOCS).repartition(3)
    assert sorted(map(tuple, chosenpath.link(frame).collect())) == plain_classes(docs)


def test_chosen_path_takes_nulls_repeats_and_empty_tables(spark):
    long = "a b c d e f g h i j k l m n o p"
    rows = [(None, long), (5, long), (5, long), (5, "other text that differs"), (9, long + " q"), (9, long + " q")]
    got = sorted(map(tuple, chosenpath.link(spark.createDataFrame([(*r, None, None) for r in rows], DOCS)).collect()), key=repr)
    assert got == sorted([(None, 15, None, True), (5, 15, 5, True), (5, 15, 5, True), (5, 3, 5, True), (9, 16, 5, False), (9, 16, 5, False)], key=repr)
    assert chosenpath.link(spark.createDataFrame([], DOCS)).count() == 0


def test_forest_is_sized_for_its_depth():
    assert chosenpath.survival(1) == pytest.approx(1 - 0.75 * 0.2 - 0.25 * 0.04)
    for depth in (2, 4, 8):
        assert (1 - chosenpath.survival(depth)) ** chosenpath.trees(depth) <= chosenpath.MISSED


LEGAL = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """The cheapest edits by Dijkstra over (rows done, role initials so far), whole strings and no automaton."""
    faults, seen = [], set()
    for role, text in rows:
        blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        faults.append(3 if blank else 2 if again else 0 if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else 1)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, audit, i, initials, made = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if (i, initials, audit) in done:
            continue
        done.add((i, initials, audit))
        if i == len(rows) and LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
        if len(initials) > len(rows) + 3:
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, initials + role[0], (*made, f"{role}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, made))
            if faults[i] < 2:
                extra = int(faults[i] == 1)
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initials + role[:1], (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, initials + new[0], (*made, f"{new}:{text}")))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [faults.count(3), faults.count(2), faults.count(1), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()]


def test_repair_equals_exhaustive_search(spark):
    r = random.Random(11)
    data, expected = [], {}
    for conv in range(60):
        rows = []
        for turn in range(r.randrange(1, 5)):
            rows.append((r.choice(["user", "assistant", "system", "tool", " "]), r.choice(["Yes.", "no", "Sure! ", "", " \t", "Was?\n", "x"]) + (str(turn) + "." if r.random() < 0.5 else "")))
        data += [(conv, t, role, text, "extra") for t, (role, text) in enumerate(rows)]
        expected[conv] = plain_repair(rows)
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, mark string").repartition(3)
    got = {row[0]: list(row[2:]) for row in conversations.report(frame).collect()}
    assert got == expected


def test_repair_by_fragments_is_the_same():
    r = random.Random(2)
    rows = [(r.choice("usax"), r.choice([0, 0, 1, 2, 3])) for _ in range(300)]
    whole = conversations.rows_matrix(rows)
    cut = conversations.product([conversations.rows_matrix(rows[i : i + 37]) for i in range(0, 300, 37)])
    one = conversations.rows_matrix(rows[:1])
    for row in rows[1:]:
        one = conversations._times(one, conversations._edit(*row))
    assert whole == cut == one


def test_damage_nulls_gaps_and_empty_tables(spark):
    shape = "conv_id long, turn long, role string, text string"
    rows = [(c, t, r_, x) for c, t, r_, x in [(None, None, None, None), (None, 4, "user", "Hi."), (1, 0, "user", "Hello there! Ok."), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, None, "user", "a"), (3, 5, "system", "b.")] + [(9, i, "user", "Text. More?") for i in range(60)]]
    frame = spark.createDataFrame(rows, shape)
    blank = lambda v: " " if v is None else str(v)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        if k:
            want += [(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    assert sorted(map(tuple, conversations.damaged(frame).collect()), key=repr) == sorted(want, key=repr)
    got = {r["conv_id"]: r for r in conversations.report(frame, frame.unionByName(spark.createDataFrame([(77, 1, "user", "x")], shape))).collect()}
    assert set(got) == {None, 1, 2, 3, 9, 77}
    assert got[1]["gaps"] == 2 and got[1]["duplicate"] == 1 and got[2]["gaps"] == 0 and got[None]["blank"] == 1
    assert tuple(got[77])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.report(frame.filter("false")).count() == 0


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(1, i, r_, f"t{i}.") for i, r_ in enumerate(["assistant", "user", "user", "system", "assistant", "user"])]
    found = conversations.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = conversations.repaired(found, conversations.audits(found)).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1)) and LEGAL.fullmatch("".join(r["role"][0] for r in got))
