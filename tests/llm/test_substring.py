"""Substring deduplication against a plain list of all windows."""

import random
import re

import pyarrow as pa
import pytest

from tidings.llm import substring

RNG = random.Random(3)
VOCABULARY = ["a", "b", "cc", "Ström", "x" * 300, "y" * 9, "eightlet", "0", "z\x85q", "\x1c"] + [f"w{i}" for i in range(30)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


PASSAGES = [sentence(25) for _ in range(4)]
TEXTS = [None, "", " \n ", sentence(5), sentence(19), sentence(20), sentence(5000), "the " * 100, "the " * 50]
TEXTS += [f"{sentence(RNG.randint(0, 30))} {RNG.choice(PASSAGES)}\n{sentence(RNG.randint(0, 30))}\t{RNG.choice(PASSAGES)}"
          for _ in range(40)]
ROWS = [*enumerate(TEXTS)]
# copies under other ids, equal rows, one id on several texts, null ids
ROWS += [(100, TEXTS[6]), (100, TEXTS[6]), (7, TEXTS[10]), (7, sentence(30) + " " + PASSAGES[0]),
         (None, PASSAGES[1] + " " + sentence(3)), (None, TEXTS[6]), (None, TEXTS[6]), (3, TEXTS[3]), (200, TEXTS[5])]


def words_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]


def expected(spark, rows, window):
    hashed = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, text string")
    tie = dict(hashed.selectExpr("k", "xxhash64(cast(text AS binary))").collect())
    seen, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, tie[k], k)):
        words = words_of(rows[k][1])
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            w = tuple(words[a:a + window])
            if w in seen:
                gone[a:a + window] = [True] * window
            seen.add(w)
        out.append((rows[k][0], len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [20, 8, 5])
def test_equals_all_windows(spark, window):
    df = spark.createDataFrame([(*r, "x", 1, [2]) for r in ROWS],
                               "doc_id long, text string, keeper string, id int, pos array<int>").repartition(5)
    got = sorted((tuple(r) for r in substring.remove_repeats(df, window=window).collect()), key=str)
    assert got == expected(spark, ROWS, window)


def test_a_third_of_equal_rows(spark):
    rows = [(1, PASSAGES[0])] * 40 + [(i, sentence(30)) for i in range(2, 82)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == 120 and sum(r["n_removed"] for r in got) == 39 * 25
    assert sorted(tuple(r) for r in got) == sorted(expected(spark, rows, 20))


def test_empty_and_all_null_tables(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = substring.remove_repeats(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, "")] * 3


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        substring.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("period", sorted(substring.COVERS))
def test_covers_hold_every_distance(period):
    members = substring.COVERS[period]
    assert {(a - b) % period for a in members for b in members} == set(range(period))


def test_words_of_any_length_keep_apart():
    texts = ["", None, "a", "a b", "x" * 8, "x" * 9, "x" * 255, "x" * 256, "x" * 257, "x" * 1000 + "y", "x" * 1000 + "z",
             "\x00", "\x00\x00", "é è"]
    h, n = substring.word_hashes(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    assert n.tolist() == [len(words_of(t)) for t in texts]
    words = [w for t in texts for w in words_of(t)]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))
    sliced = pa.array([t.encode() for t in ("no", "a b", "b")], pa.binary()).slice(1)
    h, n = substring.word_hashes(sliced)
    assert n.tolist() == [2, 1] and h[1] == h[2]
