"""Spelling variants against brute force, and the odd cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loopweave.llm import spelling


def near(word):
    """All words of one edit that are made of the same few letters."""
    letters = "abcö"
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def brute(counts, ratio):
    form, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in near(w) if o in counts)
        if others and -others[0][0] >= ratio * n:
            form[w] = others[0][1]
        out[w] = [n, len(others)]
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, *out[w], counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("seed, longest, big", [(0, 4, 1 / 20_000), (1, 7, 1 / 20_000), (2, 5, 1 / 40), (3, 5, 1.0)])
def test_groups_against_brute_force(spark, monkeypatch, seed, longest, big):
    """Few letters and short words: runs, ends that are words, light words beside each other; edges by broadcast and by shuffle."""
    monkeypatch.setattr(spelling, "BIG", big)
    rng = random.Random(seed)
    counts = {"".join(rng.choice("aabcö") for _ in range(rng.randint(1, longest))): int(3 ** rng.uniform(0, 9)) for _ in range(150)}
    got = spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"), 3)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == brute(counts, 3)


def test_long_and_odd_words(spark):
    long = "ab" * 3_000
    rows = [(long, 500), (long + "a", 3), (long[:2_999] + "c" + long[3_000:], 2), (long[1:], 1), (None, 4), ("", 9), ("x", 2), ("x", 5), ("z" * 2_000, 1)]
    got = {r.word: (r.n, r.n_near, r.form) for r in spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    # a word of alternating letters without its first is one without its last, with one put before
    assert got[long] == (500, 3, None) and got[long + "a"] == (3, 1, long) and got["x"] == (7, 0, None) and len(got) == 6
    empty = spelling.spelling_groups(spark.createDataFrame([], "word string, n long"))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError, match="without end"):
        spelling.spelling_groups(spark.createDataFrame([], "word string, n long"), 1)
    with pytest.raises(Exception, match="beyond code point 255"):
        spelling.spelling_groups(spark.createDataFrame([("łódka", 1)], "word string, n long"))


def test_corpus_words(spark):
    rng = random.Random(5)
    words = ["Straßen", "GRÖßENx", "abcdefgh", "Überzug", "x", "naïvetés", "zwei", "longestwordofall"]
    docs = [(k if k % 9 else None, " ".join(rng.choice(words) + rng.choice([",", "7", "_", " 世", "\n"]) for _ in range(rng.randint(0, 30))) if k % 7 else [None, ""][k % 2], "x", 1, "y") for k in range(300)]
    docs.append((1_000, "verylongtext " * 200_000, "x", 1, "y"))
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n int, id string")
    want = Counter()
    for k, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = {r.word: r.n for r in spelling.corpus_words(df, spoil=31).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and len(got) > 10
    assert spelling.corpus_words(df.limit(0)).count() == 0


def test_merging_is_small_to_large(spark):
    """Words that share a long head and many alike words: no more merges than light edges, no row for each pair of a group."""
    words = [f"commonheadofmanywords{a}{b}tail" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long").mapInArrow(spelling._keyed, "word string, n long, t1 long, t2 long")
    light = spelling._light(table)
    per_word = defaultdict(int)
    for r in light.select("t1", "t2").collect():
        per_word[r.t1, r.t2] += 1
    assert sum(per_word.values()) <= 2 * len(words) and max(per_word.values()) == 2
    got = spelling.spelling_groups(table.select("word", "n"))
    assert {r.n_near for r in got.collect()} == {19 + 25} and got.where(F.col("word") != F.col("root")).count() == 0
