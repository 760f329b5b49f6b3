"""Spelling variants: the index against brute force, the whole result against its SQL."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from cohortia.llm import spelling
from cohortia.llm.sql import OP12


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def vocabulary(rng, n, letters="abé"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.choice([5, 5, 6, 7, 8]))) for _ in range(n)} | {"a" * 5, "a" * 6, "x" * 70, "x" * 71})


def test_index_finds_all_words_one_error_behind_the_half():
    words = vocabulary(random.Random(1), 300)
    halves = np.array([len(w) // 2 for w in words])
    ahead = spelling.FmIndex([w[::-1] for w in words]).one_error(words, halves)
    behind = spelling.FmIndex(words).one_error([w[::-1] for w in words], np.array([len(w) for w in words]) - halves)
    found = set(zip(*map(np.ndarray.tolist, ahead))) | set(zip(*map(np.ndarray.tolist, behind)))
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and one_apart(a, b)}


def test_suffixes_are_in_order():
    words = vocabulary(random.Random(3), 50)
    text = "\n" + "".join(w + "\n" for w in words)
    suffixes = sorted(range(len(text) + 1), key=lambda k: text[k:])
    index = spelling.FmIndex(words)
    assert [text[k - 1] if k else "" for k in suffixes] == [
        chr(index.alphabet[c - 1]) if c else "" for c in index.bwt.tolist()]


def test_neighbours_with_small_shards_and_cut_halves(spark):
    words = vocabulary(random.Random(7), 400)
    frame = spark.createDataFrame([(w, k % 9 + 3) for k, w in enumerate(words)], "word string, n long")
    wanted = {(a, b, k % 9 + 3) for a in words for k, b in enumerate(words) if one_apart(a, b)}
    assert len(wanted) > 500
    for chars, hot in ((500, 7), (10**6, 10**6)):
        found = spelling.neighbours(frame, shard_chars=chars, hot_words=hot).collect()
        assert {tuple(r) for r in found} == wanted


def test_variants_are_the_same_as_sql_on_odd_rows(spark):
    rng = random.Random(11)
    base = ["etant", "étant", "etants", "Straße", "naïve", "naive", "CAFÉS", "cafés", "cafes", "×÷×÷×", "wörter", "worter", "abc", "Ωμεγα"]
    texts = [" ".join(rng.choices(base, k=rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " 12 .", "hello-hello_hello" * 5, "z" * 3000 + " " + "z" * 2999, "naïve " * 4000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "cafés cafés cafés étants")]
    frame = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    connection = duckdb.connect()
    connection.register("documents", pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
    wanted = connection.sql(OP12)
    found = spelling.variants(frame, shard_chars=200, hot_words=3).select(*wanted.columns).collect()
    assert sorted(map(tuple, found)) == sorted(wanted.fetchall()) and len(found) > 10


def test_long_texts_are_walked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 3)
    text = "alpha bravo charlie delta golfo alpha bravo " * 30_000
    assert len(text) > 1_000_000
    found = spelling.occurrences(spark.createDataFrame([(1, text)], "doc_id long, text string"), damage=None).groupBy("word").sum("n").collect()
    assert dict(map(tuple, found)) == {"alpha": 60_000, "bravo": 60_000, "charlie": 30_000, "delta": 30_000, "golfo": 30_000}


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).collect() == []
