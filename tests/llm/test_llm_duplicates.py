"""Line dedup, n-gram join and components against brute force."""

import random

import pytest

from cohortia.llm import graph, line_dedup, ngram_join
from cohortia.llm.texts import WordHashes

LAST = 2**63 - 1


def within_one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def edited(rng, text, letters="abé "):
    chars = list(text)
    for _ in range(rng.choice([0, 1, 1, 1, 2])):
        k = rng.randrange(len(chars))
        chars[k:k + 1] = rng.choice([[], [rng.choice(letters)], [chars[k], rng.choice(letters)]])
    return "".join(chars)


def test_lines_within_one_edit_of_an_earlier_one_go(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([20, 21, 25, 40, 130, 700]))) for _ in range(12)]
    texts = ["\n".join([edited(rng, rng.choice(base)) for _ in range(rng.randint(1, 6))] + rng.choice([[], ["", " ", "x", "short"]]))
             for _ in range(60)]
    docs = [*enumerate(texts), (100, None), (101, ""), (None, base[0]), (5, texts[5])]
    places = sorted((LAST if d is None else d, k, line) for d, t in set(docs) if t is not None
                    for k, line in enumerate(t.split("\n")) if line.strip())
    gone, near = set(), 0
    for n, (d, k, line) in enumerate(places):
        equal = any(other == line for _, _, other in places[:n])
        close = len(line) >= 20 and any(len(o) >= 20 and within_one_edit(o, line) for _, _, o in places[:n])
        near += close and not equal
        if equal or close:
            gone.add((d, k))
    frame = spark.createDataFrame([(d, t, "n", 3) for d, t in docs], "doc_id long, text string, n_lines string, h long")
    found = line_dedup.dedup_lines(frame)
    assert found.columns == ["doc_id", "text", "h", "n_lines", "n_equal", "n_near"]
    rows = found.collect()
    assert len(rows) == len(docs) and near > 20
    assert sum(r.n_near for r in {r.doc_id: r for r in rows}.values()) == near
    by_id = dict(docs)
    for r in rows:
        text, d = by_id[r.doc_id], LAST if r.doc_id is None else r.doc_id
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)
        assert r.text == kept


def test_line_dedup_without_rows(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_force(rows):
    hashes = WordHashes()
    sets = [set(ngram_join.ngram_set(t, hashes).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [k for k, (d, _) in enumerate(rows) if d is not None]
    for n, i in enumerate(named):
        for j in named[:n]:
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    least = {}
    for k in named:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((d, len(sets[k]), None if d is None else least[root(k)]) for k, (d, _) in enumerate(rows)), key=str)


def near_rows():
    rng = random.Random(1)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(k, " ".join(rng.choice(base) for _ in range(80))) for k in range(20)]
    for k in range(50):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((5000 + k, " ".join(words)))
    rows += [(6000 + k, " ".join(f"A{i}" if k % 2 else f"a{i}" for i in range(rng.randint(3, 12)))) for k in range(30)]
    return rows + [(7000, None), (7001, ""), (7002, "  \n"), (None, "a b c"), (None, rows[0][1]), rows[0], (3, "the same id again")]


@pytest.mark.parametrize("most", [4000, 6])
def test_components_of_similar_documents(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "GROUP_EDGES", 1_000_000 if most > 6 else 40)
    rows = near_rows()
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, cls int, n int")
    found = ngram_join.near_duplicates(frame, most=most)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force(rows)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(4, text, "a"), (9, text + " more", "b"), (9, text + " more", "b"), (5, "something else entirely", "c"),
            (5, "something else entirely", "c"), (None, text, "d"), (6, None, "e")]
    found = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n string"))
    assert found.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id or -1, r.n) for r in found.collect()) == [(-1, "d"), (4, "a"), (5, "c"), (6, "e")]


def test_an_id_of_two_texts_loses_only_the_repeated_one(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(4, text, "a"), (9, text + " more", "b"), (9, "something else entirely", "c"), (9, None, "d"),
            (2, other, "e"), (2, other + " more", "e")]
    found = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n string"))
    assert sorted((r.doc_id, r.n) for r in found.collect()) == [(2, "e"), (4, "a"), (9, "c"), (9, "d")]


def test_n_gram_join_without_rows(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [1_000_000, 30])
def test_components(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "GROUP_EDGES", size)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(45)]
    edges += [(500, k) for k in range(501, 540)] + [(-5, 9), (7, 7)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in found) == sorted((x, top(x)) for x in root)
