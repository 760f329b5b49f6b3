"""Archives, packing, search, mixing and the pipeline: round trips and exact versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortia.llm import mixing, nearest, packing, queries, warc
from cohortia.session import scratch_path, stored

FOLDER = "/root/testdata/sf0.001"
EVIL = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n"


@pytest.mark.parametrize("compression,split,zone", [("gzip", "128m", 1 << 20), ("none", "2k", 5000), ("gzip", "128m", 300)])
def test_archives_round_trip(spark, monkeypatch, compression, split, zone):
    written = []
    monkeypatch.setattr(warc, "stored", lambda df, name: written.append(name) or stored(df, name))
    rows = [(k, f"http://a/{k}", f"é{k} " * (k % 90) + (EVIL * (k % 4) if k % 3 == 0 else "")) for k in range(120)]
    rows += [(1000, None, None), (1001, None, ""), *((2000 + k, "u\r\nv", "twice WARC/1.1\r\n") for k in range(4))]
    rows += [(None, "n", "twice WARC/1.1\r\n"), (None, None, "only null"), rows[7]]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    path = scratch_path(spark, "test-archives")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        warc.write(pages.repartition(3), path, compression=compression)
        found = warc.read(spark, path, keep_payload=True, zone_bytes=zone).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    jumps = sum(name.startswith("warc-jumps") for name in written)
    assert jumps >= 6 if zone == 300 else jumps >= 2 if zone == 5000 else jumps == 0
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        expected.append((page_id, "response" if page_id == first else "revisit", None if page_id == first else first, len(data),
                         base64.b32encode(hashlib.sha1(data).digest()).decode(), True))
    assert sorted(map(str, expected)) == sorted(str((
        r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.intact)) for r in found)
    by_id = {p: h for p, _, h in rows}
    assert all(r.payload.decode() == (by_id[r.page_id] or "") for r in found if r.record_type == "response" and r.page_id is not None)


def test_archives_with_a_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                                  "page_id long, url string, html string")
    path = scratch_path(spark, "test-archives")
    warc.write(pages, path, revisit_bytes=3)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()) == [
        (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_fast_ids_are_the_vocabulary_s_ids():
    fast = packing.Tokens(**queries.byte_tokens())
    plain = packing.Tokens(queries.byte_tokens()["vocabulary"], None, None)
    rng = random.Random(2)
    texts = ["", " ", "a<|endoftext|>b", "it's  \n\n 12 345\t", "日本 🙂 é́ x", "x" * 5000, "\x00\x01\r\n"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), 32, 10])) for _ in range(200)) for _ in range(30)]
    for text in texts:
        assert fast.of(text).tolist() == plain.of(text).tolist()


@pytest.mark.parametrize("group_items", [50_000, 16])
def test_packing_is_whole_and_tight(spark, group_items):
    rng = random.Random(5)
    texts = ["word " * rng.choice([1, 30, 200, 700, 1500, 5000]) for _ in range(90)] + [None, "", "word " * 2047, "word " * 2048]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fill int")
    found = packing.pack(packing.pieces(docs, **queries.byte_tokens()), group_items=group_items).collect()
    ids = packing.Tokens(**queries.byte_tokens())
    expected = []
    for doc_id, text, _ in rows:
        own = np.append(ids.of(text or ""), 0).astype("<u4")
        first = len(own) % 2048 or 2048
        cuts = [own[:first], *(own[k:k + 2048] for k in range(first, len(own), 2048))]
        starts = np.cumsum([0, *map(len, cuts)])
        expected += [(doc_id, k, int(starts[k]), len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in found)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and held[0][0] == 0
        assert held[-1][0] + held[-1][1] <= 2048
    least = -(-sum(r.length for r in found) // 2048)
    assert len(sequences) <= least * (1.05 if group_items > 16 else 1.15) + 1


def test_packing_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty, **queries.byte_tokens())).collect() == []


def test_neighbours_are_found(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = queries.op9_nearest_neighbours(spark, FOLDER).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids = np.array(sorted(data))
    matrix = np.stack([data[k] for k in ids])
    hits = 0
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for query in ids[ids % 20 == 0]:
        scores = np.where(ids == query, -np.inf, matrix @ data[query])
        best = ids[np.lexsort((ids, -scores))[:20]]
        mine = sorted(got[query])
        assert [rank for rank, _, _ in mine] == list(range(1, 21)) and query not in [v for _, v, _ in mine]
        assert all(abs(score - data[v] @ data[query]) < 1e-12 for _, v, score in mine)
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]),
               (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = {}
    for r in nearest.search(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == {0: [(1, 1.0), (2, 1.0), (20, 0.5), (10, -1.0)], 20: [(0, 0.5), (1, 0.5), (2, 0.5), (10, -0.5)]}
    assert nearest.search(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_neighbours_in_slices(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 7)
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 0.0, 0.0] if k % 3 == 0 else rng.normal(size=3).tolist()) for k in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.search(frame, F.col("vec_id") % 20 == 0, k=5, ratio=9.0, list_vectors=30).collect()
    data = np.array([v for _, v in rows])
    for query in range(0, 90, 20):
        scores = (data * data[query]).sum(axis=1)
        scores[query] = -np.inf
        best = np.lexsort((np.arange(90), -scores))[:5].tolist()
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == query] == best


def test_neighbours_in_separate_groups(spark):
    rng = np.random.default_rng(4)
    data = np.repeat(rng.normal(size=(40, 16)), 150, axis=0)  # 1,000 lists, 25 in each group
    data[:, :3] += 0.05 * rng.normal(size=(len(data), 3))
    data /= np.linalg.norm(data, axis=1)[:, None]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(frame, F.col("vec_id") % 20 == 0, k=10, list_vectors=6).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for query in range(0, len(data), 20):
        scores = data @ data[query]
        scores[query] = -np.inf
        hits.append(len(got[query] & set(np.argsort(-scores)[:10].tolist())))
    assert min(hits) > 0 and sum(hits) >= 0.9 * 10 * len(hits)


def test_the_graph_of_centres_hangs_together():
    rng = np.random.default_rng(9)
    centres = np.concatenate([rng.normal(size=(60, 8)) * 0.01 + place for place in 50 * rng.normal(size=(12, 8))])
    links, entries = nearest.graph_of(centres)
    assert all(a in links[b] for a, own in enumerate(links) for b in own.tolist())
    a = np.repeat(np.arange(len(centres)), [len(x) for x in links])
    assert set(nearest.components(len(centres), a, np.concatenate(links)).tolist()) == {0}
    assert len(set((entries // 60).tolist())) == 12 and len(entries) < len(centres) / 8
    sizes = np.ones(len(centres), int)
    # A walk that asks for everything reaches everything; one that asks for its nearest finds it and sees little else.
    assert len(nearest.walk(centres[0], entries[:1], centres, links, 1.0, sizes, len(centres))) == len(centres)
    found = list(nearest.lists_of(centres, centres, (links, entries), 1.15, sizes, 8))
    assert all(k in own for k, own in enumerate(found)) and max(map(len, found)) < 60


def test_neighbours_among_repeated_ids(spark):
    """Hundreds of rows of one id fill the nearest lists; the other ids are found all the same."""
    rng = np.random.default_rng(2)
    rows = [(1, (np.array([1.0, 0, 0]) + 0.01 * rng.normal(size=3)).tolist()) for _ in range(399)]
    rows += [(k, (np.array([-1.0, 0, 0]) + rng.normal(size=3)).tolist()) for k in range(2, 600) if k % 20]
    rows += [(20, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.search(frame, F.col("vec_id") % 20 == 0, list_vectors=16).orderBy("rank").collect()
    assert [r.rank for r in found] == list(range(1, 21)) and len({r.vec_id for r in found}) == 20
    best = {}
    for k, v in rows[:-1]:
        best[k] = max(v[0], best.get(k, -9.0))
    assert all(r.score == best[r.vec_id] for r in found) and 1 in {r.vec_id for r in found}
    assert len({r.vec_id for r in found} & set(sorted(best, key=best.get)[-20:])) >= 18


def test_neighbours_of_huge_vectors(spark):
    rows = [(k, [(-1.0) ** k * 1e200, 1e200 * (k % 3)]) for k in range(41)]
    found = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3)
    assert [(r.query_id, r.vec_id, r.score) for r in found.orderBy("query_id", "rank").collect()] == [
        (q, v, float("inf")) for q in (0, 20, 40) for v in [v for v in (0, 2, 4, 6) if v != q][:3]]


@pytest.fixture(scope="module")
def mixture(spark):
    rows = [(k, ("alpha beta gamma " if k % 3 else "delta !!! epsilon ") * (1 + k % 7)) for k in range(90)]
    docs = spark.createDataFrame([*rows, (90, None), (91, ""), (None, rows[0][1]), (5, rows[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(0, 90, 2)] + [(None, "c"), (1, None)],
                                   "doc_id long, domain string")
    return docs.withColumn("copies", F.lit("x")).withColumn("p", F.lit(1)), labels


def test_rates_meet_the_targets(spark, mixture):
    docs, labels = mixture
    for least, grow, targets in ((0.0, False, {"a": 0.5, "b": 0.5}), (1.0, True, {"a": 0.9, "b": 0.1}), (0.0, False, {"a": 1.0, "b": 0.0})):
        rows = mixing.rates(docs, labels, targets, least=least, grow=grow).collect()
        assert len(rows) == docs.count() and min(r.rate for r in rows) >= least
        total = {name: sum(r.n_words * r.p[name] * r.rate for r in rows) for name in targets}
        share = total["a"] / sum(total.values())
        assert abs(share - targets["a"]) < 0.01
        assert [r.rate for r in rows if r.doc_id == 90] == [1.0]
        assert all(abs(r.copies - r.rate) < 1 for r in rows)


@pytest.mark.parametrize("least,grow", [(0.0, False), (1.0, True)])
def test_rates_with_a_few_very_long_rows(spark, least, grow):
    rows = [(1_000_000, [0.01, 0.99]), (400_000, [0.02, 0.98]), (2_000_000, [0.97, 0.03])]
    rows += [(300, [0.04 + k % 5 / 100, 0.96 - k % 5 / 100]) for k in range(10_000)]
    rows += [(300, [0.999 - k % 7 / 100, 0.001 + k % 7 / 100]) for k in range(30_000)]
    members = stored(spark.createDataFrame(rows, "n_words long, p array<double>"), "test-members")
    for share in (0.07, 0.5):
        rate, found = mixing.fitted_rate(members, ["good", "toxic"], {"good": 1 - share, "toxic": share}, least=least, grow=grow)
        wanted = sum(w for _, w in found.values())
        assert all(abs(reached - w) < 1e-5 * wanted for reached, w in found.values())
        sums = members.withColumn("rate", rate).agg(F.min("rate"), *(F.sum(F.col("n_words") * F.col("p")[d] * F.col("rate")) for d in (0, 1))).collect()[0]
        assert sums[0] >= least and abs(sums[2] / (sums[1] + sums[2]) - share) < 1e-5


def test_rates_of_targets_out_of_reach(spark):
    rows = [(100 + k, [0.9 - k % 5 / 10, 0.1 + k % 5 / 10]) for k in range(50)]
    members = stored(spark.createDataFrame(rows, "n_words long, p array<double>"), "test-members")
    rate, found = mixing.fitted_rate(members, ["a", "b"], {"a": 0.2, "b": 0.8})
    mass = np.array([[n * x for x in p] for n, p in rows])
    weights = np.linalg.cholesky(np.linalg.inv(mass.T @ mass)).T
    wanted = np.array([found["a"][1], found["b"][1]])
    reached = np.array([found["a"][0], found["b"][0]])
    bound = min(np.linalg.norm(weights @ (mass[k] * x - wanted)) for k in range(50) for x in np.linspace(0, 100, 4001))
    assert np.linalg.norm(weights @ (reached - wanted)) <= 1.02 * bound


def test_rates_out_of_reach_above_a_bound(spark):
    rows = [(100 + k, [0.9 - k % 5 / 10, 0.1 + k % 5 / 10]) for k in range(50)]
    members = stored(spark.createDataFrame(rows, "n_words long, p array<double>"), "test-members")
    rate, found = mixing.fitted_rate(members, ["a", "b"], {"a": 0.05, "b": 0.95}, least=0.2)
    rates = [r.rate for r in members.withColumn("rate", rate).collect()]
    mass = np.array([[n * x for x in p] for n, p in rows])
    assert min(rates) >= 0.2 - 1e-12 and np.allclose(sorted(np.array(rates))[0], 0.2)
    weights = np.linalg.inv(mass.T @ mass)
    wanted = np.array([found["a"][1], found["b"][1]])
    place = np.full(50, 1.0)
    for _ in range(20_000):  # the plain gradient, whose step is the inverse of the largest eigenvalue, 1
        place = np.maximum(0.2, place - mass @ weights @ (place @ mass - wanted))
    miss = lambda e: e @ weights @ e
    assert miss(np.array([found["a"][0], found["b"][0]]) - wanted) <= 1.03 * miss(place @ mass - wanted)


def test_mixed_rows_keep_their_columns(spark, mixture):
    docs, labels = mixture
    found = mixing.mixed(docs, labels, {"a": 0.3, "b": 0.7}, least=1.0, grow=True)
    assert found.columns == docs.columns
    assert found.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert found.count() > docs.count()


def test_mixing_without_labels_or_rows(spark, mixture):
    docs, labels = mixture
    assert {r.rate for r in mixing.rates(docs, labels.limit(0), {"a": 1.0}).collect()} == {1.0}
    assert mixing.rates(docs.limit(0), labels, {"a": 0.5, "b": 0.5}).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == columns, name
        assert docs.join(before, "doc_id", "left_anti").isEmpty(), name
        counts.append(docs.select("doc_id").distinct().count())
    assert counts[1] > 0.95 * counts[0] and counts[-1] == counts[-2] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID"
