"""Language ID, quality, toxicity and URL filters against plain versions and held-out labels."""

import itertools
import zlib

import numpy as np
import pytest

from cohortia.llm import language_id, quality, queries, toxicity, url_filter
from cohortia.llm.texts import WordHashes, encoded, words_of

FOLDER = "/root/testdata/sf0.01"
CLASHING = "doc_id long, text string, score double, quality int, toxic int, h long, n_words string, lang string"


def odd_rows(spark, texts):
    rows = [(k, t, 0.5, 1, 0, 7, "x", "en") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, texts[0], None, None, None, None, None, None)], CLASHING)


ODD = ["plain words here", None, "", " \n\t ", "12 34 !!", "é", "word " * 50_000, "plain words here", "a\u00a0b\u2003c"]


@pytest.fixture(scope="module")
def language_rows(spark):
    return queries.op1_language_id(spark, FOLDER).collect()


def test_languages_of_held_out_documents(spark, language_rows):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(language_rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in language_rows)
    held = [r for r in language_rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in language_rows)


def test_language_of_odd_rows(spark):
    labelled = spark.createDataFrame(
        [(k, t, lang) for k, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de")] * 5)]
        + [(99, "no language", None), (None, "no id", "fr")], "doc_id long, text string, lang string")
    model = language_id.learn(labelled)
    assert model.languages == ["de", "en"]
    rows = {r.doc_id: r for r in language_id.identify(odd_rows(spark, ["the house", *ODD[1:]]), model).collect()}
    assert rows[None].lang_pred == rows[0].lang_pred == "en"
    for k in (1, 2, 3, 4):
        assert (rows[k].lang_pred, rows[k].score) == ("und", 0.0)
    assert rows[5].lang_pred in ("de", "en")
    kept = language_id.keep_known(odd_rows(spark, ["the house", *ODD[1:]]), model)
    assert kept.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert {r.doc_id for r in kept.collect()} >= {0, None} and 1 not in {r.doc_id for r in kept.collect()}


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.learn(empty)
    assert language_id.identify(empty, model).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd_rows(spark, ODD), model).collect()} == {"und"}


def test_filter_finds_each_ngram_and_few_others():
    grams, _ = language_id.ngrams(["some text to learn from"])
    words = np.zeros((1, 1 << 12), np.uint8)
    for spot in language_id.places(grams, 1 << 12):
        words[0, spot] |= 1
    model = language_id.LanguageFilter(["xx"], words, np.array([np.mean(words[0] & 1) ** language_id.HASHES]))
    total, held = model.counts(["some text to learn from"])
    assert held[0, 0] == pytest.approx(total[0])
    total, held = model.counts(["zyx wvu qponm lkj " * 200])
    assert held[0, 0] < 0.05 * total[0]


def plain_counts(text):
    words = words_of(text)
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    repeated = {w for w in windows if windows.count(w) > 1}
    covered = {k + j for k, w in enumerate(windows) if w in repeated for j in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            sum(line in lines[:k] for k, line in enumerate(lines)), len(covered))


@pytest.mark.parametrize("text", ["a b c a b c d", "x x x x", "one\ntwo\n \none\none", "", None, "#a|b <c> é é é é", "a b", "a b c a b c"])
def test_counts(text):
    assert quality.counts(text or "", WordHashes().of(encoded(text).split())) == plain_counts(text)


def test_quality_of_documents(spark):
    rows = queries.op4_quality_rules(spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows[:150]:
        if len(texts[r.doc_id]) < 4000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([kept == (label == 1) for kept, label in judged]) > 0.97


def test_quality_of_odd_rows(spark):
    neutral = quality.learn(odd_rows(spark, ODD), spark.createDataFrame([], "doc_id long, quality int"))
    rows = {r.doc_id: r for r in quality.judge(odd_rows(spark, ODD), neutral).collect()}
    assert len(rows) == len(ODD) + 1 and rows[1].n_words == 0 and rows[1].base_failed
    assert rows[6].n_words == 50_000 and rows[6].base_failed and rows[6].n_repeat_words == 50_000
    assert rows[8].n_words == 1  # only ASCII blanks part words
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty, neutral).collect() == []


def best_segments(scores):
    """Maximal scoring segments by their definition: the best one, then the same on both sides."""
    if not len(scores):
        return []
    best = max(((sum(scores[a:b]), a - b, -a, a, b) for a, b in itertools.combinations(range(len(scores) + 1), 2)))
    if best[0] <= 0:
        return []
    total, a, b = best[0], best[3], best[4]
    # the shortest of equal segments, so that no edge adds nothing
    return best_segments(scores[:a]) + [(a, b, total)] + [(x + b, y + b, w) for x, y, w in best_segments(scores[b:])]


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = rng.integers(-4, 4, rng.integers(1, 16)) + rng.normal(0, 1e-3, 1)[0]
        found = [(a, b) for a, b, _ in toxicity.maximal_segments(scores)]
        assert found == sorted((a, b) for a, b, _ in best_segments(list(scores)))


def test_toxicity_of_documents(spark):
    rows = queries.op5_toxicity(spark, FOLDER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in held]) > 0.85  # few labelled rows at this size


def test_toxicity_of_odd_rows(spark):
    rows = [(k, "you vile pest go away now" if k % 2 else "we walk home in the rain today") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    found = {r.doc_id: r for r in toxicity.score(odd_rows(spark, ["such a vile pest", *ODD[1:]]), model).collect()}
    assert found[0].predicted == found[None].predicted == 1 and found[0].segments[0].words >= 1
    assert all(found[k].predicted == 0 and found[k].segments == [] for k in (1, 2, 3))
    empty = spark.createDataFrame([], "doc_id long, text string")
    nothing = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, nothing).collect() == []


def ranked(rows, labels):
    """Share of pairs of a row of either label that the scores order rightly; ties count half."""
    toxic, other = ([r.score for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in toxic for b in other])


def test_toxicity_ranks_unseen_texts_whichever_label_is_marked(spark):
    """Also where only texts of label 0 have words of their own, and where few labelled rows hold a word."""
    rng = np.random.default_rng(8)
    common, vile = [f"word{k}" for k in range(200)], [f"vile{k}" for k in range(12)]
    rows, marked = [], {}
    for k in range(400):
        words = list(rng.choice(common, 60))
        marked[k] = int(k % 8 == 0)
        if marked[k]:
            words[20:23] = rng.choice(vile, 3)
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in (marked, {k: 1 - v for k, v in marked.items()}):
        known = spark.createDataFrame([(k, v) for k, v in labels.items() if k < 240], "doc_id long, toxic int")
        found = toxicity.score(docs.filter("doc_id >= 240"), toxicity.learn(docs, known)).collect()
        assert ranked(found, labels) > 0.95


def test_url_rules(spark):
    urls = ["http://a.NET/x", "http://example.net/en/1", "https://m.example.com/de/9?q=1", "http://x.org/fr/a#b", "http://example.net",
            "nothing", None, "http://net/", "x://exampleXnet/en/", "http://notexample.com/de/", "http://x.net?y/", "http://a.net/\nb"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(None, urls[0], "h", "r"), (0, urls[0], "h", "r")],
                                  "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, blocked boolean")
    rows = url_filter.judge(pages, queries.URL_RULES, url_filter.mined(pages, none)).collect()
    assert len(rows) == len(urls) + 2
    found = {r.page_id: r for r in rows}
    verdicts = [(found[k].rule, found[k].verdict) for k in range(len(urls))]
    assert verdicts == [
        ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block")]
    assert (found[5].host, found[5].path) == (found[6].host, found[6].path) == ("", "")
    assert (found[10].host, found[10].path, found[11].path) == ("x.net", "", "/\nb")


def test_mined_url_rules(spark):
    pages = spark.createDataFrame(
        [(k, f"http://{'bad' if k % 4 == 0 else 'good'}.site/{'win' if k % 3 == 0 else 'read'}/{k}") for k in range(240)],
        "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 4 == 0 and k % 3 == 0) for k in range(0, 240, 2)], "page_id long, blocked boolean")
    rules = url_filter.mined(pages, labels, least_share=0.05)
    assert {tuple(r.tokens) for r in rules.collect()} == {("h:bad", "p:win")}  # with h:site it says no more
    blocked = {r.page_id for r in url_filter.judge(pages, [], rules).collect() if r.verdict == "block"}
    assert blocked == set(range(0, 240, 12))


def test_rules_of_four_tokens_and_of_any_script(spark):
    """Pages are blocked only where four tokens meet; each three of them are mostly harmless."""
    words = ["купить", "win", "日本", "ü"]
    rows = []
    for k in range(320):
        held = [w for bit, w in enumerate(words) if k % 16 >> bit & 1]
        rows.append((k, "http://a.site/" + "/".join(held) + f"/{k}", len(held) == 4))
    frame = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    rules = url_filter.mined(frame.select("page_id", "url"), frame.select("page_id", "blocked"))
    assert {tuple(r.tokens) for r in rules.collect()} == {tuple(sorted(f"p:{w}" for w in words))}
    blocked = {r.page_id for r in url_filter.judge(frame.select("page_id", "url"), [], rules).collect() if r.verdict == "block"}
    assert blocked == {k for k, _, bad in rows if bad}
