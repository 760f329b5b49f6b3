"""Personal data: base spans against the plain rules, reliabilities and added spans on planted cases."""

import hashlib
import random
import re
import time

import numpy as np

from cohortia.llm import pii, queries

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 12 <= len(d) <= 19 and sum(
        sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
}


def plain(text):
    spans = [(m.start(), n, m.end(), kind) for n, (kind, (rule, holds)) in enumerate(RULES.items())
             for m in re.finditer(rule, text) if holds(m.group(), re.sub("[^0-9]", "", m.group()))]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def odd_texts(rng):
    parts = ["a.b@c.de", "@", "x@y", "@c.d", ".e@f", "1.2.3.4", "256.1.1.1", "001.2.3.4", "1.2.3", "4539578763621486", "4539 5787 6362 1486",
             "4539-5787-6362-1487", "+1 (743) 555-3824", "+1", "+49 30 1234567", "+123", "é@é.fr", "ñ ", " ", "\n", ",", "-", "+", ".", "0", "77", "(at)", "joe (at) mail (dot) org",
             "joe[at]mail.org", "192[.]168[.]0[.]7", "(555) 123-4567", "٣٤٥", "abc"]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


def test_base_spans_are_those_of_the_rules():
    for text in odd_texts(random.Random(1)):
        base, trials = pii.scanned(text)
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in base] == plain(text)
        held = {(s["kind"], s["start"], s["end"]) for s in base}
        rows = pii.chosen(base, trials, np.ones(len(trials[0]["x"])) if trials else np.zeros(0), 0.5) if trials else []
        spans = [(s["kind"], s["start"], s["end"]) for s in rows]
        assert held <= set(spans)
        for k, a, b in set(spans) - held:  # added spans touch no other
            assert all(b <= c or d <= a for other in spans if other != (k, a, b) for _, c, d in [other])


def test_reliabilities_tell_good_labelers_from_noise():
    rng = random.Random(3)
    counts = {}
    for _ in range(20_000):
        y = rng.random() < 0.3
        ballot = [(y if rng.random() < r else not y) for r in (0.95, 0.9, 0.9, 0.8, 0.5, 0.85)]
        pattern = "".join("+" if v else "-" for v in ballot)
        counts[pattern] = counts.get(pattern, 0) + 1
    chance, belief = pii.reliabilities(counts)
    right = chance[1, :, 2]
    assert np.allclose(right, [0.95, 0.9, 0.9, 0.8, 0.5, 0.85], atol=0.03)
    assert belief["++++++"] > 0.99 and belief["----+-"] < 0.01
    assert pii.reliabilities({})[1] == {}


def corpus(rng, n=400):
    docs = []
    for k in range(n):
        words = [rng.choice("lorem ipsum dolor sit amet version 3 release 4.0 of".split()) for _ in range(30)]
        kind = k % 8
        if kind == 0:
            words.insert(9, f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} today")
        elif kind == 1:
            words.insert(9, f"mail j{k}@mail.example.com")
        elif kind == 2:
            words.insert(9, f"{rng.randint(1, 200)}.{rng.randint(0, 255)}.7.{rng.randint(0, 255)}")
        elif kind == 3:
            body = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
            words.insert(9, body + next(c for c in "0123456789" if pii.luhn(body + c)))
        elif kind == 4:
            words.insert(9, "token=" + hashlib.sha256(str(k).encode()).hexdigest())
        docs.append((k, " ".join(words)))
    return docs


def test_numbers_that_run_into_each_other_are_added_and_clean_texts_left_alone(spark):
    docs = corpus(random.Random(5))
    joined = "see +1 (743) 555-3824 4539578763621486 and +1 (523) 555-1055 19.158.174.88 now"
    rows = docs + [(1000, joined), (1001, None), (1002, ""), (None, joined), (1000, joined)]
    frame = spark.createDataFrame([(d, t, "b", 1) for d, t in rows], "doc_id long, text string, base string, spans int")
    found = {}
    for r in pii.private_spans(frame).collect():
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert found.setdefault(r.doc_id, spans) == spans
    texts = dict(rows)
    assert [(k, joined[a:b]) for k, a, b in found[1000]] == [
        ("phone", "+1 (743) 555-3824"), ("card", "4539578763621486"), ("phone", "+1 (523) 555-1055"), ("ip", "19.158.174.88")]
    assert found[None] == found[1000] and found[1001] == found[1002] == []
    for d, text in docs:
        if d % 8 > 4:
            assert found[d] == [], text
        elif d % 8 < 4:
            assert len(found[d]) == 1


def test_query_columns(spark, folder):
    rows = [(d, t) for d, t in corpus(random.Random(6), 80)] + [(500, None), (501, "a@b.c 1.2.3.4 a@b.c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r for r in queries.op11_personal_data(spark, folder).collect()}
    for d, text in rows:
        spans = plain(text or "")
        assert found[d].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [found[d][f"n_{k}"] for k in RULES] == [sum(s.startswith(k) for s in spans) for k in RULES]
        assert set(spans) <= set(found[d].spans.split(",")) or not spans


def test_empty_table_and_long_texts(spark):
    assert pii.private_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 700_000, "a@" * 500_000, "+1 " * 500_000, "(at)" * 300_000):
        begin = time.time()
        pii.scanned(text)
        assert time.time() - begin < 20
