"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. One pass over the texts finds the base spans (exact rules per kind) and candidates: base matches with and
   without their checks, and wider forms that a base rule misses (numbers that run into each other, spelled-out signs).
2. Regex, gazetteer and context labelers vote on every candidate: 1, -1, or 0 (no opinion).
   Equal vote patterns of a kind are counted over all documents.
3. Expectation-maximisation over the patterns estimates how often each labeler votes which way on
   personal data and on other text, with no labels. The posterior of a pattern is its probable label.
4. A logistic classifier for spans learns these labels from features of the span and its
   surroundings, on a bounded sample of candidates, and scores them all. Candidates that reach LEAST
   and touch no base span are added, the best first, none over another.

Offsets are code points, ends exclusive. Results for odd input: null and empty texts have no spans; a null id keeps its
row; repeated rows get equal results; every rule walks through a text of any length in time
in proportion to it; without candidates only the base is there; columns besides doc_id and text take no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.logistic import sigmoid
from cohortia.session import stored

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # candidates that the classifier is fitted on, about
LEAST = 0.5  # probability of an added span
EM_ROUNDS = 60
AROUND = 30  # code points of context

# The base rules. Left borders keep a failed start from being tried again at each digit.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Wider forms.
_SPELLED = re.compile(r" ?[(\[{]at[)\]}] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]+)*", re.IGNORECASE)
_BARE = re.compile(r"@[A-Za-z0-9-]+")
_WIDE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{12,19})(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?:(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
                        r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"),
}

# Gazetteers and context words.
_TOP_LEVEL = frozenset("com org net edu gov io info biz de fr es uk us eu it nl ch at be pt mx ar ca".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91".split())
_NEARBY = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|kontakt|write to)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(?:ip|host|server|address|client|adresse|dirección)\b", re.IGNORECASE),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono|anruf)\b", re.IGNORECASE),
}
_ELSEWISE = re.compile(r"\b(?:version|v|license|licence|section|isbn|issn|order|invoice|page|figure|commit|sha|token|key|build)\b", re.IGNORECASE)
LABELERS = ("rule", "check", "shape", "gazetteer", "context", "border")


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octets(span: str) -> list[str]:
    return re.findall("[0-9]+", span)


def _part(x: str) -> bool:
    """Whether a number of any length is 255 at most."""
    return len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255


def _local_begin(text: str, at: int, least: int) -> int:
    begin = at
    while begin > least and text[begin - 1] in _LOCAL:
        begin -= 1
    return begin


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether its check holds) of the leftmost non-overlapping matches of each rule."""
    at, done = text.find("@"), 0
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            begin = _local_begin(text, at, done)
            if begin < at:
                yield "email", begin, host.end(), True
                done = host.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(map(_part, octets(m.group())))
    for m in _CARD.finditer(text):
        own = digits_of(m.group())
        yield "card", m.start(), m.end(), 12 <= len(own) <= 19 and luhn(own)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(digits_of(m.group())) <= 15


def wider_matches(text: str) -> Iterator[tuple[str, int, int]]:
    done = 0
    for m in _SPELLED.finditer(text):
        begin = _local_begin(text, m.start(), done)
        if begin < m.start():
            yield "email", begin, m.end()
            done = m.end()
    at, done = text.find("@"), 0
    while at >= 0:
        host = _BARE.match(text, at)
        begin = _local_begin(text, at, done) if host else at
        if begin < at:
            yield "email", begin, host.end()
            done = host.end()
        at = text.find("@", at + 1)
    for kind, form in _WIDE.items():
        for m in form.finditer(text):
            yield kind, m.start(), m.end()


def votes(kind: str, span: str, left: str, right: str, base: int) -> list[int]:
    """One vote of each labeler; base: 1 and -1 for a base match with and without its check, 0 for others."""
    own = digits_of(span)
    if kind == "email":
        host = re.split(r"[@)\]}]", span, maxsplit=1)[-1].strip()
        last = re.split(r"[.)\]} ]+", host)[-1].lower()
        check = 1 if re.fullmatch("[a-z]{2,}", last) and "." in host + "." * ("dot" in host) else -1
        shape = 1 if re.fullmatch(r"[^@]{1,64}@[^@]+\.[A-Za-z]{2,24}", span) else 0 if "at" in span else -1
        known = 1 if last in _TOP_LEVEL else 0
    elif kind == "ip":
        parts = octets(span)
        check = 1 if len(parts) == 4 and all(map(_part, parts)) else -1
        shape = 1 if all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in parts) else -1
        known = 1 if _part(parts[0]) and 1 <= int(parts[0][-3:]) <= 223 and int(parts[0][-3:]) != 127 else -1
    elif kind == "card":
        check = 1 if 12 <= len(own) <= 19 and luhn(own) else -1
        shape = 1 if re.fullmatch(r"[0-9]{13,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
        known = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)", own) else -1
    else:
        check = 1 if 9 <= len(own) <= 15 else -1
        shape = 1 if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}", span) else -1
        known = 0 if span[:1] != "+" else 1 if any(own.startswith(c) for c in _CALLING) else -1
    near = 1 if _NEARBY[kind].search(left) else -1 if _ELSEWISE.search(left) else 0
    before, after = left[-1:], right[:1]
    closed = (before.isalnum() or before in ("=", "_", "/", "#", "-") and before != "") or after.isalnum() or after in ("_", "/") and after != ""
    return [base, check, shape, known, near, -1 if closed else 1]


def features(kind: str, span: str, left: str, right: str, ballot: list[int]) -> list[float]:
    """What the classifier sees: the span's make-up and surroundings, and what was checked; not the base rule's vote."""
    own, n = digits_of(span), max(1, len(span))
    before, after = left[-1:], right[:1]
    values = [
        1.0, np.log1p(n) / 3, len(own) / n, len(own) / 16, sum(c in " -." for c in span) / 4, float("+" in span),
        float("(" in span), len(set(own)) / 10, sum(c.isupper() for c in span) / n, float(before in ("", " ", "\n", ",", "(", ":", "<")),
        float(after in ("", " ", "\n", ",", ".", ")", ";", ">", "?", "!")), float(before.isalnum()), float(after.isalnum()),
        float(len(own) > 19), *(float(v) for v in ballot[1:5])]
    out = [0.0] * (len(values) * len(KINDS))
    begin = KINDS.index(kind) * len(values)
    out[begin:begin + len(values)] = values
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_TRIAL = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("x", pa.list_(pa.float64()))])
_FOUND = ("doc_id long, base array<struct<kind: string, start: long, end: long>>, "
          "trials array<struct<kind: string, start: long, end: long, votes: string, x: array<double>>>")
_SIGNS = {1: "+", 0: "0", -1: "-"}


def scanned(text: str | None) -> tuple[list[dict], list[dict]]:
    """Base spans in order, and all candidates with their votes and features."""
    if not text:
        return [], []
    matches = {(k, a, b): 1 if holds else -1 for k, a, b, holds in base_matches(text)}
    rank = {kind: n for n, kind in enumerate(KINDS)}
    base = sorted((key for key, vote in matches.items() if vote > 0), key=lambda s: (s[1], rank[s[0]]))
    trials = []
    for kind, a, b in sorted(matches.keys() | set(wider_matches(text))):
        if kind == "card" and matches.get((kind, a, b)) == -1 and b - a < 12:
            continue  # short numbers are no candidates
        span, left, right = text[a:b], text[max(0, a - AROUND):a], text[b:b + 1]
        ballot = votes(kind, span, left, right, matches.get((kind, a, b), 0))
        trials.append({"kind": kind, "start": a, "end": b, "votes": "".join(map(_SIGNS.get, ballot)), "x": features(kind, span, left, right, ballot)})
    return [dict(zip(("kind", "start", "end"), s)) for s in base], trials


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scanned(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([b for b, _ in found], pa.list_(_SPAN)), pa.array([t for _, t in found], pa.list_(_TRIAL))],
            names=["doc_id", "base", "trials"])


def reliabilities(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[np.ndarray, dict[str, float]]:
    """(label, labeler, vote): how probable a vote is; and the probable label of each pattern of one kind.

    Starts at the majority of the votes. The votes of each labeler are taken as independent given the label;
    a few imagined votes in its own direction keep a labeler that agrees with no one from turning around.
    """
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    seen = np.array([[{"-": 0, "0": 1, "+": 2}[c] for c in p] for p in names]).reshape(len(names), len(LABELERS))
    belief = sigmoid(2.0 * (seen - 1).sum(axis=1))
    leaning = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])[:, None, :].repeat(len(LABELERS), axis=1)
    chance = leaning / leaning.sum(axis=2, keepdims=True)
    for _ in range(rounds if len(names) else 0):
        mass = np.stack([n * (1 - belief), n * belief])
        chance = leaning.copy()
        for label in (0, 1):
            for labeler in range(len(LABELERS)):
                chance[label, labeler] += np.bincount(seen[:, labeler], mass[label], 3)
        chance /= chance.sum(axis=2, keepdims=True)
        prior = (mass[1].sum() + 1) / (n.sum() + 2)
        log = np.log(chance[:, np.arange(len(LABELERS)), seen]).sum(axis=2)
        belief = sigmoid(np.log(prior) - np.log(1 - prior) + log[1] - log[0])
    return chance, dict(zip(names, belief.tolist()))


def fitted(x: np.ndarray, goal: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model for probable labels, by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(30 if len(x) else 0):
        p = sigmoid(x @ weights)
        slope = x.T @ (p - goal) + ridge * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def learned(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the span classifier from the votes of all candidates."""
    trials = found.select(F.col("doc_id"), F.explode("trials").alias("t")).select("doc_id", "t.*")
    # At most 3 ** len(LABELERS) patterns of each kind.
    counts = trials.groupBy("kind", "votes").count().collect()
    belief = {}
    for kind in KINDS:
        own = {r["votes"]: r["count"] for r in counts if r["kind"] == kind}
        belief |= {(kind, p): b for p, b in reliabilities(own)[1].items()}
    total = sum(r["count"] for r in counts)
    if not total:
        return np.zeros(0)
    grain = 1 << 30
    drawn = F.pmod(F.xxhash64("doc_id", "kind", "start", "end"), F.lit(grain)) < min(grain, grain * sample // total)
    # Equal candidates count once with their number, so that copies of a document don't fill the sample.
    rows = trials.filter(drawn).groupBy("kind", "votes", "x").count().orderBy("kind", "votes", "x").limit(2 * sample).toArrow()
    x = np.array(rows.column("x").to_pylist()).reshape(rows.num_rows, -1)
    goal = np.array([belief[k, v] for k, v in zip(rows.column("kind").to_pylist(), rows.column("votes").to_pylist())])
    return fitted(x, goal)


def private_spans(docs: DataFrame, *, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """doc_id, base and spans for every row of docs (doc_id, text): arrays of (kind, start, end), and score in spans."""
    found = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _FOUND), "candidates")
    weights = learned(found, sample).tolist()

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(weights)
        kind_of = pa.list_(pa.struct([*_SPAN, pa.field("score", pa.float64())]))
        for batch in batches:
            spans = []
            for base, trials in zip(batch.column("base").to_pylist(), batch.column("trials").to_pylist()):
                spans.append(chosen(base, trials, own, least) if trials else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("base"), pa.array(spans, kind_of)], names=["doc_id", "base", "spans"])

    return found.mapInArrow(decided, (
        "doc_id long, base array<struct<kind: string, start: long, end: long>>, "
        "spans array<struct<kind: string, start: long, end: long, score: double>>"))


def chosen(base: list[dict], trials: list[dict], weights: np.ndarray, least: float) -> list[dict]:
    """The base spans and the added ones, by start and kind."""
    scores = sigmoid(np.array([t["x"] for t in trials]) @ weights)
    kept = {(s["kind"], s["start"], s["end"]) for s in base}
    score = {(t["kind"], t["start"], t["end"]): float(p) for t, p in zip(trials, scores)}
    free = sorted((-p, a, -b, kind) for (kind, a, b), p in score.items() if p >= least and (kind, a, b) not in kept)
    taken = sorted((a, b) for _, a, b in kept)
    # Base spans of different kinds may overlap; for what touches them their union is enough.
    union: list[list[int]] = []
    for a, b in taken:
        if union and a <= union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    begins, ends = [a for a, _ in union], [b for _, b in union]
    added: list[tuple[int, int]] = []
    for _, a, less, kind in free:
        b = -less
        k = bisect_right(begins, b - 1) - 1
        if k >= 0 and ends[k] > a:
            continue
        k = bisect_right(added, (b - 1, 1 << 62)) - 1
        if k >= 0 and added[k][1] > a:
            continue
        insort(added, (a, b))
        kept.add((kind, a, b))
    rank = {kind: n for n, kind in enumerate(KINDS)}
    return [{"kind": k, "start": a, "end": b, "score": score[k, a, b]} for k, a, b in sorted(kept, key=lambda s: (s[1], rank[s[0]], s[2]))]
