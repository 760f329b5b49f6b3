"""Quality: counting rules, then a calibrated logistic regression on hashed words and character n-grams.

A word counts by its share of the text's words, a character n-gram (three bytes
of the UTF-8 text) by its share of all of the text's n-grams; both are hashed
into weight vectors of fixed size. The model is learned from a bounded sample of
labelled rows; a part of the sample that the weights haven't seen turns the raw
score into a probability of good quality, weighted back to the labels' true
shares. Documents are scored whole, in Arrow batches.

Results for odd input: null, empty and blank texts have no words, all counts are 0 and
``base_failed`` is true. Without labels of both kinds every probability is 0.5
(kept unless the rules fail). Equal texts get equal results; null ids are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm import logistic
from cohortia.llm.texts import WordHashes, encoded, mixed, sampled

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
THRESHOLD = 0.5  # least probability of good quality
SAMPLE_ROWS = 2000  # labelled rows of each label that the model is learned from, about
WORD_BITS, GRAM_BITS = 17, 15
CALIBRATION_PART = 4  # every fourth sampled row
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, quality double")


def repeated_words(hashes: np.ndarray) -> int:
    """Words covered by three-word windows that occur at least twice in the text."""
    m = len(hashes) - 2
    if m < 2:
        return 0
    _, ids = np.unique(hashes, return_inverse=True)
    ids = ids.astype(np.uint64)  # below 2^21 words exact, hashed beyond
    window = (ids[:m] << np.uint64(42)) ^ (ids[1:m + 1] << np.uint64(21)) ^ ids[2:]
    if len(hashes) >= 1 << 21:
        window = mixed(ids[:m] * np.uint64(3)) + mixed(ids[1:m + 1] * np.uint64(5)) + mixed(ids[2:] * np.uint64(7))
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k:k + m] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def counts(text: str, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    return (
        len(hashes),
        len(text) - sum(map(text.count, SPACE)) if text else 0,
        sum(map(text.count, SYMBOLS)) if text else 0,
        repeated_lines(text),
        repeated_words(hashes),
    )


def features(data: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of all character n-grams."""
    words = mixed(hashes) >> np.uint64(64 - WORD_BITS)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return words, np.zeros(0, np.uint32)
    grams = (raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761)
    return words, grams >> np.uint32(32 - GRAM_BITS)


def learn(docs: DataFrame, labels: DataFrame, *,
          sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(word weights, n-gram weights, scale, shift) from docs (doc_id, text) and labels (doc_id, quality 0/1).

    About ``sample_rows`` rows of each label go to one task, which returns the
    weights: fixed sizes, whatever the table holds.
    """
    neutral = np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << GRAM_BITS, np.float32), 0.0, 0.0
    usable = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int"))
    sample, shares = sampled(usable, "quality", sample_rows)
    if set(shares) != {0, 1}:
        return neutral
    # A bounded number of ids; the texts stay where they are read.
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            index, value = [], []
            for text in batch.column("text").to_pylist():
                data = encoded(text)
                found = []
                for offset, buckets in zip((0, 1 << WORD_BITS), features(data, hashes.of(data.split()))):
                    kinds, n = np.unique(buckets, return_counts=True)
                    found.append((kinds.astype(np.int32) + offset, (n / max(1, n.sum())).astype(np.float32)))
                index.append(np.concatenate([x[0] for x in found]))
                value.append(np.concatenate([x[1] for x in found]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
                "index": pa.array([x.tobytes() for x in index], pa.binary()),
                "value": pa.array([x.tobytes() for x in value], pa.binary())})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending")])
        index = [np.frombuffer(x, np.int32) for x in table.column("index").to_pylist()]
        value = [np.frombuffer(x, np.float32) for x in table.column("value").to_pylist()]
        label = table.column("quality").to_numpy()
        later = np.arange(len(label)) % CALIBRATION_PART == CALIBRATION_PART - 1
        size = (1 << WORD_BITS) + (1 << GRAM_BITS)

        def chosen(which: np.ndarray) -> logistic.Sparse:
            at = np.flatnonzero(which)
            begins = np.cumsum([0, *(len(index[k]) for k in at)])[:-1]
            return logistic.Sparse(np.concatenate([index[k] for k in at] or [np.zeros(0, np.int32)]),
                                   np.concatenate([value[k] for k in at] or [np.zeros(0, np.float32)]), begins)

        weights, bias = logistic.fit(chosen(~later), label[~later], size)
        rows = chosen(later)
        seen = {k: max(1, int((label == k).sum())) for k in (0, 1)}
        importance = np.array([shares[k] / seen[k] for k in label[later]])
        importance /= max(importance.sum(), 1e-9) / max(1, len(importance))
        a, b = logistic.calibrate(rows.times(weights) + bias, label[later], importance)
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()],
                                          "a": [a], "b": [a * bias + b]})

    (model,) = (
        rows.mapInArrow(compact, "doc_id long, quality int, index binary, value binary")
        .repartition(1).mapInArrow(fitted, "weights binary, a double, b double").collect()
    )
    weights = np.frombuffer(model.weights, np.float32)
    return weights[:1 << WORD_BITS].copy(), weights[1 << WORD_BITS:].copy(), model.a, model.b


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float, float], *,
          threshold: float = THRESHOLD) -> DataFrame:
    """Counts, verdict and probability for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_weights, gram_weights, a, b = shared.value
        hashes = WordHashes()
        for batch in batches:
            found, quality = [], []
            for text in batch.column("text").to_pylist():
                data = encoded(text)
                own = hashes.of(data.split())
                found.append(counts(text or "", own))
                words, grams = features(data, own)
                raw = sum(float(w[k].mean(dtype=np.float64)) for w, k in
                          ((word_weights, words), (gram_weights, grams)) if len(k))
                quality.append(float(logistic.sigmoid(np.float64(a * raw + b))))
            n = np.array(found, np.int64).reshape(-1, 5)
            failed = (n[:, 0] < MIN_WORDS) | (100 * n[:, 4] > MAX_REPEATED * n[:, 0])
            kept = ~failed & (np.array(quality) >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(5)),
                 pa.array(failed), pa.array(kept), pa.array(quality, pa.float64())],
                names=[field.split()[0] for field in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judged, SCHEMA)
