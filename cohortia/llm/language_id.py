"""Language by n-gram filters: one Bloom filter whose every position holds a bit for each language.

Learning counts, per language, in how many sampled documents an n-gram occurs
and enters those that a fixed share of the documents has. A look-up is the AND
of a few positions and gives the set of all languages that hold the n-gram.
For a text the bits are counted per language, the expected false positives
(n-grams times the filled share of the language's slice, to the power of the
hash functions) are taken off, and the language with most n-grams left wins.

Results for odd input: null, empty and letterless texts get ``und`` and score 0;
texts with letters always get a learned language (the one with most documents if
no n-gram is known, score 0), or ``und`` if nothing could be learned. Ties go to
the language with more learned documents, then to the smaller name. Repeated
rows get equal results; a null id is scored and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.texts import mixed, sampled, slices

UNKNOWN = "und"
ORDERS = (3, 4)  # letters in an n-gram; the outer two may be a word's border
SAMPLE_DOCS = 4000  # documents that a language is learned from, about
DOC_SHARE = 0.02  # an n-gram belongs to a language if this share of its documents has it
POSITIONS = 1 << 20  # of the filter: 8 MB for up to 64 languages
HASHES = 3
LEAST_SCORE = 0.1  # share of a kept text's n-grams that its language holds

_SCHEMA = "doc_id long, lang_pred string, score double"


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter; worked out once in a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of letters (lower case), and the text that each is from."""
    low = [(t or "").lower() + "\n" for t in texts]
    codes = np.frombuffer(("\n" + "".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(-1, len(low)), [1, *map(len, low)])
    letter = _letters()[codes]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]  # one border after each run of letters
    letter, owner = letter[kept], owner[kept]
    codes = np.where(letter, codes[kept], np.uint32(32)).astype(np.uint64)
    hashes, owners = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        inner = np.logical_and.reduce([letter[k:k + m] for k in range(1, n - 1)])
        key = np.full(m, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + m]
        hashes.append(mixed(key[inner]))
        owners.append(owner[1:1 + m][inner])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def places(hashes: np.ndarray, positions: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield (hashes + np.uint64(k) * step) & np.uint64(positions - 1)


@dataclass
class LanguageFilter:
    languages: list[str]  # most documents first
    words: np.ndarray  # (64 languages each, positions): bits of the languages
    false_rate: np.ndarray

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and of them those that each language holds, corrected."""
        hashes, owner = ngrams(texts)
        total = np.bincount(owner, minlength=len(texts))
        held = np.zeros((len(texts), len(self.languages)))
        spots = list(places(hashes, self.words.shape[1]))
        for w, row in enumerate(self.words):
            mask = np.bitwise_and.reduce([row[s] for s in spots])
            for bit in range(min(64, len(self.languages) - 64 * w)):
                has = (mask >> mask.dtype.type(bit)) & mask.dtype.type(1) != 0
                held[:, 64 * w + bit] = np.bincount(owner[has], minlength=len(texts))
        return total, np.maximum(0, (held - total[:, None] * self.false_rate) / (1 - self.false_rate))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, held = self.counts(texts)
        names, scores = [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            if not self.languages or not text or not (total[k] or any(map(str.isalpha, text))):
                names.append(UNKNOWN)
                continue
            best = int(np.argmax(held[k]))
            names.append(self.languages[best])
            scores[k] = min(1.0, held[k, best] / total[k]) if total[k] else 0.0
        return names, scores


def learn(labelled: DataFrame, *, sample_docs: int = SAMPLE_DOCS, doc_share: float = DOC_SHARE,
          positions: int = POSITIONS) -> LanguageFilter:
    """Filter learned from rows (doc_id, text, lang), on about ``sample_docs`` rows of each language.

    At most 1 / doc_share times the n-grams of a mean document are kept for a
    language, so what reaches the driver doesn't grow with the table.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    drawn, counts = sampled(known.select("doc_id", "lang", "text"), "lang", sample_docs)
    languages = sorted(counts, key=lambda name: (-counts[name], name))
    if not languages:
        return LanguageFilter([], np.zeros((1, positions), np.uint8), np.zeros(0))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for begin, end in slices(texts):
                hashes, owner = ngrams(texts[begin:end])
                owner, hashes = _once(owner, hashes)
                for name in sorted(set(langs[begin:end])):
                    mine = np.array([x == name for x in langs[begin:end]])
                    grams, n = np.unique(hashes[mine[owner]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([name] * len(grams), pa.string()),
                        "gram": pa.array(grams.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    sizes = drawn.groupBy("lang").count().withColumnRenamed("count", "docs")
    grams = (
        drawn.select("lang", "text").mapInArrow(found, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .join(F.broadcast(sizes), "lang")  # one row per language
        .filter(F.col("n") >= F.greatest(F.lit(1.0), F.col("docs") * doc_share))
        .select("lang", "gram").toArrow()
    )
    rank = {name: k for k, name in enumerate(languages)}
    rows = -(-len(languages) // 64)
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
    words = np.zeros((rows, positions), kind)
    of = np.array([rank[x] for x in grams.column("lang").to_pylist()], np.int64)
    hashes = grams.column("gram").to_numpy().view(np.uint64)
    false_rate = np.zeros(len(languages))
    for k in range(len(languages)):
        bit = kind(1 << (k % 64))
        for spot in places(hashes[of == k], positions):
            words[k // 64, spot] |= bit
        false_rate[k] = np.mean((words[k // 64] & bit) != 0) ** HASHES
    return LanguageFilter(languages, words, false_rate)


def _once(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of a text once."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[first], hashes[first]


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    # Of fixed size; plain values, as broadcasts are not pickled with the code.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.false_rate))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageFilter(*shared.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for begin, end in slices(texts):
                names, scores = model.predict(texts[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [ids[begin:end], pa.array(names, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, _SCHEMA)


def keep_known(docs: DataFrame, model: LanguageFilter, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs in a learned language: not ``und``, and with a score of ``least_score`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.false_rate))

    @F.arrow_udf("boolean")  # only texts go to Python, only verdicts come back
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LanguageFilter(*shared.value)
        for column in batches:
            texts, good = column.to_pylist(), []
            for begin, end in slices(texts):
                names, scores = model.predict(texts[begin:end])
                good += ((scores >= least_score) & np.array([name != UNKNOWN for name in names], bool)).tolist()
            yield pa.array(good, pa.bool_())
        pa.default_memory_pool().release_unused()

    return docs.filter(kept("text"))
