"""Spelling variants: words one edit apart, found in FM-indexes of the vocabulary, and the forms they lead to.

1. Runs of letters are counted inside tasks, a document's equal runs once, then over all.
2. One error leaves one half of a word whole. A word is filed under the beginnings and endings that
   the halves of words of its length, one less and one more can be, and asks under its own two halves.
   Files are hashed to shards of about SHARD_CHARS code points; a half that more than HOT_WORDS words
   are filed under is cut into several, and its askers go to each.
3. Every shard has an FM-index of its words between delimiters, of the words as they are for
   endings and of the reversed words for beginnings: together an index that reads in both directions. A
   search narrows an interval of suffix ranks from the delimiter over the half that must match, then across the other
   half, once leaving the word for an inserted, replaced or left-out letter; behind the
   delimiter at the other end an interval's ranks are the words found. All words of a shard search at once.
4. A word's form is its most frequent neighbour, if twice as frequent (ties: least in code-point order); roots come from
   doubling the way along the forms, which grow in frequency and so have no cycles.

Results for odd input: null and letterless texts have no words; a null id counts as an empty one in the
CRC; texts of any length are walked through in pieces; repeated rows count again; no words, no rows.
Columns besides doc_id and text take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.texts import encoded
from cohortia.session import stored

LETTERS = 5  # least code points of a word
TIMES = 3  # least occurrences
RATIO = 2  # a form occurs so many times as often
DAMAGE = 97  # of so many runs in a document one has a letter left out; None: of none
SHARD_CHARS = 400_000
HOT_WORDS = 40_000
BLOCK = 8192  # words that search at once
PADDED = 4_000_000  # letters of a block, filled up to its longest word
FEW = 48  # ranks of an interval whose letters are read off one by one
_HELD = 400_000  # runs or words that a task counts at once

_RUN = re.compile("[a-zÀ-ÿ]+")


def damaged(doc_id: bytes, run: str, damage: int | None) -> str:
    if damage:
        h = zlib.crc32(doc_id + b":" + run.encode())
        if h % damage == 0:
            k = h % len(run)
            return run[:k] + run[k + 1:]
    return run


def occurrences(docs: DataFrame, *, letters: int = LETTERS, damage: int | None = DAMAGE) -> DataFrame:
    """word, n: words of the texts, with partial counts that add up."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flushed(runs: Counter[str], doc_id: bytes) -> None:
            for run, n in runs.items():
                if len(run) >= letters:
                    words[damaged(doc_id, run, damage)] += n

        def batch_of() -> pa.RecordBatch:
            kept = [(w, n) for w, n in words.items() if len(w) >= letters]
            words.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                key = encoded(doc_id)
                low = encoded(text.as_py()).lower().decode("utf-8", "surrogatepass")  # bytes: only A-Z change
                if len(low) <= 1_000_000:
                    flushed(Counter(_RUN.findall(low)), key)
                else:
                    runs: Counter[str] = Counter()
                    for found in _RUN.finditer(low):
                        runs[found.group()] += 1
                        if len(runs) >= _HELD:
                            flushed(runs, key)
                            runs.clear()
                    flushed(runs, key)
                if len(words) >= _HELD:
                    yield batch_of()
        yield batch_of()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")


class FmIndex:
    """Ranks of the suffixes of words between delimiters; patterns grow to the left."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer(("\n" + "".join(w + "\n" for w in words)).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(codes)  # the delimiter comes first
        text = np.append(np.searchsorted(self.alphabet, codes) + 1, 0)  # 0 ends the text
        self.size, self.letters = len(text), len(self.alphabet) + 1
        suffixes = self._sorted(text)
        self.bwt = text[suffixes - 1]
        order = np.argsort(self.bwt, kind="stable")
        self.keys = self.bwt[order] * self.size + order
        # A delimiter at text position p stands before word number p's count of delimiters before it.
        starts = np.cumsum(text == 1) - 1
        self.word_at = starts[suffixes]

    def _sorted(self, text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling, from as many letters at once as 62 bits hold."""
        bits = int(self.letters).bit_length()
        step = 62 // bits
        padded = np.append(text, np.zeros(step, np.int64))
        key = np.zeros(self.size, np.int64)
        for k in range(step):
            key = (key << bits) | padded[k:k + self.size]
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(self.size, np.int64)
            rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
            if rank[order[-1]] == self.size - 1:
                return order
            after = np.zeros(self.size, np.int64)
            if step < self.size:
                after[:-step] = rank[step:] + 1
            key, step = rank * (self.size + 1) + after, 2 * step

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters by word and place, 1 (the delimiter) behind the end; and the lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max(initial=0)) + 1
        codes = np.frombuffer("".join(w.ljust(width, "\n") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == codes, place + 1, self.letters), lengths

    def grown(self, letter: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, letter * self.size + low), np.searchsorted(self.keys, letter * self.size + high)

    def before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) for the letters before the suffixes of each interval."""
        few = np.flatnonzero(high - low <= FEW)
        n = (high - low)[few]
        at = np.repeat(low[few] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs = np.unique(np.repeat(few, n) * (self.letters + 1) + self.bwt[at])
        many = np.flatnonzero(high - low > FEW)
        grid = (many[:, None] * (self.letters + 1) + np.arange(2, self.letters)).ravel()
        owner, letter = np.divmod(np.concatenate([pairs[pairs % (self.letters + 1) > 1], grid]), self.letters + 1)
        return owner, letter

    def one_error(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asking word, number of the word found) with one error behind the first ``halves`` letters."""
        letters, lengths = self.coded(words)
        asks, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        who = np.arange(len(words))
        low, high = self.grown(1, np.zeros(len(words), np.int64), np.full(len(words), self.size))
        pool = np.zeros((4, 0), np.int64)  # asker, place, low, high of searches that had their error
        for j in range(letters.shape[1]):
            alive = (high > low) & (lengths[who] >= j)
            who, low, high = who[alive], low[alive], high[alive]
            if not len(who) and not pool.shape[1]:
                break
            pool = self._advanced(pool, letters, lengths, asks, found)
            free = np.flatnonzero(halves[who] <= j)
            if len(free):
                pool = np.concatenate([pool, self._strayed(who[free], j, low[free], high[free], letters, lengths)], axis=1)
            low, high = self.grown(letters[who, j], low, high)
            low[lengths[who] == j] = high[lengths[who] == j]  # no error and no letter left: the word itself
        while pool.shape[1]:
            pool = self._advanced(pool, letters, lengths, asks, found)
        return np.concatenate(asks), np.concatenate(found)

    def _strayed(self, who: np.ndarray, j: int, low: np.ndarray, high: np.ndarray, letters: np.ndarray,
                 lengths: np.ndarray) -> np.ndarray:
        """Searches that make their error at place j."""
        owner, letter = self.before(low, high)
        other = letter != letters[who[owner], j]
        owner, letter = owner[other], letter[other]
        a, b = self.grown(letter, low[owner], high[owner])
        own = who[owner]
        inserted = np.stack([own, np.full(len(own), j), a, b])
        rest = lengths[own] > j
        replaced = np.stack([own[rest], np.full(int(rest.sum()), j + 1), a[rest], b[rest]])
        # Of equal letters in a row the last is left out.
        out = np.flatnonzero(lengths[who] > j)
        out = out[letters[who[out], j] != letters[who[out], min(j + 1, letters.shape[1] - 1)]]
        left_out = np.stack([who[out], np.full(len(out), j + 1), low[out], high[out]])
        return np.concatenate([inserted, replaced, left_out], axis=1)

    def _advanced(self, pool: np.ndarray, letters: np.ndarray, lengths: np.ndarray, asks: list, found: list) -> np.ndarray:
        """The searches one letter on; those behind the last delimiter are found."""
        if not pool.shape[1]:
            return pool
        who, place, low, high = pool
        low, high = self.grown(letters[who, place], low, high)
        there = high > low
        ended = there & (place == lengths[who])
        n = (high - low)[ended]
        at = np.repeat(low[ended] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        asks.append(np.repeat(who[ended], n))
        found.append(self.word_at[at])
        on = there & ~ended
        return np.stack([who[on], place[on] + 1, low[on], high[on]])


_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _searched(table: pa.Table) -> pa.Table:
    """Pairs of a shard: rows (side, word, n, filed, half), half null for words that don't ask."""
    forward = table.column("side")[0].as_py() == 0
    filed = table.filter(table.column("filed"))
    names, first = np.unique(np.array(filed.column("word").to_pylist(), object), return_index=True)
    times = filed.column("n").to_numpy()[first]
    asking = table.filter(pc.is_valid(table.column("half")))
    words, halves = asking.column("word").to_pylist(), asking.column("half").to_numpy()
    if not len(names) or not words:
        return _PAIRS.empty_table()
    index = FmIndex([w[::-1] if forward else w for w in names.tolist()])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    out, begin = [], 0
    while begin < len(order):
        end = begin + BLOCK
        while end > begin + 1 and lengths[order[min(end, len(order)) - 1]] * (end - begin) > PADDED:
            end = begin + (end - begin) // 2
        own, begin = order[begin:end], end
        a, b = index.one_error([words[k] if forward else words[k][::-1] for k in own], halves[own])
        pairs = np.unique(a * len(names) + b)
        a, b = np.divmod(pairs, len(names))
        out.append(pa.table({"word": pa.array([words[k] for k in own[a]], pa.string()),
                             "near": pa.array(names[b].tolist(), pa.string()), "near_n": pa.array(times[b], pa.int64())}))
    return pa.concat_tables(out)


def neighbours(words: DataFrame, *, shard_chars: int = SHARD_CHARS, hot_words: int = HOT_WORDS) -> DataFrame:
    """word, near, near_n: all ordered pairs of words (word, n) that are one edit apart; a pair may stand twice."""
    chars = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    shards = max(1, -(-4 * chars // shard_chars))
    size = F.char_length("word")
    files = [F.struct(F.lit(side).alias("side"), p.cast("int").alias("p")) for side, p in (
        (0, F.floor((size - 1) / 2)), (0, F.floor((size + 1) / 2)), (1, F.ceil((size - 1) / 2)), (1, F.ceil((size + 1) / 2)))]
    own = F.when(F.col("side") == 0, F.floor(size / 2)).otherwise(F.ceil(size / 2)).cast("int")
    filed = words.select("word", "n", F.explode(F.array(*files)).alias("f")).select("word", "n", "f.*").select(
        "word", "n", "side", "p", F.when(F.col("side") == 0, F.expr("left(word, p)")).otherwise(F.expr("right(word, p)")).alias("key"),
        F.when(F.col("p") == own, F.col("p")).alias("half"))
    hot = filed.groupBy("side", "p", "key").agg(F.count("*").alias("k")).filter(F.col("k") > hot_words).select(
        "side", "p", "key", F.ceil(F.col("k") / hot_words).alias("cuts"))
    cut = filed.join(hot, ["side", "p", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    mine = F.pmod(F.xxhash64("word", F.lit("cut")), "cuts")
    # A word that asks under a cut half goes to all of its cuts, and is filed in one of them.
    places = F.when(F.col("half").isNull() | (F.col("cuts") == 1), F.array(mine)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    dealt = cut.withColumn("mine", mine).select("*", F.explode(places).alias("cut")).select(
        F.pmod(F.xxhash64("side", "p", "key", "cut"), F.lit(shards)).alias("shard"), "side", "word", "n",
        (F.col("cut") == F.col("mine")).alias("filed"), "half")
    return dealt.groupBy("side", "shard").applyInArrow(_searched, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): the end of the way along the forms."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(on, "root", "left_semi").isEmpty():
            return ways
        ways = stored(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "ways")


def variants(docs: DataFrame, *, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO, damage: int | None = DAMAGE,
             shard_chars: int = SHARD_CHARS, hot_words: int = HOT_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of docs (doc_id, text)."""
    words = stored(occurrences(docs, letters=letters, damage=damage).groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= times), "words")
    near = neighbours(words, shard_chars=shard_chars, hot_words=hot_words).repartition("word").groupBy("word", "near").agg(
        F.max("near_n").alias("near_n")).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("top"))
    form_n = -F.col("top.less")
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form_n >= ratio * F.col("n"), F.col("top.form")).alias("form"),
        F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n")), "forms")
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
