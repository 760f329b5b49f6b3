"""Words, hashes and slices of texts inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 250_000  # characters that a task turns into arrays at once


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; bytes.split() cuts at just these six bytes."""
    return encoded(text).split()


class WordHashes(dict):
    """Hash by word; forgets its words when it holds too many."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.hashed(word)
        return value

    def hashed(self, word: bytes) -> int:  # 63 bits
        return xxhash.xxh3_64_intdigest(word) >> 1

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; uint64 arithmetic wraps."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each; a longer text stands alone."""
    begin = held = 0
    for at, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > most:
            yield begin, at
            begin, held = at, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function; at its end unused memory goes back to the system, as a worker serves stage after stage."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of them."""
    taken, out = {name.lower() for name in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % by


def sampled(labelled: DataFrame, label: str, most: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """About ``most`` rows of each label at most, chosen by a hash of the id, and the rows of each label.

    The share is drawn from exact counts, so it is the whole label where that
    is small. Labels are few (languages, classes): one row each comes to the driver.
    """
    counts = {row[0]: row[1] for row in labelled.groupBy(label).count().collect() if row[0] is not None}
    if not counts:
        return labelled.filter(F.lit(False)), {}
    grain = 1 << 30
    shares = [x for name, n in counts.items() for x in (F.lit(name), F.lit(min(grain, grain * most // n)))]
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(grain))
    return labelled.filter(drawn < F.create_map(*shares)[F.col(label)]), counts
