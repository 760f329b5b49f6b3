"""Best-fit packing of token sequences, in a tree of partitions.

Every document becomes its ids and an end id; one that is longer than a sequence is
cut into full pieces, its first piece takes the rest. The pieces are packed
best-fit (longest first) inside groups of bounded size. Nearly full bins are done;
of the others the emptiest go up the tree, where a group gathers the open bins of
several groups and packs them again as items. A group passes on a bounded number, so
no task's input grows with the table; at the root all bins are done. Bins keep their
members with their places, so the ids are made once and never moved.

Results for odd input: null and empty texts are one piece of one token (the end id);
repeated rows are packed as often as they occur; a null id stays null; an empty table
has no pieces. Texts that hold the string of a special token get that token's id.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.texts import frugal
from cohortia.session import stored

LENGTH = 2048
END = 0
GROUP_ITEMS = 50_000  # items of a group
FAN = 8  # groups whose open bins meet in one
NEARLY_FULL = 8  # free tokens of a bin that is done

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BINS = ("sequence_id long, fill long, done boolean, "
         "members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>")


class Tokens:
    """Ids of texts. The rank file has the vocabulary of the other file and is read by a faster
    library; texts with the string of a special token, and those it fails on, take the other."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(vocabulary)
        self._special = [token.content for token in self._full.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if self._fast and not any(token in text for token in self._special):
            try:
                return np.array(self._fast.encode_ordinary(text), np.uint32)
            except BaseException as error:  # a run-away pattern ends in the library's own panic type
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self._full.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, *, vocabulary: str, ranks: str | None = None, pattern: str | None = None,
           length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of every row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary, ranks, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(tokens.of(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % length or length
                edges = [0, *range(first, len(ids) + 1, length)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                         for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind.type) for column, kind in zip(columns, list(_MEMBER)[:5])],
                names=[kind.name for kind in list(_MEMBER)[:5]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(cut), PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with r free tokens is open
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        left = room - size
        if left:
            open_by_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins


def _packed(level: int, last: bool, length: int, carried: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        (group,) = (k.as_py() for k in key)
        table = table.combine_chunks().sort_by([("fill", "descending"), ("tie", "ascending")])
        fill = table.column("fill").to_numpy()
        bins = best_fit(fill, length)
        lists = table.column("members").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        begins = lists.offsets.to_numpy()
        flat = lists.values
        order, shift, ends, fills = [], [], [0], []
        for held in bins:
            at = 0
            for item in held:
                order.append(np.arange(begins[item], begins[item + 1]))
                shift.append(np.full(len(order[-1]), at))
                at += int(fill[item])
            ends.append(ends[-1] + sum(int(begins[i + 1] - begins[i]) for i in held))
            fills.append(at)
        taken = flat.take(pa.array(np.concatenate(order) if order else np.zeros(0, np.int64)))
        columns = [taken.field(k) for k in range(5)]
        columns.append(pa.array(taken.field(5).to_numpy(zero_copy_only=False) + np.concatenate(shift)))
        members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                           pa.StructArray.from_arrays(columns, fields=list(_MEMBER)))
        fills = np.array(fills, np.int64)
        done = np.ones(len(fills), bool)
        if not last:
            emptiest = np.argsort(fills, kind="stable")[:carried]
            done[emptiest] = length - fills[emptiest] <= NEARLY_FULL
        ids = (level << 58) + (group << 20) + np.arange(len(fills), dtype=np.int64)
        return pa.table({"sequence_id": ids, "fill": fills, "done": done, "members": members})

    return pack


def pack(cut: DataFrame, *, length: int = LENGTH, group_items: int = GROUP_ITEMS) -> DataFrame:
    """A sequence and a place in it for every piece; ``cut`` as returned by ``pieces``."""
    cut = stored(cut, "pieces")  # the texts are read and turned into ids once
    full = cut.filter(F.col("length") == length).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    single = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")))
    items = cut.filter(F.col("length") < length).select(
        F.col("length").alias("fill"), F.hash("doc_id", "piece", "ids_crc32").cast("long").alias("tie"),
        F.monotonically_increasing_id().alias("row"), single.alias("members"))
    groups = max(1, -(-items.count() // group_items))
    grouped = items.withColumn("grp", F.pmod(F.xxhash64("row", "tie"), F.lit(groups)))
    finished, level = [], 0
    while True:
        last = groups == 1
        bins = stored(
            grouped.select("grp", "fill", "tie", "members").groupBy("grp").applyInArrow(
                _packed(level, last, length, group_items // FAN), _BINS), f"bins-{level}")
        finished.append(bins if last else bins.filter("done"))
        if last:
            break
        level, groups = level + 1, -(-groups // FAN)
        grouped = bins.filter("NOT done").select(
            F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("grp"), "fill",
            F.col("sequence_id").alias("tie"), "members")
    out = full.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    for bins in finished:
        out = out.unionByName(bins.select("sequence_id", F.inline("members")))
    return out
