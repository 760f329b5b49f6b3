"""Near-duplicate documents: an exact Jaccard join of word n-gram sets on prefix trees.

1. Equal sets are one class (their 64-bit key is a mix of all members).
2. A class can only have a partner at threshold t if all but (1 - t) of its n-grams
   occur in another class. Half of the n-gram space (by hash) is counted exactly, in
   packed blocks; classes that miss the bound for this half are single.
3. For the others all n-grams are counted and put into one global order, rare first.
   Two partners share an n-gram among their first n - ceil(t n) + 1; classes that share
   such an n-gram, directly or over others, form a cluster. Most documents are in none.
4. A cluster's sets, ordered common first, are stored in a prefix tree. A set walks the
   tree, adding up its overlap once for all sets that share a path, and leaves a subtree
   when the rest of either set can't reach the threshold. Walks only have to join
   components, so they end when a cluster hangs together: no pairs are listed.
5. Clusters beyond ``most`` classes or GRAMS n-grams first hang what is similar to a leader below it, a few
   times; what is left is compared in pairs of blocks, without the pairs inside a component.

Results for odd input: null, empty and blank texts have no n-grams, link with nothing and are
their own component; texts with fewer words than an n-gram have one; repeated rows are
equal sets. A null id takes no part, its component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.llm.graph import components
from cohortia.llm.texts import WordHashes, encoded, frugal, mixed, unused
from cohortia.session import stored

WORDS = 5
PERCENT = 80
MOST = 4000  # classes of a cluster that one task takes
BLOCK_TOKENS = 1_000_000  # n-grams that one task counts at once
CLASSES = 2000  # classes that one task orders, or joins, at once
GRAMS = 2_000_000  # their n-grams, about
LEADER_ROUNDS = 3
BITS = 1 << 26  # of the map of open documents: 8 MB


class _FewHashes(WordHashes):
    most = 150_000  # the sets of a batch take memory besides


def ngram_set(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams; A-Z count as a-z."""
    own = hashes.of(encoded(text).lower().split())
    if not len(own):
        return own
    m, width = (len(own) - words + 1, words) if len(own) >= words else (1, len(own))
    key = np.full(m, width, np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + own[k:k + m]
    return np.unique(mixed(key))


def class_key(grams: np.ndarray) -> int:
    if not len(grams):
        return 0
    folded = mixed(grams * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mixed(np.array([folded], np.uint64)).view(np.int64)[0])


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _sets(docs: DataFrame, words: int, *kept: str) -> DataFrame:
    """doc_id, n, cls; half: the upper 32 bits of n-grams with an even hash, once for a class in a task;
    and the long columns ``kept``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _FewHashes(), set()
        for batch in batches:
            n, keys, halves = [], [], []
            for text in batch.column("text").to_pylist():
                grams = ngram_set(text, hashes, words)
                key = class_key(grams)
                n.append(len(grams))
                keys.append(key)
                fresh = key not in seen and len(grams) >= 4  # smaller sets have no partner but equal ones
                halves.append(((grams[grams & np.uint64(1) == 0] >> np.uint64(32)).astype(np.uint32)).tobytes()
                              if fresh else None)
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(halves, pa.binary()),
                 *map(batch.column, kept)], names=["doc_id", "n", "cls", "half", *kept])

    return docs.select(F.col("doc_id").cast("long"), "text", *kept).mapInArrow(
        frugal(found), "doc_id long, n long, cls long, half binary" + "".join(f", {name} long" for name in kept))


def _blocks(rows: DataFrame, column: str, kind: type, ranges: int) -> DataFrame:
    """Packed n-grams by range of their value: rng, and packed lists of classes, of their numbers of
    n-grams here and in all, and of the n-grams."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 8 * np.dtype(kind).itemsize
        edges = np.array([(k << width) // ranges for k in range(1, ranges)], dtype=object).astype(kind)
        for batch in batches:
            sets = [np.sort(np.frombuffer(x, kind)) for x in batch.column(column).to_pylist()]
            cls, sizes = batch.column("cls").to_numpy(), batch.column("n").to_numpy().astype(np.int32)
            for begin in range(0, len(sets), 4096):
                part = sets[begin:begin + 4096]
                cuts = np.array([[0, *np.searchsorted(x, edges), len(x)] for x in part])
                out = {"rng": [], "cls": [], "n": [], "size": [], "grams": []}
                for k in range(ranges):
                    n = (cuts[:, k + 1] - cuts[:, k]).astype(np.int32)
                    held = np.flatnonzero(n)
                    if len(held):
                        out["rng"].append(k)
                        out["cls"].append(cls[begin:begin + 4096][held].tobytes())
                        out["n"].append(n[held].tobytes())
                        out["size"].append(sizes[begin:begin + 4096][held].tobytes())
                        out["grams"].append(np.concatenate([part[i][cuts[i, k]:cuts[i, k + 1]] for i in held]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["rng"], pa.int32()), *(pa.array(out[x], pa.binary()) for x in ("cls", "n", "size", "grams"))],
                    names=list(out))

    return rows.select("cls", "n", column).mapInArrow(frugal(dealt), "rng int, cls binary, n binary, size binary, grams binary")


def _unblocked(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """classes, their sizes, the class (index) of each n-gram, n-grams; each class once."""
    def joined(name: str, of: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), of)

    cls, n, grams = joined("cls", np.int64), joined("n", np.int32), joined("grams", kind)
    kept, first = np.unique(cls, return_index=True)
    chosen = np.zeros(len(cls), bool)
    chosen[first] = True
    index = np.searchsorted(kept, cls)
    sizes = joined("size", np.int32)[first]
    return kept, sizes, np.repeat(index[chosen], n[chosen]), grams[np.repeat(chosen, n)]


def _frequencies(grams: np.ndarray) -> np.ndarray:
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(grams) else np.zeros(0, np.int64)
    run = np.diff(np.append(edge, len(grams)))
    out = np.empty(len(grams), np.int64)
    out[order] = np.repeat(run, run)
    return out


def _parted(cls: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the classes of each part; a part's classes meet in one task, in packed rows."""
    part = mixed(cls.view(np.uint64)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), at


def _shared(parts: int):
    def shared(table: pa.Table) -> pa.Table:
        """How many of a class's n-grams in this range another class holds too."""
        cls, _, owner, grams = _unblocked(table, np.uint32)
        n = np.bincount(owner[_frequencies(grams) > 1], minlength=len(cls)).astype(np.int32)
        cls, n = cls[n > 0], n[n > 0]
        rows = [{"part": k, "cls": cls[at].tobytes(), "n": n[at].tobytes()} for k, at in _parted(cls, parts)]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("cls", pa.binary()), ("n", pa.binary())]))

    return shared


def _summed(table: pa.Table) -> pa.Table:
    cls = np.frombuffer(b"".join(table.column("cls").to_pylist()), np.int64)
    kept, index = np.unique(cls, return_inverse=True)
    n = np.bincount(index, np.frombuffer(b"".join(table.column("n").to_pylist()), np.int32), len(kept))
    return pa.table({"cls": kept, "shared": n.astype(np.int64)})


def _counted(parts: int):
    def counted(table: pa.Table) -> pa.Table:
        """The n-grams in this range that several classes hold, with their numbers of classes."""
        cls, sizes, owner, grams = _unblocked(table, np.uint64)
        times = _frequencies(grams)
        held = np.flatnonzero(times > 1)
        part = mixed(cls.view(np.uint64)) % np.uint64(parts)
        held = held[np.argsort(part[owner[held]], kind="stable")]
        rows = []
        for at in np.split(held, np.flatnonzero(np.diff(part[owner[held]])) + 1):
            if len(at):
                rows.append({"part": int(part[owner[at[0]]]), "cls": cls[owner[at]].tobytes(),
                             "size": sizes[owner[at]].tobytes(), "grams": grams[at].tobytes(),
                             "times": times[at].astype(np.int32).tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([
            ("part", pa.int64()), *((x, pa.binary()) for x in ("cls", "size", "grams", "times"))]))

    return counted


def _prefixes(table: pa.Table) -> pa.Table:
    """The n-grams of each class's prefix that others hold: those held by none come before them in the order."""
    def joined(name: str, of: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), of)

    cls, size, grams, times = joined("cls", np.int64), joined("size", np.int32), joined("grams", np.uint64), joined("times", np.int32)
    order = np.lexsort((grams, times, cls))
    cls, size, grams = cls[order], size[order].astype(np.int64), grams[order]
    begin = np.flatnonzero(np.diff(cls, prepend=cls[:1] - 1))
    held = np.diff(np.append(begin, len(cls)))
    place = np.arange(len(cls)) - np.repeat(begin, held)
    size = size[begin]
    left = size - -(-PERCENT * size // 100) + 1 - (size - held)
    chosen = place < np.repeat(left, held)
    return pa.table({"cls": cls[chosen], "gram": grams[chosen].view(np.int64)})


class Tree:
    """Sets in a prefix tree whose paths are shared as far as they agree; common n-grams first."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        kinds, inverse = np.unique(flat, return_inverse=True)
        times = np.bincount(inverse, minlength=len(kinds))
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((np.arange(len(kinds)), -times))] = np.arange(len(kinds))
        ends = np.cumsum([len(s) for s in sets])
        self.kinds = len(kinds)
        self.sets = [np.sort(x) for x in np.split(rank[inverse], ends[:-1])]
        self.size = np.array([len(s) for s in self.sets])
        order = sorted(range(len(sets)), key=lambda k: self.sets[k].astype(">u8").tobytes())
        # Nodes: an edge of n-grams (of one set, from depth to depth), the sets that end there.
        edge, parent, level, least, most, at_end = [(0, 0, 0)], [-1], [0], [0], [0], [[]]
        path = [0]
        for k in order:
            own = self.sets[k]
            common = 0
            if k != order[0]:
                m = min(len(own), len(last))  # noqa: F821
                differ = np.flatnonzero(own[:m] != last[:m])  # noqa: F821
                common = int(differ[0]) if len(differ) else m
            while edge[path[-1]][2] > common and edge[path[-1]][1] >= common:
                path.pop()
            top = path[-1]
            if edge[top][2] > common:  # the edge is cut: its upper part becomes a node of its own
                owner, begin, end = edge[top]
                edge.append((owner, begin, common))
                parent.append(parent[top])
                level.append(0)
                least.append(0)
                most.append(0)
                at_end.append([])
                edge[top] = (owner, common, end)
                parent[top] = len(edge) - 1
                path[-1] = len(edge) - 1
            if len(own) > common:
                edge.append((k, common, len(own)))
                parent.append(path[-1])
                level.append(0)
                least.append(0)
                most.append(0)
                at_end.append([k])
                path.append(len(edge) - 1)
            else:
                at_end[path[-1]].append(k)
            last = own
        self.parent = np.array(parent)
        count = len(edge)
        children: list[list[int]] = [[] for _ in range(count)]
        for node in range(1, count):
            children[parent[node]].append(node)
        self.levels, front = [], [0]
        while front:
            front = [c for node in front for c in children[node]]
            if front:
                self.levels.append(np.array(front))
        low, high = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)
        for node, held in enumerate(at_end):
            for k in held:
                low[node], high[node] = min(low[node], len(self.sets[k])), max(high[node], len(self.sets[k]))
        for nodes in reversed(self.levels):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        self.low, self.high, self.at_end = low, high, at_end
        self.depth = np.array([e[2] for e in edge])
        self.begin = np.zeros(count, np.int64)
        grams, at = [], 0
        for node, (owner, a, b) in enumerate(edge):
            self.begin[node] = at
            grams.append(self.sets[owner][a:b])
            at += b - a
        self.grams = np.concatenate(grams)
        self.width = np.array([b - a for _, a, b in edge])
        self.last = np.array([self.sets[o][b - 1] if b > a else -1 for o, a, b in edge])

    def similar(self, k: int) -> list[int]:
        """Sets whose Jaccard similarity with set k reaches the threshold, itself included."""
        own, n = self.sets[k], len(self.sets[k])
        holds = np.zeros(self.kinds, np.int64)
        holds[own] = 1
        overlap = np.full(len(self.parent), -1)
        overlap[0] = 0
        found: list[int] = []
        for nodes in self.levels:
            nodes = nodes[overlap[self.parent[nodes]] >= 0]
            if not len(nodes):
                break
            width = self.width[nodes]
            starts = np.cumsum(width) - width
            at = np.arange(int(width.sum())) - np.repeat(starts, width) + np.repeat(self.begin[nodes], width)
            gained = np.add.reduceat(holds[self.grams[at]], starts)
            total = overlap[self.parent[nodes]] + gained
            rest = n - np.searchsorted(own, self.last[nodes], side="right")
            reach = total + np.minimum(rest, self.high[nodes] - self.depth[nodes])
            # overlap o of sets of n and m: 100 o >= PERCENT (n + m - o)
            alive = (100 + PERCENT) * reach >= PERCENT * (n + self.low[nodes])
            overlap[nodes[alive]] = total[alive]
            for node, o in zip(nodes[alive].tolist(), total[alive].tolist()):
                found += [j for j in self.at_end[node] if (100 + PERCENT) * o >= PERCENT * (n + len(self.sets[j]))]
        return found


def linked(sets: list[np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
    """Component (a number) of each set; ``labels`` names components that are known."""
    labels = np.arange(len(sets)) if labels is None else labels.copy()
    if len(sets) < 2 or len(set(labels.tolist())) == 1:
        return labels
    tree = Tree(sets)
    left = len(set(labels.tolist()))
    for k in range(len(sets)):
        for j in tree.similar(k):
            if labels[j] != labels[k]:
                labels[labels == labels[j]] = labels[k]
                left -= 1
        if left == 1:
            break
    return labels


def _joined(table: pa.Table) -> pa.Table:
    """cls and root of the classes of whole clusters (or of a pair of blocks), a tree for each."""
    table = table.sort_by([("cluster", "ascending"), ("cls", "ascending")])
    cluster, cls = table.column("cluster").to_numpy(), table.column("cls").to_numpy()
    known = table.column("known").to_numpy() if "known" in table.column_names else None
    sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
    edges = np.append(np.flatnonzero(np.diff(cluster, prepend=cluster[:1] - 1)), len(cluster))
    roots = np.empty(len(cls), np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        labels = linked(sets[a:b], None if known is None else np.unique(known[a:b], return_inverse=True)[1])
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        roots[a:b] = cls[a:b][first][inverse]  # sorted, so the first is the least
    return pa.table({"cls": cls, "root": roots})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for mine, other in zip(batch.column("grams").to_pylist(), batch.column("leader_grams").to_pylist()):
            a, b = np.frombuffer(mine, np.uint64), np.frombuffer(other, np.uint64)
            o = len(np.intersect1d(a, b, assume_unique=True))
            kept.append(100 * o >= PERCENT * (len(a) + len(b) - o))
        yield batch.select(["cls", "leader"]).filter(pa.array(kept, pa.bool_()))


def _large(members: DataFrame, most: int) -> DataFrame:
    """(cls, root) links that hold the large clusters' components together; members (cls, cluster, grams)."""
    spark = members.sparkSession
    links = spark.createDataFrame([], "cls long, root long")
    left = members.select("cls", "cluster")
    for step in range(LEADER_ROUNDS):
        leaders = left.groupBy("cluster").agg(F.min("cls").alias("leader"))
        leaders = leaders.join(members.select(F.col("cls").alias("leader"), F.col("grams").alias("leader_grams")), "leader")
        hung = stored(
            left.join(members.select("cls", "grams"), "cls").join(leaders, "cluster")
            .select("cls", "leader", "grams", "leader_grams").mapInArrow(frugal(_verified), "cls long, leader long"), f"leaders-{step}")
        links = links.unionByName(hung.select("cls", F.col("leader").alias("root")))
        left = stored(left.join(hung.select("cls"), "cls", "left_anti"), f"left-{step}")
    known = stored(members.select("cls", "cluster").join(links, "cls", "left").select(
        "cls", "cluster", F.coalesce("root", "cls").alias("known")), "known")
    # Blocks: of one component where it is large, of several small components otherwise.
    half = max(1, most // 2)
    sizes = known.groupBy("cluster", "known").agg(F.count("*").alias("m"))
    pools = sizes.filter(F.col("m") < half).groupBy("cluster").agg(F.ceil(F.sum("m") / half).alias("pools"))
    parts = sizes.join(pools, "cluster", "left").select(
        "cluster", "known", F.ceil(F.col("m") / half).alias("cuts"), "pools", (F.col("m") >= half).alias("pure"))
    blocked = stored(known.join(parts, ["cluster", "known"]).select(
        "cls", "cluster", "known", F.when(F.col("pure"), F.col("known")).alias("only"),
        F.when(F.col("pure"), F.xxhash64("known", F.pmod(F.xxhash64("cls"), "cuts"))).otherwise(
            F.xxhash64(F.lit("pool"), F.pmod(F.xxhash64("known"), "pools"))).alias("block")), "blocked")
    blocks = blocked.select("cluster", "block", "only").distinct()
    other = blocks.select("cluster", F.col("block").alias("block_b"), F.col("only").alias("only_b"))
    pairs = blocks.join(other, "cluster").filter(
        (F.col("block") <= F.col("block_b")) & ~F.coalesce(F.col("only") == F.col("only_b"), F.lit(False)))
    cells = pairs.select("cluster", "block", F.xxhash64("cluster", "block", "block_b").alias("cell")).unionByName(
        pairs.filter("block <> block_b").select("cluster", F.col("block_b").alias("block"),
                                                F.xxhash64("cluster", "block", "block_b").alias("cell")))
    found = (
        blocked.join(cells, ["cluster", "block"]).join(members.select("cls", "grams"), "cls")
        .select(F.col("cell").alias("cluster"), "cls", "known", "grams")
        .groupBy("cluster").applyInArrow(_joined, "cls long, root long")
    )
    return links.unionByName(found)


def _open_sets(docs: DataFrame, open_classes: DataFrame, words: int) -> DataFrame:
    """cls, n and the packed n-grams of the classes (cls, first_doc), from their first documents' texts.

    A bit map of fixed size, filled by Spark, tells which texts can be meant, so that only their
    sets are shuffled; what it lets through besides, the join drops.
    """
    spark = docs.sparkSession
    spot = F.pmod(F.xxhash64(F.col("first_doc"), F.lit("open")), F.lit(BITS))
    filled = (
        open_classes.select(spot.alias("spot")).selectExpr("spot div 64 AS at", "shiftleft(1L, cast(spot % 64 AS int)) AS bit")
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    bits = np.zeros(BITS // 64, np.int64)
    bits[filled.column("at").to_numpy()] = filled.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _FewHashes()
        for batch in batches:
            at = batch.column("spot").to_numpy()
            meant = (shared.value[at >> 6] >> (at & 63)) & 1 == 1
            batch = batch.filter(pa.array(meant))
            found = [ngram_set(text, hashes, words) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("first_doc"), pa.array([class_key(x) for x in found], pa.int64()),
                 pa.array([len(x) for x in found], pa.int64()), _packed(found)], names=["first_doc", "cls", "n", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("first_doc"), "text").withColumn("spot", spot)
    sets = texts.mapInArrow(frugal(whole), "first_doc long, cls long, n long, grams binary")
    # An id that stands for several texts meets its class only with the right one.
    return sets.join(open_classes, ["first_doc", "cls"]).dropDuplicates(["first_doc", "cls"]).select("cls", "n", "grams")


def classes_of(docs: DataFrame, *kept: str, words: int = WORDS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) and ``kept`` of all rows with an id, and (cls, root) of the classes that have partners."""
    docs = docs.filter("doc_id IS NOT NULL")
    sets = stored(_sets(docs, words, *kept), "sets")
    classes = stored(sets.groupBy("cls").agg(
        F.min("doc_id").alias("first_doc"), F.max("n").alias("n"), F.max(F.octet_length("half") / 4).cast("long").alias("m")),
        "classes")
    half = sets.filter("half IS NOT NULL").select("cls", "n", "half")
    facts = classes.agg(F.count("*"), F.sum("m")).collect()[0]
    parts = max(1, -(-facts[0] // (10 * CLASSES)))
    ranges = max(1, -(-(facts[1] or 0) // BLOCK_TOKENS))
    shared = (
        _blocks(half, "half", np.uint32, ranges).groupBy("rng")
        .applyInArrow(_shared(parts), "part long, cls binary, n binary")
        .groupBy("part").applyInArrow(_summed, "cls long, shared long")
    )
    open_classes = stored(
        classes.filter("n >= 4").join(shared, "cls", "left")
        .filter(F.coalesce("shared", F.lit(0)) >= F.col("m") - F.floor(F.col("n") * (100 - PERCENT) / 100))
        .select("cls", "first_doc"), "open-classes")
    members = stored(_open_sets(docs, open_classes, words), "members")
    facts = members.agg(F.count("*"), F.sum("n")).collect()[0]
    ranges = max(1, -(-(facts[1] or 0) // BLOCK_TOKENS))
    groups = max(1, -(-facts[0] // CLASSES), -(-(facts[1] or 0) // GRAMS))
    postings = stored(
        _blocks(members, "grams", np.uint64, ranges).groupBy("rng")
        .applyInArrow(_counted(groups), "part long, cls binary, size binary, grams binary, times binary")
        .groupBy("part").applyInArrow(_prefixes, "cls long, gram long"), "postings")
    leaders = postings.groupBy("gram").agg(F.min("cls").alias("leader"), F.count("*").alias("k")).filter("k > 1")
    edges = postings.join(leaders, "gram").filter("cls <> leader").select(
        F.col("cls").alias("a"), F.col("leader").alias("b")).distinct()
    clusters = components(edges).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    clusters = stored(clusters.join(members.select("cls", "n"), "cls"), "clusters")
    sizes = clusters.groupBy("cluster").agg(((F.count("*") <= most) & (F.sum("n") <= GRAMS)).alias("small"))
    members = stored(members.select("cls", "grams").join(clusters.join(sizes, "cluster"), "cls"), "clustered")
    small = members.filter("small")
    roots = stored(
        small.withColumn("part", F.pmod(F.xxhash64("cluster"), F.lit(groups))).select("part", "cluster", "cls", "grams")
        .groupBy("part").applyInArrow(_joined, "cls long, root long"), "roots")
    large = stored(members.filter("NOT small").select("cls", "cluster", "grams"), "large")
    if not large.isEmpty():
        links = _large(large, most).select(F.col("cls").alias("a"), F.col("root").alias("b"))
        roots = roots.unionByName(components(links).select(F.col("node").alias("cls"), "root"))
    return sets.select("doc_id", "n", "cls", *kept), roots


def near_duplicates(docs: DataFrame, *, words: int = WORDS, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    sets, roots = classes_of(docs, words=words, most=most)
    named = sets.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_doc")).join(
        roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = named.join(firsts, "root").select("cls", "component_id")
    out = sets.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = _sets(docs.filter("doc_id IS NULL"), words).select(
        "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


def one_of_each(docs: DataFrame, *, words: int = WORDS, most: int = MOST) -> DataFrame:
    """The rows of docs without those of a near-duplicate group but its least id, and of that its least
    text hash; of rows that repeat an id with an equal text one stays, rows with a null id stay."""
    th, = unused(docs, "th")
    keyed = docs.withColumn(th, F.xxhash64("text"))
    sets, roots = classes_of(keyed.select("doc_id", "text", F.col(th).alias("th")), "th", words=words, most=most)
    named = sets.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("first")).join(
        roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = named.groupBy("root").agg(F.min("first").alias("stays"))
    named = named.join(firsts, "root").select("cls", "stays")
    gone = sets.join(named, "cls").filter(F.struct("doc_id", "th") != F.col("stays")).select(
        "doc_id", F.col("th").alias(th)).distinct()
    rows = keyed.filter("doc_id IS NOT NULL").join(gone, ["doc_id", th], "left_anti")
    kept = rows.dropDuplicates(["doc_id", th]).select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))
