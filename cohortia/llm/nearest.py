"""Approximate nearest neighbours by balanced posting lists.

Vectors get one more component so that the largest inner product is the least
distance. Centres come from a bounded sample, split in halves again and again so that
lists stay balanced; a vector near a border is kept in all lists whose centre is
almost as near as the nearest. Every task holds a graph of the centres in memory: links to
the nearest ones, in both directions, and the shortest bridges between groups that these
leave apart, so that it hangs together. A query walks it from the nearest of entry centres
that are spread over all, visits the lists whose centres are within a ratio of the
nearest centre's distance (at least until they hold enough vectors), and ranks their
vectors by exact inner products. Lists are dealt out in cells of bounded size, several
small ones or a part of a large one in each; a cell returns a query's best of all its lists.
Queries that find fewer than k ids, because their lists hold copies or repeated ids, ask again
for sixteen times as many vectors until they have k or have visited every list.

Results for odd input: null, empty and zero vectors, vectors that hold a null or
non-finite component, null ids and vectors of another length than most take no part.
Ties go to the smaller id; of rows that repeat an id the one with the largest product counts,
and rows of the query's own id are no candidates. Products of huge vectors may be infinite; those
that are not a number come last. A query gets fewer than k rows only if there are fewer
candidates. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import stored

LIST_VECTORS = 256  # aim for a list
MOST_CENTRES = 8192
SAMPLE = 40_000  # vectors that the centres are taken from, about
BORDER = 1.04  # a vector is kept in lists up to this ratio of distances
COPIES = 6
RATIO = 1.15  # a query visits lists up to this ratio of distances
LEAST_VECTORS = 8  # times k: what the visited lists hold together at least
MORE = 16  # times as many in a next try
NEIGHBOURS = 16  # nearest centres that a centre is linked to
ENTRY_CENTRES = 16  # centres for each entry of the graph
ENTRIES = 8  # that a walk starts from
CELL = 16_384  # vectors, or queries, of a cell: what one task takes at once

_DIMENSIONS = "vec_id long, vector array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part, each id and vector once."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).filter(
        "vec_id IS NOT NULL AND size(vector) > 0"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(vector, x -> x != 0)")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    most = sizes.collect()
    return rows.filter(F.size("vector") == (most[0].n if most else 0)).dropDuplicates(["vec_id", "vector"])


def halves(vectors: np.ndarray, lists: int) -> list[np.ndarray]:
    """Centres of equal parts: each cut runs through the median of the widest direction."""
    parts, done = [vectors], []
    while parts:
        parts.sort(key=len)
        part = parts.pop()
        if len(parts) + len(done) + 1 >= lists or len(part) < 2:
            done.append(part)
            continue
        spread = part - part.mean(axis=0)
        way = spread[np.argmax((spread * spread).sum(axis=1))]
        for _ in range(8):  # power steps towards the widest direction
            way = spread.T @ (spread @ way)
            way /= max(np.linalg.norm(way), 1e-30)
        along = np.argsort(spread @ way, kind="stable")
        parts += [part[along[:len(part) // 2]], part[along[len(part) // 2:]]]
    return done


def centres_of(sample: np.ndarray, lists: int) -> np.ndarray:
    sample = np.unique(sample, axis=0)
    centres = np.stack([part.mean(axis=0) for part in halves(sample, lists)])
    for _ in range(4):  # Lloyd steps even out the borders
        near = nearest_centres(sample, centres, 1)[0][:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def nearest_centres(vectors: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centres of each vector and their distances, nearest first."""
    n, found, far = min(n, len(centres)), [], []
    for block in np.array_split(vectors, max(1, len(vectors) * len(centres) // 4_000_000)):
        d = np.maximum(0, (block ** 2).sum(1)[:, None] - 2 * block @ centres.T + (centres ** 2).sum(1))
        at = np.argpartition(d, n - 1, axis=1)[:, :n]
        own = np.take_along_axis(d, at, 1)
        order = np.argsort(own, axis=1, kind="stable")
        found.append(np.take_along_axis(at, order, 1))
        far.append(np.sqrt(np.take_along_axis(own, order, 1)))
    return np.concatenate(found), np.concatenate(far)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is connected with by the links (a, b)."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def bridges(centres: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component its shortest link to a centre of another."""
    squares, n = (centres ** 2).sum(1), len(centres)
    to, far = np.zeros(n, np.int64), np.zeros(n)
    for rows in np.array_split(np.arange(n), max(1, n * n // 4_000_000)):
        d = squares[rows][:, None] - 2 * centres[rows] @ centres.T + squares
        d[label[rows][:, None] == label] = np.inf
        to[rows] = d.argmin(axis=1)
        far[rows] = d[np.arange(len(rows)), to[rows]]
    order = np.lexsort((far, label))
    first = order[np.unique(label[order], return_index=True)[1]]
    return first, to[first]


def graph_of(centres: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Links of each centre, in both directions and connected, and the entries."""
    n = len(centres)
    near = nearest_centres(centres, centres, NEIGHBOURS + 1)[0]
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    while len(np.unique(label := components(n, a, b))) > 1:
        more = bridges(centres, label)
        a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    links = np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))
    middles = np.stack([part.mean(axis=0) for part in halves(centres, max(1, n // ENTRY_CENTRES))])
    return links, np.unique(nearest_centres(middles, centres, 1)[0])


def walk(query: np.ndarray, starts: np.ndarray, centres: np.ndarray, links: list[np.ndarray], ratio: float,
         sizes: np.ndarray, least: int) -> np.ndarray:
    """Lists to visit: best-first steps until the centres within the ratio, or as many as hold enough, are all expanded."""
    known = distance = np.zeros(0)
    seen, expanded, front = np.zeros(len(centres), bool), np.zeros(len(centres), bool), starts
    known = known.astype(np.int64)
    while True:
        seen[front] = True
        known = np.concatenate([known, front])
        distance = np.concatenate([distance, np.sqrt(((centres[front] - query) ** 2).sum(axis=1))])
        near = known[distance <= distance.min() * ratio]
        if sizes[near].sum() < least or len(near) < ENTRIES:
            order = known[np.argsort(distance, kind="stable")]
            near = order[:max(ENTRIES, int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1)]
        grow = near[~expanded[near]]
        if not len(grow):
            return near
        expanded[grow] = True
        front = np.unique(np.concatenate([links[one] for one in grow.tolist()]))
        front = front[~seen[front]]


def lists_of(queries: np.ndarray, centres: np.ndarray, graph: tuple[list[np.ndarray], np.ndarray], ratio: float,
             sizes: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Lists to visit for each query."""
    links, entries = graph
    starts = nearest_centres(queries, centres[entries], ENTRIES)[0] if len(queries) else ()
    for query, own in zip(queries, starts):
        yield walk(query, entries[own], centres, links, ratio, sizes, least)


def best_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray,
            k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best ids of the vectors; scores are summed in one fixed order."""
    repeated = len(np.unique(vec_ids)) < len(vec_ids)
    for begin in range(0, len(queries), 256):
        with np.errstate(over="ignore", invalid="ignore"):
            rough = queries[begin:begin + 256] @ vectors.T
            for row, query, own in zip(rough, queries[begin:begin + 256], ids[begin:begin + 256]):
                other = vec_ids != own
                if len(row) > k + 1 and not repeated and np.isfinite(row).all():
                    row[~other] = -np.inf
                    edge = np.partition(row, len(row) - k)[len(row) - k]
                    other &= row >= edge - 1e-9 * (1 + abs(edge))
                at = np.flatnonzero(other)
                score = (vectors[at] * query).sum(axis=1)
                order = np.lexsort((vec_ids[at], -np.where(np.isnan(score), -np.inf, score)))
                if repeated:  # the best row of each id
                    order = order[np.sort(np.unique(vec_ids[at][order], return_index=True)[1])]
                yield int(own), vec_ids[at][order[:k]], score[order[:k]]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1 if rows else 1)


def search(vectors: DataFrame, is_query, *, k: int = 20, ratio: float = RATIO, border: float = BORDER,
           list_vectors: int = LIST_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score of the rows (vec_id, embedding) for which the column ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    found = "query_id long, vec_id long, score double"
    facts = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")).collect()[0]
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = facts.largest  # distances are measured in this unit: no square overflows
    longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x / largest * (x / largest)))).collect()[0][0]
    grain = 1 << 30
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("centre")), F.lit(grain)) < min(grain, grain * SAMPLE // facts.n))

    def lifted(x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x / largest
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))
        return np.concatenate([x, more[:, None]], axis=1)

    taken = sample.select("vector").toArrow()  # a bounded number of vectors
    if not len(taken):
        taken = rows.select("vector").limit(1).toArrow()
    lists = max(1, min(MOST_CENTRES, facts.n // list_vectors, len(taken)))
    centres = centres_of(lifted(_matrix(taken.column("vector"), len(taken))), lists)
    shared = spark.sparkContext.broadcast((centres, graph_of(centres)))  # of bounded size

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = shared.value
        for batch in batches:
            near, far = nearest_centres(lifted(_matrix(batch.column("vector"), len(batch))), centres, COPIES)
            row, column = np.nonzero(far <= far[:, :1] * border + 1e-12)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near[row, column].astype(np.int32)), batch.column("vec_id").take(pa.array(row)),
                 batch.column("vector").take(pa.array(row))], names=["list", "vec_id", "vector"])

    postings = stored(rows.mapInArrow(placed, "list int, " + _DIMENSIONS), "postings")
    counts = postings.groupBy("list").count().collect()  # one row for each centre
    sizes = np.zeros(len(centres), np.int64)
    for row in counts:
        sizes[row["list"]] = row["count"]
    # Cells: runs of small lists, or parts of a large one; one entry for each centre.
    parts = np.maximum(1, -(-sizes // CELL))
    first_cell, cell, room = np.zeros(len(sizes), np.int64), -1, 0
    for one, (n, own) in enumerate(zip(sizes.tolist(), parts.tolist())):
        if own > 1 or n > room:
            cell, room = cell + 1, CELL
        first_cell[one] = cell
        room -= n
        if own > 1:
            cell, room = cell + own - 1, 0
    shared_cells = spark.sparkContext.broadcast((sizes, first_cell, parts))

    at = spark.createDataFrame(list(zip(range(len(sizes)), first_cell.tolist(), parts.tolist())),
                               "list int, first_cell long, parts long")

    def visiting(least: int):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (centres, graph), (sizes, first_cell, parts) = shared.value, shared_cells.value
            for batch in batches:
                rows, cells, lists = [], [], []
                points = lifted(_matrix(batch.column("vector"), len(batch)), query=True)
                for row, near in enumerate(lists_of(points, centres, graph, ratio, sizes, least)):
                    held: dict[int, list[int]] = {}
                    for one in near[sizes[near] > 0].tolist():
                        for own in range(first_cell[one], first_cell[one] + parts[one]):
                            held.setdefault(own, []).append(one)
                    rows += [row] * len(held)
                    cells += held
                    lists += held.values()
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int64()), pa.array(lists, pa.list_(pa.int32())), batch.column("vec_id").take(at),
                     batch.column("vector").take(at)], names=["cell", "lists", "vec_id", "vector"])

        return visit

    def height(score: float) -> float:
        return -np.inf if score != score else score

    def ranked(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(queries) and len(candidates):
            candidates = candidates.sort_by("list")
            held, ids = candidates.column("list").to_numpy(), candidates.column("vec_id").to_numpy()
            data = _matrix(candidates.column("vector"), len(candidates))
            asked, points = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), len(queries))
            lists = queries.column("lists").to_pylist()
            best: dict[int, dict[int, float]] = {}
            visitors: dict[int, list[int]] = {}
            for row, own in enumerate(lists):
                for one in own:
                    visitors.setdefault(one, []).append(row)
            for one, who in sorted(visitors.items()):
                a, b = np.searchsorted(held, [one, one + 1])
                if b > a:
                    for query, found, scores in best_of(points[who], asked[who], data[a:b], ids[a:b], k):
                        held_best = best.setdefault(query, {})
                        for one_id, score in zip(found.tolist(), scores.tolist()):
                            if one_id not in held_best or height(score) > height(held_best[one_id]):
                                held_best[one_id] = score
            for query, found in best.items():
                top = sorted(found.items(), key=lambda x: (-height(x[1]), x[0]))[:k]
                out[0] += [query] * len(top)
                out[1] += [x for x, _ in top]
                out[2] += [x for _, x in top]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    def answered(asked: DataFrame, least: int, name: str) -> DataFrame:
        """query_id, vec_id, score: at least the k best of the lists that each asked row visits."""
        visits = stored(asked.mapInArrow(visiting(least), "cell long, lists array<int>, " + _DIMENSIONS), f"visits-{name}")
        # At most one row for each centre, or for each cell: of bounded number.
        query_parts = F.broadcast(visits.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("query_parts")))
        left = visits.join(query_parts, "cell").withColumn("query_part", F.pmod(F.xxhash64("vec_id"), "query_parts").cast("int"))
        right = postings.join(F.broadcast(at), "list").withColumn(
            "cell", F.col("first_cell") + F.pmod(F.xxhash64("vec_id"), "parts")).join(query_parts, "cell").withColumn(
            "query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
        key = ["cell", "query_part"]
        best = left.select(*key, "lists", "vec_id", "vector").groupBy(key).cogroup(
            right.select(*key, "list", "vec_id", "vector").groupBy(key)).applyInArrow(ranked, found)
        order = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
        by_query = Window.partitionBy("query_id").orderBy(F.desc("height"), "vec_id")
        return stored(
            best.withColumn("height", order).groupBy("query_id", "vec_id").agg(
                F.max("height").alias("height"), F.max_by("score", "height").alias("score"))
            .withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"), f"answers-{name}")

    asked, least = rows.filter(is_query), LEAST_VECTORS * k
    answers, tries, total = answered(asked, least, "0"), 0, int(sizes.sum())
    while least < total:
        full = answers.filter(F.col("rank") == k).select("query_id")
        asked = stored(asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), f"asked-{tries}")
        if asked.isEmpty():
            break
        least, tries = least * MORE, tries + 1
        answers = stored(answers.join(full, "query_id", "left_semi").unionByName(
            answered(asked, least, str(tries))), f"answers-of-{tries}")
    return answers.select("query_id", "rank", "vec_id", "score")
