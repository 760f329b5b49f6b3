"""Random forests and gradient boosting of regression trees, level by level over counted cells.

A tree sees a row only through the bins of its features. So the rows are binned and counted once: a cell
is all rows of equal bins and target, with their number, and every pass reads cells, which are never more
than the rows. A pass walks the cells of a partition down the trees so far and adds them up by node,
feature and bin; the sums of a tree meet in one task, which finds the best splits of its nodes. Nothing of
the size of the table reaches the driver: only splits, and for boosting sums of a few nodes.

Rules are those of Spark's own trees: at most 32 bins of about equal shares, splits of the largest decrease
of the variance, each tree of a forest on rows drawn with replacement (a row counts Poisson(1) times, a cell
of n rows Poisson(n) times) and a third of the features for each node; boosting takes the first tree
whole and then steps along twice what is left. Draws depend on the seed and the place of a cell in the
stored order, not on who works on it. Missing or NaN features and targets that are no finite number raise
an error.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.session import shared_root, stored

# Tasks get these functions by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_BINS, BITS, IN_A_CODE = 32, 5, 12   # bins of a feature; bits of a bin; bins in a 64-bit code
MOST_VALUES, SHARES = 10_000, 1_023      # distinct values taken one by one; edges that cut more of them into parts
BLOCK = 16_384                           # cells worked on at a time, so that they stay in the cache
MOST_SUMS = 4_000_000                    # sums that a task holds at once: trees of a level take turns beyond it
DRAW_BITS, MOST_IN_TABLE = 16, 8         # draws are rounded to 2^-16; cells of more rows are drawn one by one
FLAT = 1e-14                             # share of the target's variance that a split must remove: more than rounding
ROUNDS_A_CHECKPOINT = 20

# A tree is four arrays over its nodes, the root first: feature and last bin on the left, the left child (the right one
# follows it; a leaf is its own child) and the mean of the target.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
NO_CUT = 1 << BITS


# -- bins and cells -----------------------------------------------------------------

def thresholds(parts: list[tuple[float, float, int]], bins: int) -> list[float]:
    """Cuts between neighbouring parts (least value, largest value, rows): all, or those nearest to equal shares."""
    cuts = [(before[1] + after[0]) / 2 for before, after in zip(parts, parts[1:])]
    if len(parts) <= bins:
        return cuts
    stride = sum(n for _, _, n in parts) / bins
    kept, goal, seen = [], stride, parts[0][2]
    for cut, (_, _, n) in zip(cuts, parts[1:]):
        if abs(seen - goal) < abs(seen + n - goal):
            kept.append(cut)
            goal += stride
        seen += n
    return kept


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    def among(begin: int, end: int) -> Column:
        if begin == end:
            return F.lit(begin).cast("bigint")
        middle = (begin + end) // 2
        return F.when(value <= cuts[middle], among(begin, middle)).otherwise(among(middle + 1, end))

    return among(0, len(cuts))


@dataclass
class Bins:
    """Features with the cuts between their bins, and the number of rows they come from."""

    features: list[str]
    cuts: list[list[float]]
    rows: int

    @classmethod
    def of(cls, rows: DataFrame, features: list[str], target: str) -> Bins:
        """From all rows, in one pass that counts every value of a feature.

        A feature of more than ``MOST_VALUES`` values takes a second one, which cuts them into parts of about equal size first.
        """
        goal = F.col(target).cast("double")
        odd = (goal.isNull() | F.isnan(goal) | (F.abs(goal) == float("inf"))).cast("double")
        values = [*(F.col(c).cast("double") for c in features), odd]
        counts = stored(rows.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("place"), v.alias("value")) for i, v in enumerate(values)]))).groupBy(
            "place", "value").agg(F.count("*").alias("n")), "bin-values")
        missing = F.col("value").isNull() | F.isnan("value")
        found = {r["place"]: r for r in counts.groupBy("place").agg(
            F.count("*").alias("values"), F.sum("n").alias("n"), F.count_if(missing).alias("missing"),
            F.max("value").alias("most")).collect()}
        if not found:
            raise ValueError("no rows to grow trees on")
        if any(found[i]["missing"] for i in range(len(features))):
            raise ValueError("missing or NaN value in the features of trees")
        if found[len(features)]["most"] > 0:
            raise ValueError("targets of trees must be finite numbers")
        wide = [i for i in range(len(features)) if found[i]["values"] > MOST_VALUES]
        few = counts.where(~F.col("place").isin([*wide, len(features)])).select("place", F.col("value").alias("low"), F.col("value").alias("high"), "n")
        parts = few.collect()
        if wide:
            shares = [(k + 1) / (SHARES + 1) for k in range(SHARES)]
            edges = rows.agg(*[F.percentile_approx(values[i], shares, MOST_VALUES).alias(str(i)) for i in wide]).first().asDict()
            parts += cls._parts(counts.where(F.col("place").isin(wide)), {int(i): np.unique(e) for i, e in edges.items()}).collect()
        by_place: dict[int, list] = {}
        for r in sorted(parts, key=lambda r: (r["place"], r["low"])):
            by_place.setdefault(r["place"], []).append((r["low"], r["high"], r["n"]))
        total = found[len(features)]["n"]
        return cls(features, [thresholds(by_place[i], min(MOST_BINS, total)) for i in range(len(features))], total)

    @staticmethod
    def _parts(counts: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
        """(place, low, high, n) of the values on and between the edges."""
        def parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, value = batch.column("place").to_numpy(), batch.column("value").to_numpy()
                part = np.zeros(len(place), np.int64)
                for i, edge in edges.items():
                    own = place == i
                    part[own] = np.searchsorted(edge, value[own], "left") + np.searchsorted(edge, value[own], "right")
                yield pa.record_batch({"place": batch.column("place"), "part": part, "value": batch.column("value"), "n": batch.column("n")})

        return counts.mapInArrow(parted, "place int, part bigint, value double, n bigint").groupBy("place", "part").agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n")).drop("part")

    def cells(self, rows: DataFrame, target: str, width: int) -> DataFrame:
        """Codes of the bins, target and number of rows, in an order that a second run repeats."""
        bins = [bin_of(F.col(c).cast("double"), cuts) for c, cuts in zip(self.features, self.cuts)]
        codes = []
        for begin in range(0, len(bins), IN_A_CODE):
            code = F.lit(0).cast("bigint")
            for k, bin_ in enumerate(bins[begin:begin + IN_A_CODE]):
                code = code.bitwiseOR(F.shiftleft(bin_, BITS * k))
            codes.append(code.alias(f"code_{begin // IN_A_CODE}"))
        keyed = rows.select(*codes, F.col(target).cast("double").alias("goal"))
        return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n")).repartition(
            width, *keyed.columns).sortWithinPartitions(*keyed.columns)

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts])


def code_columns(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c.startswith("code_")]


def blocks(cells: DataFrame, sums: str) -> RDD:
    """Codes, and a sum of targets with the number of rows, for every BLOCK cells in turn."""
    names = [*code_columns(cells), sums, "n"]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in names]
            return pa.record_batch({"codes": [np.stack(columns[:-2]).tobytes()],
                                    "numbers": [np.stack(columns[-2:]).astype(np.float64).tobytes()]})

        for batch in batches:
            while len(batch):
                part = batch.slice(0, BLOCK - size)
                held.append(part)
                size += len(part)
                batch = batch.slice(len(part))
                if size == BLOCK:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def read(row) -> tuple:
        return np.frombuffer(row["codes"], np.int64).reshape(len(names) - 2, -1), np.frombuffer(row["numbers"]).reshape(2, -1)

    return cells.mapInArrow(packed, "codes binary, numbers binary").rdd.map(read)


def spread_out(codes: np.ndarray, features: int) -> np.ndarray:
    """Bins of all features, one feature after the other."""
    bins = [codes[f // IN_A_CODE] >> (BITS * (f % IN_A_CODE)) & ((1 << BITS) - 1) for f in range(features)]
    return np.concatenate(bins).astype(np.intp)


def centred(cells: DataFrame) -> tuple[DataFrame, float, float]:
    """Cells with targets around their mean, that mean, and the variance."""
    n, mean = cells.agg(F.sum("n"), F.sum(F.col("goal") * F.col("n")) / F.sum("n")).first()
    around = cells.withColumn("goal", F.col("goal") - F.lit(mean))
    return around, mean, around.agg(F.sum(F.col("goal") * F.col("goal") * F.col("n"))).first()[0] / n


# -- growing ------------------------------------------------------------------------

def walked(tree: Tree, bins: np.ndarray, at: np.ndarray, stride: int, steps: int) -> np.ndarray:
    """Node that each cell reaches; ``at`` are places of cells, ``stride`` apart from a feature to the next."""
    feature, cut, left, _ = tree
    begins, node = feature * stride, np.zeros(len(at), np.intp)
    for _ in range(steps):
        place = begins.take(node)
        place += at
        right = bins.take(place) > cut.take(node)
        node = left.take(node)
        node += right
    return node


@dataclass
class Growth:
    """A tree on the driver, whose open nodes wait for a split."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    open: np.ndarray

    @classmethod
    def root(cls) -> Growth:
        return cls(*(np.array([v]) for v in (0, NO_CUT, 0, 0.0, 0.0)), open=np.array([0]))

    def tree(self) -> Tree:
        return self.feature, self.cut, self.left, self.value

    def split(self, best: tuple[np.ndarray, ...], floor: float, last: bool) -> None:
        """Children for the open nodes whose best split gains more than ``floor`` a row; open ones, unless at the last level."""
        gain, n, total, feature, cut, left_n, left_total = best
        if self.open.size and self.open[0] == 0:
            self.value[0] = total[0] / max(n[0], 1)
        done = gain > floor * n
        node = self.open[done]
        left = len(self.left) + 2 * np.arange(len(node))
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature[done], cut[done], left, gain[done]
        counts = np.stack([left_n[done], (n - left_n)[done]], 1).ravel()
        totals = np.stack([left_total[done], (total - left_total)[done]], 1).ravel()
        children = len(self.left) + np.arange(len(counts))
        fresh = (np.zeros(len(counts), int), np.full(len(counts), NO_CUT), children, totals / counts, np.zeros(len(counts)))
        for name, values in zip(("feature", "cut", "left", "value", "gain"), fresh):
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        self.open = children[counts > 1] if not last else children[:0]

    def gains(self, features: int) -> np.ndarray:
        return np.bincount(self.feature, self.gain, features)


def best_splits(counts: np.ndarray, totals: np.ndarray, subsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Decrease of the sum of squares, rows, total, feature, last bin on the left, rows and total there, of each node."""
    own = sizes[subsets]
    there = np.arange(own.max()) < own[:, :, None]
    n, s = np.zeros(there.shape), np.zeros(there.shape)
    n[there], s[there] = counts, totals
    n, s = n.cumsum(2), s.cumsum(2)
    all_n, all_s = n[:, :1, -1:], s[:, :1, -1:]
    right = all_n - n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(there & (n > 0) & (right > 0), s * s / n + (all_s - s) ** 2 / right - all_s ** 2 / all_n, -1.0)
    flat = gain.reshape(len(gain), -1)
    at, row = flat.argmax(1), np.arange(len(flat))
    j, cut = at // gain.shape[2], at % gain.shape[2]
    return flat[row, at], all_n[:, 0, 0], all_s[:, 0, 0], subsets[row, j], cut, n[row, j, cut], s[row, j, cut]


def level_of(growth: Growth, subsets: np.ndarray, sizes: np.ndarray) -> tuple:
    """What a pass needs of a tree: for each node the features to try and where their sums begin, past the others if it is not open."""
    own = sizes[subsets].ravel()
    size, nodes = int(own.sum()), len(growth.left)
    tried, begins = np.zeros((nodes, subsets.shape[1]), int), np.full((nodes, subsets.shape[1]), size)
    tried[growth.open], begins[growth.open] = subsets, (np.cumsum(own) - own).reshape(subsets.shape)
    return growth.tree(), tried.T.copy(), begins.T.copy(), subsets, size


def added(level: tuple, bins: np.ndarray, at: np.ndarray, stride: int, steps: int, counts: np.ndarray, totals: np.ndarray,
          sums: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds cells to the sums of the open nodes they reach."""
    tree, tried, begins, _, size = level
    node = walked(tree, bins, at, stride, steps)
    for features, begin in zip(tried * stride, begins):
        place = features.take(node)
        place += at
        place = bins.take(place)
        place += begin.take(node)
        for to, values in zip(sums, (counts, totals)):
            to += np.bincount(place, values, size + MOST_BINS)[:size]


def draw_table() -> np.ndarray:
    """Poisson(n) by n and a random number of DRAW_BITS bits."""
    shares = (np.arange(1 << DRAW_BITS) + 0.5) / (1 << DRAW_BITS)
    k = np.arange(1, 64)
    rows = []
    for n in range(1, MOST_IN_TABLE + 1):
        below = np.exp(-n) * np.concatenate([[1.0], np.cumprod(n / k)])
        rows.append(np.searchsorted(np.cumsum(below), shares))
    return np.concatenate(rows).astype(np.uint8)


@dataclass
class Trees:
    """A fitted model: the weighted sum of its trees."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    weights: list[float]
    base: float
    depth: int
    featureImportances: DenseVector

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``prediction``."""
        sent = rows.sparkSession.sparkContext.broadcast((self.cuts, self.trees, self.weights))
        base, depth = self.base, self.depth

        def predicted(*columns: pd.Series) -> pd.Series:
            cuts, trees, weights = sent.value
            values = [c.to_numpy(np.float64) for c in columns]
            if any(np.isnan(v).any() for v in values):
                raise ValueError("missing or NaN value in the features of trees")
            found = np.full(len(values[0]), base)
            for begin in range(0, len(found), BLOCK):
                part = [np.searchsorted(cut, v[begin:begin + BLOCK]) for cut, v in zip(cuts, values)]
                bins, at = np.concatenate(part).astype(np.intp), np.arange(len(part[0]))
                for tree, weight in zip(trees, weights):
                    found[begin:begin + BLOCK] += weight * tree[3].take(walked(tree, bins, at, len(at), depth))
            return pd.Series(found)

        return rows.withColumn("prediction", F.pandas_udf(predicted, "double")(*(F.col(c).cast("double") for c in self.features)))


def shared_out(gains: np.ndarray) -> np.ndarray:
    return gains / gains.sum() if gains.sum() > 0 else gains


@dataclass
class Forest:
    """The mean of trees that each see rows drawn with replacement, and a third of the features at a node."""

    bins: Bins
    trees: int
    depth: int
    seed: int

    def fit(self, cells: DataFrame) -> Trees:
        cells, mean, variance = centred(cells)
        sizes, count = self.bins.sizes, len(self.bins.features)
        tried = -(-count // 3) if self.trees > 1 else count
        growths, random = [Growth.root() for _ in range(self.trees)], np.random.default_rng(self.seed)
        rows = blocks(cells, "goal").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for step in range(self.depth):
                levels = {}
                for k, growth in enumerate(growths):
                    if growth.open.size:
                        order = random.random((len(growth.open), count)).argsort(1)
                        levels[k] = level_of(growth, np.sort(order[:, :tried], 1), sizes)
                for some in self.turns(levels):
                    for k, best in self.best(rows, some, step, sizes).items():
                        growths[k].split(best, FLAT * variance, step + 1 == self.depth)
        finally:
            rows.unpersist()
        importance = shared_out(sum(shared_out(g.gains(count)) for g in growths))
        return Trees(self.bins.features, self.bins.cuts, [g.tree() for g in growths], [1 / self.trees] * self.trees, mean,
                     self.depth, Vectors.dense(importance))

    @staticmethod
    def turns(levels: dict[int, tuple]) -> Iterator[dict[int, tuple]]:
        """Trees whose sums fit a task together."""
        some, held = {}, 0
        for k, level in levels.items():
            if some and held + level[4] > MOST_SUMS:
                yield some
                some, held = {}, 0
            some[k] = level
            held += level[4]
        if some:
            yield some

    def best(self, rows: RDD, levels: dict[int, tuple], steps: int, sizes: np.ndarray) -> dict[int, tuple]:
        """Best splits of the open nodes of some trees, from one pass; the sums of a tree are added in the order of the partitions."""
        sent, seed, count = rows.context.broadcast(levels), self.seed, len(sizes)

        def passed(part: int, found: Iterable[tuple]) -> Iterator[tuple]:
            sums = {k: (np.zeros(level[4]), np.zeros(level[4])) for k, level in sent.value.items()}
            table = draw_table()
            randoms = {k: np.random.SFC64([seed, part, k]) for k in sums}
            for codes, (goals, numbers) in found:
                bins, size = spread_out(codes, count), len(goals)
                many = np.flatnonzero(numbers > MOST_IN_TABLE)
                begins = (np.minimum(numbers, MOST_IN_TABLE).astype(np.intp) - 1) << DRAW_BITS
                for k, level in sent.value.items():
                    drawn = table.take(begins + randoms[k].random_raw(-(-size // 4)).view(np.uint16)[:size])
                    if len(many):
                        drawn = drawn.astype(np.float64)
                        drawn[many] = np.random.Generator(randoms[k]).poisson(numbers[many])
                    at = np.flatnonzero(drawn > 0)
                    drawn = drawn.take(at).astype(np.float64)
                    added(level, bins, at, size, steps, drawn, drawn * goals.take(at), sums[k])
            for k, (counts, totals) in sums.items():
                yield k, (part, counts, totals)

        def split(k: int, parts: Iterable[tuple]) -> tuple:
            ordered = sorted(parts, key=lambda p: p[0])
            return best_splits(sum(p[1] for p in ordered), sum(p[2] for p in ordered), sent.value[k][3], sizes)

        try:
            return dict(rows.mapPartitionsWithIndex(passed).groupByKey(min(len(levels), rows.getNumPartitions())).map(
                lambda own: (own[0], split(*own))).collect())
        finally:
            sent.unpersist()


@dataclass
class Boosting:
    """A tree of the targets, then steps along trees of twice what is left."""

    bins: Bins
    rounds: int
    depth: int
    rate: float

    def fit(self, cells: DataFrame) -> Trees:
        cells, mean, variance = centred(cells)
        width, spark = cells.rdd.getNumPartitions(), cells.sparkSession
        summed = cells.groupBy(*code_columns(cells)).agg(F.sum(F.col("goal") * F.col("n")).alias("total"), F.sum("n").alias("n"))
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_root(spark))
        rows = blocks(summed.repartition(width), "total").map(lambda row: (*row, np.zeros(row[1].shape[1])))
        growths, held = [], []
        try:
            for number in range(self.rounds):
                if number:
                    rows = rows.map(self.moved(growths[-1].tree(), 1.0 if number == 1 else self.rate))
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(rows)
                if number and number % ROUNDS_A_CHECKPOINT == 0:
                    rows.checkpoint()
                growths.append(self.grown(rows, 2.0 if number else 1.0, FLAT * variance))
                for old in held[:-1]:
                    old.unpersist()
                held = held[-1:]
        finally:
            for old in held:
                old.unpersist()
        count = len(self.bins.features)
        weights = [1.0] + [self.rate] * (self.rounds - 1)
        importance = shared_out(sum(g.gains(count) for g in growths))
        return Trees(self.bins.features, self.bins.cuts, [g.tree() for g in growths], weights, mean, self.depth, Vectors.dense(importance))

    def moved(self, tree: Tree, weight: float):
        """A step of the guesses along a tree."""
        depth, count = self.depth, len(self.bins.features)

        def one(row: tuple) -> tuple:
            codes, numbers, guess = row
            bins, at = spread_out(codes, count), np.arange(len(guess))
            return codes, numbers, guess + weight * tree[3].take(walked(tree, bins, at, len(at), depth))

        return one

    def grown(self, rows: RDD, factor: float, floor: float) -> Growth:
        """A tree of what the guesses leave; the sums of its few nodes are added on the driver."""
        growth, sizes, count = Growth.root(), self.bins.sizes, len(self.bins.features)
        for steps in range(self.depth):
            if not growth.open.size:
                break
            level = level_of(growth, np.tile(np.arange(count), (len(growth.open), 1)), sizes)

            def passed(found: Iterable[tuple]) -> Iterator[tuple]:
                sums = np.zeros(level[4]), np.zeros(level[4])
                for codes, (totals, numbers), guess in found:
                    bins, at = spread_out(codes, count), np.arange(len(guess))
                    added(level, bins, at, len(at), steps, numbers, factor * (totals - numbers * guess), sums)
                yield sums

            parts = rows.mapPartitions(passed).collect()
            growth.split(best_splits(sum(p[0] for p in parts), sum(p[1] for p in parts), level[3], sizes), floor, steps + 1 == self.depth)
        return growth
