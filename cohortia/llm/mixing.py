"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives every document a probability for
each domain. Its words, times these, are what the document adds to each domain's
expected total. Rates (expected copies) that make the totals meet the targets are then fitted by
projected gradient steps on the least squares of what is missing, from rate 1: every rate moves
along its own slope and is cut off at the bound. A step is scaled by the inverse Gram matrix of
the rows that can move, or a few very long rows that stand at the bound would make all steps
tiny. A rate follows from the few weights of the steps so far, so a step is one aggregation
to one row and no rates are stored. The fit ends when the totals are met, or when a bound over all
rates shows that none come closer; then the error is least in the inverse Gram matrix of all rows.

Word beginnings and endings are hashed into a vector; a multinomial logistic regression is
fitted on a bounded sample of labelled rows. Everything runs as DataFrame functions and
Spark's own estimators.

Results for odd input: null and blank texts have no words, add nothing to any total and keep
the rate 1; repeated rows count each and get equal rates; null ids get rates and are never
learned from. Domains without labelled rows can't be predicted: their target is
dropped and the others are scaled up. With fewer than two labelled domains all rates are 1.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.texts import sampled, unused
from cohortia.session import stored

SAMPLE_ROWS = 1500  # labelled rows of each domain that the classifier is learned from, about
FEATURES = 1 << 13
STEPS = 100  # passes, far more than a fit needs; a warning tells if they end it
CLOSE = 1e-6  # error of the totals, relative to their sum, at which the fit ends
BEST = 0.02  # share of the squared error that other rates could save at most where the targets can't be met
DAMP = 1e-10  # added to the Gram matrix of the rows that can move, whose eigenvalues are at most 1
WIDTHS = (1.0, 0.5, 0.25, 0.1, 0.02)  # of a step, tried one after the other
GAIN = 0.05  # share of what a step promises that it has to bring
FLAT = 1e-6  # eigenvalues below this share of the largest are directions in which no row can move

_log = logging.getLogger(__name__)


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _features(docs: DataFrame) -> DataFrame:
    """docs with ``n_words`` and ``features`` (unit length) from its text."""
    docs = docs.withColumn("_words", _words("text"))
    docs = docs.withColumn("n_words", F.size("_words").cast("long")).withColumn("_terms", F.concat(
        F.transform("_words", lambda w: F.left(w, F.lit(4))),
        F.transform("_words", lambda w: F.concat(F.lit("~"), F.right(w, F.lit(2))))))
    hashed = HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=FEATURES).transform(docs)
    return Normalizer(inputCol="_counts", outputCol="features", p=2.0).transform(hashed).drop("_words", "_terms", "_counts")


def memberships(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[str]]:
    """docs (doc_id and text among them) with n_words and p (array, one probability for each domain), and
    the domains; labels holds (doc_id, domain)."""
    usable = labels.filter("domain IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "domain").distinct()
    drawn, counts = sampled(usable, "domain", sample_rows)
    domains = sorted(counts)
    if len(domains) < 2:
        return docs.withColumns({"n_words": F.size(_words("text")).cast("long"),
                                 "p": F.array(*[F.lit(1.0)] * len(domains)).cast("array<double>")}), domains
    number = F.create_map(*(x for k, name in enumerate(domains) for x in (F.lit(name), F.lit(float(k)))))
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(
        F.broadcast(drawn), "doc_id").withColumn("label", number[F.col("domain")])  # a bounded number of ids
    seen = stored(_features(rows).select("label", "features"), "mixing-sample").repartition(4)
    if seen.select("label").distinct().count() < 2:
        return memberships(docs, labels.filter(F.lit(False)), sample_rows=sample_rows)
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, probabilityCol="_p",
                               predictionCol="_label", rawPredictionCol="_raw").fit(seen)
    found = model.transform(_features(docs))
    p = F.slice(F.concat(vector_to_array("_p"), F.array_repeat(F.lit(0.0), len(domains))), 1, len(domains))
    return found.withColumn("p", p).drop("_p", "_raw", "_label", "features"), domains


def fitted_rate(members: DataFrame, domains: list[str], targets: dict[str, float], *, least: float = 0.0,
                grow: bool = False) -> tuple[Column, dict[str, tuple[float, float]]]:
    """The rate of a row as an expression over n_words and p, and (reached, wanted) totals by domain.

    The wanted totals share the present number of words; with ``grow`` they share the number that
    lets no domain shrink and moves the rates least. No rate falls below ``least``.
    """
    size = len(domains)
    mass = [F.col("n_words") * F.coalesce(F.col("p")[d], F.lit(0.0)) for d in range(size)]
    pairs = [(a, b) for a in range(size) for b in range(a, size)]

    def sums(*columns: Column, rows: DataFrame = members) -> np.ndarray:
        return np.array(rows.agg(*(F.coalesce(c, F.lit(0.0)) for c in columns)).collect()[0], float)

    def combined(weights: np.ndarray) -> Column:
        return reduce(lambda x, y: x + y, (m * F.lit(float(w)) for m, w in zip(mass, weights)))

    def square(values: np.ndarray) -> np.ndarray:
        full = np.zeros((size, size))
        for (a, b), value in zip(pairs, values):
            full[a, b] = full[b, a] = value
        return full

    first = sums(*map(F.sum, mass), *(F.sum(mass[a] * mass[b]) for a, b in pairs)) if size else np.zeros(0)
    present, gram = first[:size], square(first[size:])
    share = np.array([max(0.0, targets.get(name, 0.0)) if present[d] > 0 else 0.0 for d, name in enumerate(domains)])
    if size < 2 or share.sum() <= 0 or present.sum() <= 0:
        return F.lit(1.0), {name: (float(present[d]), float(present[d])) for d, name in enumerate(domains)}
    share /= share.sum()

    def fitted(free: bool) -> tuple[Column, np.ndarray, np.ndarray, bool]:
        """Rate, reached and wanted totals, and whether these are met; ``free`` leaves their sum open."""
        asked = share > 0
        total = max(present[asked] / share[asked]) if grow else present.sum()
        change = np.diag(asked.astype(float)) - np.outer(share, asked) if free else np.eye(size)
        own = change @ gram @ change.T
        scale = 1 / np.sqrt(np.where(np.diag(own) > 0, np.diag(own), 1.0))
        values, vectors = np.linalg.eigh(own * np.outer(scale, scale))
        kept = values > 1e-12 * max(values.max(), 1e-300)
        # Coordinates of the totals in which the Gram matrix of all rows is the unit matrix.
        white = (vectors[:, kept] / np.sqrt(values[kept])).T * scale @ change
        aim = np.zeros(len(white)) if free else white @ (share * total)

        def rate_after(moves: list[np.ndarray]) -> Column:
            return reduce(lambda rate, move: F.greatest(F.lit(float(least)), rate - combined(move)), moves, F.lit(1.0))

        def at(moves: list[np.ndarray], slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Totals after these moves, their error and the Gram matrix of the rows that a move along the slope can change."""
            rows = members.select(*(m.alias(f"m{d}") for d, m in enumerate(mass)), rate_after(moves).alias("rate"),
                                  combined(slope).alias("slope"))
            own, moving = [F.col(f"m{d}") for d in range(size)], (F.col("rate") > float(least)) | (F.col("slope") < 0)
            row = sums(*(F.sum(m * F.col("rate")) for m in own), *(F.sum(F.when(moving, own[a] * own[b])) for a, b in pairs), rows=rows)
            return row[:size], white @ row[:size] - aim, white @ square(row[size:]) @ white.T

        def best(rate: Column, error: np.ndarray) -> bool:
            """Whether no rates with up to twice the words have much less error."""
            slope, words = combined(white.T @ error), reduce(lambda x, y: x + y, mass)
            down, most = sums(F.sum(slope * (rate - float(least))), F.max(F.when(words > 0, -slope / words)))
            return down + max(0.0, most) * 2 * max(total, present.sum()) <= BEST / 2 * (error @ error)

        moves: list[np.ndarray] = []
        reached, error, matrix = at(moves, white.T @ (white @ present - aim))
        errors, scaled = [], True
        for _ in range(STEPS):
            wanted = share * (reached[asked].sum() if free else total)
            missed = np.abs(reached - wanted)[asked if free else slice(None)].max()
            if missed <= CLOSE * wanted.sum():
                return rate_after(moves), reached, wanted, True
            errors.append(float(error @ error))
            if len(errors) % 5 == 0 and errors[-1] > 0.5 * errors[-5] and best(rate_after(moves), error):
                return rate_after(moves), reached, wanted, False
            step, found = None, False
            if scaled:
                inverse = np.linalg.inv(matrix + DAMP * np.eye(len(white)))
                step, drop = inverse @ error, error @ inverse @ error
                for width in WIDTHS:
                    tried = at([*moves, white.T @ step * width], white.T @ step)
                    found = bool(tried[1] @ inverse @ tried[1] <= drop * (1 - GAIN * width))
                    if found:
                        break
                scaled = found and (len(errors) < 10 or tried[1] @ tried[1] <= 0.5 * errors[-10])
                move = white.T @ step * width
            if not found:
                # Totals that can't be met: only steps that lessen the error in the Gram matrix of all rows count.
                _, _, matrix = at(moves, white.T @ error)
                values, vectors = np.linalg.eigh(matrix)
                open_ = values > FLAT * max(values.max(), 1e-300)
                inner = vectors[:, open_] / values[open_] @ vectors[:, open_].T
                widest = max(float(values.max()), DAMP)
                for step in (inner @ error, error / widest, 0.1 * error / widest, error):
                    tried, move = at([*moves, white.T @ step], white.T @ step), white.T @ step
                    if tried[1] @ tried[1] < errors[-1] - 0.01 * abs(error @ (error - tried[1])):
                        break
            if tried[1] @ tried[1] >= errors[-1] and not found:
                break
            moves.append(move)
            reached, error, matrix = tried
        wanted = share * (reached[asked].sum() if free else total)
        _log.warning("The fit of the rates ended early: reached %s, wanted %s", reached.tolist(), wanted.tolist())
        return rate_after(moves), reached, wanted, False

    rate, reached, wanted, met = fitted(grow)
    if grow and not met:
        rate, reached, wanted, met = fitted(False)
    return rate, {name: (float(reached[d]), float(wanted[d])) for d, name in enumerate(domains)}


def copies_of(rate: Column, *key: Column) -> Column:
    """Whole copies: the rate rounded down or up, by a hash of the key, so that the mean is the rate."""
    drawn = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, least: float = 0.0,
          grow: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), n_words, p (by domain), rate and copies of every row of docs (doc_id, text)."""
    members, domains = memberships(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), labels)
    members = stored(members.select("doc_id", "th", "n_words", "p"), "members")
    rate, _ = fitted_rate(members, domains, targets, least=least, grow=grow)
    key = (F.col("doc_id"), F.col("th"))
    return members.withColumn("rate", rate).withColumns({
        "copies": copies_of(F.col("rate"), *key),
        "p": F.map_from_arrays(F.array(*map(F.lit, domains)).cast("array<string>"), F.slice("p", 1, len(domains)))
        if domains else F.create_map().cast("map<string,double>")})


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, least: float = 0.0,
          grow: bool = False) -> DataFrame:
    """The rows of docs, each as often as its copies say, all columns kept."""
    doc, th, copies, key, copy = unused(docs, "doc", "th", "copies", "key", "copy")
    chosen = rates(docs.select("doc_id", "text"), labels, targets, least=least, grow=grow).select(
        F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("copies").alias(copies)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)
