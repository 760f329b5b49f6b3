"""Line deduplication within an edit bound of one character, by a deletion-neighbourhood join.

A line goes if an equal line stands earlier, or, where both have at least ``least_chars``
characters, one at an edit distance of 1; earlier is by document id, then by place. Which of its
twins are themselves removed makes no difference. Lines without a word stay.

Equal lines become one distinct line first (96 bits of hashes). Two lines within one
edit agree in the first or in the last half, so a distinct line whose halves no other
has needs no variants. The others are cut into sixteen segments: two lines within one
edit agree in all that stands before and behind the segment with the edit. Where
another line has the same surroundings of a segment, all variants of the segment with
one character deleted are emitted as hashed keys: with the place (another line with this
key has another character there), and without (the line whose segment equals the
variant has the key too). Each key's lines have an earliest one, found by partial
aggregation; the links to it are verified by edit distance on the texts.

Results for odd input: null texts stay null, with no lines; empty texts have one line without
a word; rows that repeat id and text count as one document, each returned; null ids come
last in order. Empty tables give no rows. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.texts import unused
from cohortia.session import stored

LEAST_CHARS = 20
WORD = r"[^\x20\x09-\x0D]"
SEGMENTS = 16
BIT_WORDS = 1 << 17  # of the map of open lines: 1 MB


def _halves() -> list:
    """Keys of the halves that a line shares with every line within one edit of the same
    length, or one longer (``m`` characters), or one shorter (``m`` - 1)."""
    keys = []
    for shorter in (0, 1):
        m = f"(len - {shorter})"
        keys.append(F.expr(f"xxhash64('first', {m}, left(line, {m} div 2))"))
        keys.append(F.expr(f"xxhash64('last', {m}, right(line, {m} - {m} div 2))"))
    return keys


def _segments(lines: DataFrame) -> DataFrame:
    """For lines (h, g, line, len, first): a row for each segment and each length ``m`` that the
    shorter line of a pair may have, with the key of the segment's surroundings and the segment."""
    place = F.expr(f"inline(transform(sequence(0, {2 * SEGMENTS - 1}), x -> struct("
                   f"x % {SEGMENTS} AS j, len - x div {SEGMENTS} AS m)))")
    cut = lines.select("h", "g", "first", "line", "len", place).selectExpr(
        "*", f"cast(j * m div {SEGMENTS} AS int) AS a", f"cast((j + 1) * m div {SEGMENTS} AS int) AS z")
    return cut.selectExpr(
        "h", "g", "first", "m = len AS shorter",
        "xxhash64(m, j, left(line, a), right(line, cast(m - z AS int))) AS around",
        "substring(line, a + 1, cast(len - a - (m - z) AS int)) AS segment")


def _variants(segments: DataFrame) -> DataFrame:
    """key, kind (place, deleted, whole) and the line of each variant of the segments."""
    cut = "concat(left(segment, i), substring(segment, i + 2))"
    every = "sequence(0, char_length(segment) - 1)"
    place = f"transform({every}, i -> struct(xxhash64('place', around, i, {cut}) AS key, 'place' AS kind))"
    deleted = f"transform({every}, i -> struct(xxhash64('d', around, {cut}) AS key, 'deleted' AS kind))"
    whole = "array(struct(xxhash64('d', around, segment) AS key, 'whole' AS kind))"
    none = f"filter({whole}, x -> false)"
    keys = (f"CASE WHEN shorter AND segment <> '' THEN concat({place}, {whole}) WHEN shorter THEN {whole} "
            f"WHEN segment <> '' THEN array_distinct({deleted}) ELSE {none} END")
    return segments.select("h", "g", "first", F.expr(f"inline({keys})"))


def _may_be(lines: DataFrame, open_lines: DataFrame) -> DataFrame:
    """The lines (h, g among the columns) that a bit map of fixed size lets through, all of ``open_lines``
    among them, so that few texts are shuffled by the join that follows."""
    def spotted(df: DataFrame) -> DataFrame:
        return df.withColumn("spot", F.pmod(F.xxhash64(F.lit("open"), "h", "g"), F.lit(64 * BIT_WORDS))).withColumns({
            "at": F.expr("cast(spot div 64 AS int)"), "bit": F.expr("shiftleft(1L, cast(spot % 64 AS int))")})

    filled = spotted(open_lines).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = lines.sparkSession.range(BIT_WORDS).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    words = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias(
        "bits")))), lambda x: x["bits"]))
    return spotted(lines).filter(F.get(words.scalar(), F.col("at")).bitwiseAND(F.col("bit")) != 0).drop("spot", "at", "bit")


def marked_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (doc, th, line_no, h, g) and the distinct lines (h, g, first, near):
    ``first`` is the earliest place, ``near`` says that a line within one edit stands earlier."""
    lines = (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"),
                    F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .filter(F.col("line").rlike(WORD))
        .select("doc", "th", "line_no", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("g"),
                F.char_length("line").alias("len"))
    )
    keys = _halves()
    facts = stored(lines.select("doc", "th", "line_no", "h", "g", "len", F.when(
        F.col("len") >= least_chars, F.array(*keys)).alias("halves")).withColumns(
        {f"k{i}": F.col("halves")[i] for i in range(4)}).drop("halves"), "line-facts")
    place = F.struct("doc", "line_no", "th")
    distinct = stored(facts.groupBy("h", "g", "len", "k0", "k1", "k2", "k3").agg(F.min(place).alias("first")), "distinct-lines")
    halves = distinct.filter("k0 IS NOT NULL").select("h", "g", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("key")
    open_lines = stored(halves.join(shared, "key", "left_semi").select("h", "g").distinct(), "open-lines")
    texts = stored(
        _may_be(lines.select("h", "g", "line", "len"), open_lines).join(open_lines, ["h", "g"], "left_semi").groupBy("h", "g").agg(
            F.any_value("line").alias("line"), F.any_value("len").alias("len"))
        .join(distinct.select("h", "g", "first"), ["h", "g"]), "open-texts")
    segments = stored(_segments(texts), "segments")
    shared = segments.groupBy("around").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("around")
    variants = stored(_variants(segments.join(shared, "around", "left_semi")), "variants")
    member = F.struct("first", "h", "g")
    earliest = variants.groupBy("key").agg(
        *(F.min(F.when(F.col("kind") == kind, member)).alias(kind) for kind in ("place", "deleted", "whole")),
        F.count("*").alias("n")).filter("n > 1").drop("n")
    partner = F.when(F.col("kind") == "place", F.col("e.place")).when(
        F.col("kind") == "deleted", F.col("e.whole")).otherwise(F.col("e.deleted"))
    links = variants.join(earliest.select("key", F.struct("place", "deleted", "whole").alias("e")), "key").select(
        "h", "g", "first", partner.alias("partner")).filter("partner.first < first").select(
        "h", "g", F.col("partner.h").alias("ph"), F.col("partner.g").alias("pg")).distinct()
    near = (
        links.join(texts.select("h", "g", "line"), ["h", "g"])
        .join(texts.select(F.col("h").alias("ph"), F.col("g").alias("pg"), F.col("line").alias("other")), ["ph", "pg"])
        .filter(F.levenshtein("line", "other", 1) >= 0).select("h", "g").distinct().withColumn("near", F.lit(True))
    )
    return facts.select("doc", "th", "line_no", "h", "g"), distinct.select("h", "g", "first").join(
        near, ["h", "g"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The columns of docs (doc_id and text among them), text without the removed lines, and
    n_lines (with a word), n_equal and n_near (removed), in place of columns of these names."""
    lines, distinct = marked_lines(docs.select("doc_id", "text"), least_chars)
    gone = (
        lines.join(distinct, ["h", "g"])
        .withColumn("equal", (F.col("first.doc") != F.col("doc")) | (F.col("first.line_no") != F.col("line_no"))
                    | (F.col("first.th") != F.col("th")))
        .groupBy("doc", "th").agg(
            F.count_distinct("line_no").alias("n_lines"),
            F.collect_set(F.when(F.col("equal"), F.col("line_no"))).alias("equal_at"),
            F.collect_set(F.when(~F.col("equal") & F.col("near"), F.col("line_no"))).alias("near_at"))
    )
    doc, th, n_lines, equal_at, near_at, removed = unused(docs, "doc", "th", "n_lines", "equal_at", "near_at", "removed")
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), th: F.xxhash64("text")})
    joined = keyed.join(gone.withColumnsRenamed(
        {"doc": doc, "th": th, "n_lines": n_lines, "equal_at": equal_at, "near_at": near_at}), [doc, th], "left")
    at = F.coalesce(F.array_union(equal_at, near_at), F.array().cast("array<int>"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(F.col(removed), k))
    new = {"n_lines": F.coalesce(n_lines, F.lit(0)), "n_equal": F.coalesce(F.size(equal_at), F.lit(0)),
           "n_near": F.coalesce(F.size(near_at), F.lit(0))}
    return joined.withColumn(removed, at).withColumn("text", F.array_join(kept, "\n")).select(
        *(name for name in docs.columns if name not in new), *(value.cast("long").alias(name) for name, value in new.items()))
