"""Web archives: written by Spark's text writer, read back by verifying the chain of record borders.

Writing: a record's head, an HTTP head and the payload are one text row, and the row
separator is the empty line that ends a record, so tasks write valid archives in
parallel and Spark's commit protocol covers lost executors. A payload that other
pages share is written once (with the largest page_id); the others are ``revisit``
records that refer to it.

Reading: the record magic is the row separator, so every task sees the pieces between
two magics of its part of a file, whether a magic starts a record or stands inside a
payload. A piece with a sound head is a candidate with an offset and a successor
offset (head + Content-Length + separator). A file's bytes are cut into zones of
``zone_bytes``, whatever parts Spark reads it in (a gzip file is one), so no task holds more
than a zone's borders. Chains inside a zone are shortened to where they leave it; pointer
jumping over the zones then finds where the chain that starts at the file's first byte
enters each of them, and only records on that chain are kept. Payloads that hold magics are put together again from their pieces.

Results for odd input: null html counts as empty; all pages with equal payloads of at
least ``revisit_bytes`` bytes but that with the largest id are revisits, rows that repeat
this id are responses too; null ids are the least, a revisit of a null id has null
``refers_to``. Line ends in a url are dropped from the head. Empty tables give no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortia.session import stored

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + GAP
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 20_000
ZONE_BYTES = 1 << 20  # of an unpacked file

_HEAD = "head long, content long, record_type string, page_id long, refers_to long, url string, digest string"
_FOUND = f"file string, block long, rel long, size long, {_HEAD}, payload_bytes long, payload_digest string, payload binary"


def base32_of(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: four letters for every five digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        bits = F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(letters, F.shiftright(bits, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def records(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """One record text for every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_of(F.sha1("html"))).withColumn("bytes", F.octet_length("html"))
    # One short row for each payload that several pages share, counted before the shuffle. Written, so that
    # Spark sees its size: where it is small, the payloads are not shuffled at all.
    shared = stored(rows.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(
        F.max("page_id").alias("first_id"), F.count("*").alias("pages")).filter("pages > 1"), "shared-payloads")
    rows = rows.join(shared, "digest", "left")
    response = F.col("pages").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    urn = lambda name: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(name).cast("string"), F.lit("null")), F.lit(">"))
    shared = F.concat(
        line("WARC-Record-ID", urn("page_id")),
        F.coalesce(line("WARC-Target-URI", F.translate("url", "\r\n", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", "application/http; msgtype=response"))
    full = F.concat(F.lit(MAGIC), line("WARC-Type", "response"), shared,
                    line("Content-Length", (F.col("bytes") + len(HTTP)).cast("string")),
                    F.lit("\r\n" + HTTP), F.col("html"))
    short = F.concat(F.lit(MAGIC), line("WARC-Type", "revisit"), shared, line("WARC-Profile", PROFILE),
                     line("WARC-Refers-To", urn("first_id")),
                     line("Content-Length", str(len(HTTP))), F.lit("\r\n" + HTTP))
    return rows.select(F.when(response, full).otherwise(short).alias("record"))


def write(pages: DataFrame, path: str, *, revisit_bytes: int = 0, compression: str = "gzip",
          records_per_file: int = RECORDS_PER_FILE) -> None:
    (records(pages, revisit_bytes).write.option("lineSep", GAP).option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(path))


def _parsed(piece: bytes) -> dict | None:
    """Fields of a record head, or None where a magic is followed by none."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in piece[:end].split(b"\r\n"):
        name, colon, value = row.partition(b": ")
        if not colon:
            return None
        fields[name.lower()] = value.decode("utf-8", "replace")
    length, kind = fields.get(b"content-length", ""), fields.get(b"warc-type")
    if not (length.isascii() and length.isdigit()) or not kind or len(length) > 18:
        return None

    def page(name: bytes) -> int | None:
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value.lstrip("-").isdigit() and value.isascii() else None

    return {"head": end + 4, "content": int(length), "record_type": kind, "page_id": page(b"warc-record-id"),
            "refers_to": page(b"warc-refers-to"), "url": fields.get(b"warc-target-uri"),
            "digest": fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None}


def _payload_facts(block: bytes, keep: bool) -> dict:
    payload = block.partition(b"\r\n\r\n")[2]
    return {"payload_bytes": len(payload), "payload": payload if keep else None,
            "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """Pieces with the place of their magic, from where the part's first piece begins, and their size."""
    part, at = None, 0
    for batch in batches:
        for file, block, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (file, block) != part:
                part, at = (file, block), 0
                if block == 0:  # what stands before the first magic of a file
                    at += len(piece)
                    continue
            yield file, block, at, len(MAGIC) + len(piece), piece
            at += len(MAGIC) + len(piece)


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ARROW = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("head", pa.int64()),
    ("content", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
    ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary())])


def candidates(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Every piece behind a magic; ``head`` is null where no record head follows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for file, block, rel, size, piece in _placed(batches):
            row = {"file": file, "block": block, "rel": rel, "size": size} | (fields := _parsed(piece) or {})
            if fields and len(piece) == fields["head"] + fields["content"] + len(GAP):  # whole in one piece
                row |= _payload_facts(piece[fields["head"]:-len(GAP)], keep_payload)
            rows.append(row)
            if len(rows) >= 2000:
                yield _table(rows, _ARROW)
                rows = []
        yield _table(rows, _ARROW)

    return _pieces(spark, path).mapInArrow(found, _FOUND)


def _exits(table: pa.Table) -> pa.Table:
    """Where the chain from each candidate of a zone leaves it; candidates of one zone only."""
    table = table.sort_by("offset")
    offsets, after = table.column("offset").to_pylist(), table.column("after").to_pylist()
    leaves: dict[int, int] = {}
    for offset, successor in zip(reversed(offsets), reversed(after)):
        leaves[offset] = leaves.get(successor, successor)
    return pa.table({"file": table.column("file"), "offset": table.column("offset"),
                     "leaves": pa.array([leaves[x] for x in offsets], pa.int64())})


def _walked(key: tuple, pieces: pa.Table, entries: pa.Table) -> pa.Table:
    """Pieces of a zone with the record of the chain that each belongs to, if it starts here."""
    pieces = pieces.sort_by("offset")
    at = min(entries.column("entry").to_pylist(), default=None)
    owner, current = [], None
    for offset, after in zip(pieces.column("offset").to_pylist(), pieces.column("after").to_pylist()):
        if at is not None and offset == at and after is not None:
            current, at = offset, after
        owner.append(current)
    return pieces.select(["file", "zone", "block", "rel", "offset", "after", "size"]).append_column(
        "owner", pa.array(owner, pa.int64()))


def verified(found: DataFrame, zone_bytes: int = ZONE_BYTES) -> DataFrame:
    """The pieces of ``found`` (file, zone, block, rel, offset, after, size) with ``owner``, their record's offset.

    ``owner`` is null in front of a file's first sound record.
    """
    part = ["file", "block"]
    starts = found.groupBy(part).agg(F.sum("size").alias("bytes")).withColumn(
        "start", F.coalesce(F.sum("bytes").over(
            Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offset = F.col("start") + F.col("rel")
    pieces = stored(found.select(*part, "rel", "size", "head", "content").join(starts, part).select(
        *part, "rel", "size", offset.alias("offset"), F.floor(offset / zone_bytes).cast("long").alias("zone"),
        (F.col("start") + F.col("rel") + len(MAGIC) + F.col("head") + F.col("content") + len(GAP)).alias("after")),
        "warc-pieces")
    zones = (pieces.agg(F.max("zone")).collect()[0][0] or 0) + 1  # of the largest file
    zone = ["file", "zone"]
    chains = stored(pieces.filter("after IS NOT NULL").select(*zone, "offset", "after").groupBy(zone).applyInArrow(
        _exits, "file string, offset long, leaves long"), "warc-exits")
    reached = chains.filter("offset = 0").select("file", "offset")
    # Only where a chain can enter a zone: targets of some chain.
    jumps = chains.join(chains.select("file", F.col("leaves").alias("offset")).distinct(), ["file", "offset"], "left_semi")
    jumps = jumps.unionByName(chains.filter("offset = 0")).distinct()
    for step in range((zones - 1).bit_length()):  # 2^rounds zones at least
        to = jumps.select("file", "offset", "leaves")
        reached = stored(reached.unionByName(
            reached.join(to, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))).distinct(),
            f"warc-reached-{step}")
        jumps = stored(to.alias("a").join(
            to.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("next")), ["file", "leaves"], "left")
            .select("file", "offset", F.coalesce("next", "leaves").alias("leaves")), f"warc-jumps-{step}")
    entries = reached.join(pieces.select(*zone, "offset"), ["file", "offset"]).select(
        F.col("file").alias("in_file"), F.col("zone").alias("in_zone"), F.col("offset").alias("entry"))
    return pieces.groupBy(zone).cogroup(entries.groupBy("in_file", "in_zone")).applyInArrow(
        _walked, "file string, zone long, block long, rel long, offset long, after long, size long, owner long")


def read(spark: SparkSession, path: str, keep_payload: bool = False, zone_bytes: int = ZONE_BYTES) -> DataFrame:
    """The records of the archives below a path: page_id, record_type, refers_to, url, payload_bytes,
    payload_digest (of the payload as found), intact (it agrees with the head), payload if asked for."""
    found = stored(candidates(spark, path, keep_payload), "warc-found")
    pieces = stored(verified(found, zone_bytes), "warc-verified")
    # The last record of a zone may reach into the next ones.
    zones = pieces.groupBy("file", "zone").agg(F.max("owner").alias("last"))
    before = F.last("last", ignorenulls=True).over(
        Window.partitionBy("file").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.join(zones.select("file", "zone", before.alias("before")), ["file", "zone"]).withColumn(
        "owner", F.coalesce("owner", "before")).drop("before").filter("owner IS NOT NULL")
    kept = pieces.filter("owner = offset").select("file", "block", "rel", "offset").join(found, ["file", "block", "rel"])
    whole = kept.filter("payload_digest IS NOT NULL").drop("offset", "rel", "block", "size", "file")
    broken = stored(kept.filter("payload_digest IS NULL").select("file", F.col("offset").alias("owner"), "head", "content",
                                                                 *[x.split()[0] for x in _HEAD.split(", ")[2:]]), "warc-broken")
    # Pieces of payloads with magics inside; only the parts that hold any are read again.
    wanted = stored(pieces.join(broken.select("file", "owner"), ["file", "owner"]).select(
        "file", "block", "rel", "owner", "offset"), "warc-wanted")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, rel, _, piece in _placed(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "rel": rel, "piece": piece}])

    def joined(table: pa.Table) -> pa.Table:
        rows = table.sort_by("offset").to_pylist()
        data = MAGIC.encode().join(row["piece"] for row in rows)
        first = rows[0]
        block = data[first["head"]:first["head"] + first["content"]]
        row = {x: first[x] for x in _ARROW.names[4:11]} | _payload_facts(block, keep_payload)
        return pa.Table.from_pylist([row], pa.schema(list(_ARROW)[4:]))

    raw = _pieces(spark, path).join(wanted.select("file", "block").distinct(), ["file", "block"], "left_semi")
    mended = (
        raw.mapInArrow(again, "file string, block long, rel long, piece binary")
        .join(wanted, ["file", "block", "rel"]).join(broken, ["file", "owner"])
        .groupBy("file", "owner").applyInArrow(joined, f"{_HEAD}, payload_bytes long, payload_digest string, payload binary")
    )
    rows = whole.unionByName(mended)
    # A revisit has its payload in the response of the same digest.
    origin = rows.filter("record_type = 'response'").groupBy("digest").agg(
        F.max("payload_bytes").alias("origin_bytes"), F.max("payload_digest").alias("origin_digest"))
    revisit = F.col("record_type") == "revisit"
    out = rows.filter(~revisit).withColumns({"origin_bytes": F.col("payload_bytes"), "origin_digest": F.col("payload_digest")})
    out = out.unionByName(rows.filter(revisit).join(origin, "digest", "left"))
    return out.select("page_id", "record_type", "refers_to", "url", F.col("origin_bytes").alias("payload_bytes"),
                      F.col("origin_digest").alias("payload_digest"),
                      F.col("digest").eqNullSafe(F.col("origin_digest")).alias("intact"),
                      *(["payload"] if keep_payload else []))
