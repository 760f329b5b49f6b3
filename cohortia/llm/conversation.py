"""Conversation repair: the cheapest edits that give a lawful order of roles, by a DP over shared edit prefixes.

1. Equal rows of a conversation are counted, so copies never meet as rows. The rest is range
   sorted by conversation and turn and stored with positions; whether role and text were seen
   earlier comes from the least position of each text.
2. Chunks of CHUNK rows, of one conversation or of many, are solved on their own: for every state that
   the order of roles can be in before the chunk, the least cost of each state behind it. A path
   is a node that links to its prefix, with ancestors at powers of two and rolling hashes; of paths that
   cost the same the ASCII-least stays, found where their longest common prefix ends. Equal
   hashes of different nodes are verified by walking up to the node that both share.
3. Conversations that cross chunks choose their states from costs and ranks alone. Every chunk
   ends with the edit of a row (what is inserted belongs to what follows), so of two paths over the same rows neither
   is the other's beginning and their ranks in the chunk decide between whole audits.
4. Repaired turns are read off in order, one row at a time, whatever the length of a conversation.

Rows are (conv_id, turn, role, text); other columns take no part. Order: turn, nulls first, then
role and text. Results for odd input: nulls of role and text are one space; a null conv_id is a conversation of its own;
repeated rows are duplicates of the first; empty texts are blank; texts of any length are looked at by
Spark only and pass through tasks as a stream; no rows give no conversations. A row with ``copies`` 0 (where
the caller names such a column) only says that the conversation exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.session import stored

CHUNK = 8192  # rows that one task solves at once
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5  # costs; CUT: of a truncated row that stays

# States of the order of roles s?(ua)+ or nothing: at the start, behind s, behind u, behind a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
FULL = {"u": "user", "a": "assistant"}
TALLIES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Prefixes:
    """Strings as nodes that share their beginnings."""

    def __init__(self, base: int = 1_000_003, modulus: int = (1 << 61) - 1):
        self.base, self.modulus = base, modulus
        self.op, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def grown(self, node: int, op: str) -> int:
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.op.append(op)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(op)) % self.modulus)
        self.up.append(tuple(up))
        return len(self.op) - 1

    def lifted(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _verified(self, x: int, y: int) -> tuple[int, int] | None:
        """Where two nodes of one depth and hash differ after all, first from the beginning."""
        found = None
        while x != y:
            if self.op[x] != self.op[y]:
                found = x, y
            x, y = self.up[x][0], self.up[y][0]
        return found

    def parting(self, a: int, b: int) -> tuple[int, int] | None:
        """The nodes behind the longest common prefix; None if one string begins the other."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, depth), self.lifted(b, depth)
        if x == y or self.hash[x] == self.hash[y]:
            return self._verified(x, y)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]):
                u, v = self.up[x][k], self.up[y][k]
                if u != v and self.hash[u] != self.hash[v]:
                    x, y = u, v
        return self._verified(self.up[x][0], self.up[y][0]) or (x, y)

    def compared(self, a: int, b: int) -> int:
        """Below 0 if a's string is ASCII-less than b's."""
        nodes = self.parting(a, b)
        if nodes is None:
            return self.depth[a] - self.depth[b]
        return -1 if self.op[nodes[0]] < self.op[nodes[1]] else 1

    def text(self, node: int) -> str:
        ops = []
        while node:
            ops.append(self.op[node])
            node = self.up[node][0]
        return "".join(reversed(ops))


class _Best:
    """Least cost, then ASCII-least path, of each state."""

    def __init__(self, prefixes: Prefixes):
        self.prefixes, self.held = prefixes, {}

    def offer(self, state: int, cost: int, node: int, op: str) -> None:
        """op: what follows the path to node."""
        old = self.held.get(state)
        if old and cost > old[0]:
            return
        new = [cost, node, op]
        if old and cost == old[0] and self.prefixes.compared(self._grown(old), self._grown(new)) < 0:
            return
        self.held[state] = new

    def _grown(self, entry: list) -> int:
        if entry[2]:
            entry[1:] = self.prefixes.grown(entry[1], entry[2]), ""
        return entry[1]

    def paths(self) -> dict[int, tuple[int, int]]:
        return {state: (entry[0], self._grown(entry)) for state, entry in self.held.items()}


def solved(rows: list[tuple[str, bool, bool, int]], start: int, prefixes: Prefixes) -> dict[int, tuple[int, int]]:
    """Cost and path to each state behind the rows (initial, to be deleted, truncated, copies).

    Copies behind the first are deleted in any path, so they only add to its cost.
    """
    best = {start: (0, 0)}
    for initial, doomed, cut, copies in rows:
        if not copies:
            continue
        after = _Best(prefixes)
        rest = DELETE * (copies - 1)
        for state, (cost, node) in best.items():  # an insertion is ASCII-less behind a deletion than before it
            after.offer(state, cost + DELETE + rest, node, "D")
        if not doomed:
            rest += CUT * cut
            for state, (cost, node) in _inserted(best, prefixes).items():
                kept = NEXT.get((state, initial))
                if kept is not None:
                    after.offer(kept, cost + rest, node, "K")
                for role in FULL:
                    if role != initial and (state, role) in NEXT:
                        after.offer(NEXT[state, role], cost + REROLE + rest, node, "R")
        best = after.paths()
    return best


def _inserted(best: dict[int, tuple[int, int]], prefixes: Prefixes) -> dict[int, tuple[int, int]]:
    """Paths with up to two insertions behind them; a third would lead back to a state at a higher cost."""
    for _ in range(2):
        wider = _Best(prefixes)
        for state, (cost, node) in best.items():
            wider.offer(state, cost, node, "")
        for state, (cost, node) in best.items():
            for role in FULL:
                if (state, role) in NEXT:
                    wider.offer(NEXT[state, role], cost + INSERT, node, "I")
        best = wider.paths()
    return best


def spelled(ops: str, rows: list[tuple[str, bool, bool, int]]) -> str:
    """The audit of a path: the deletions of copies behind the edits of their first rows."""
    copies = iter([n for *_, n in rows if n])
    return "".join(op if op == "I" else op + "D" * (next(copies) - 1) for op in ops)


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())),
    ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first_role", pa.string()), ("last_role", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])


def _piece(rows: list[dict], starts: tuple[int, ...]) -> dict:
    """Of the rows of one conversation in a chunk: all ways through, and what the tallies need."""
    out = {name: 0 for name in ("blank", "duplicate", "truncated", "illegal", "turns")} | {
        "conv_id": rows[0]["conv_id"], "at": rows[0]["at"], "first_role": None, "last_role": None, "low": None, "high": None}
    steps = []
    for row in rows:
        n = row["copies"]
        if not n:
            continue
        fresh = not row["blank"] and not row["seen"]
        out["blank"] += n if row["blank"] else 0
        out["duplicate"] += 0 if row["blank"] else n - 1 if fresh else n
        out["truncated"] += fresh and row["cut"]
        steps.append((row["initial"], not fresh, fresh and row["cut"], n))
        if out["last_role"] is not None:
            out["illegal"] += out["last_role"] + row["initial"] not in ("su", "ua", "au")
        else:
            out["first_role"] = row["initial"]
        out["illegal"] += n - 1
        out["last_role"] = row["initial"]
        if row["turn"] is not None:
            out["turns"] += row["turn"] != out["high"]
            out["low"] = row["turn"] if out["low"] is None else out["low"]
            out["high"] = row["turn"]
    prefixes, ways = Prefixes(), []
    for start in starts:
        paths = solved(steps, start, prefixes)
        order = sorted(paths, key=cmp_to_key(lambda a, b: prefixes.compared(paths[a][1], paths[b][1])))
        ways += [(start, end, paths[end][0], rank, spelled(prefixes.text(paths[end][1]), steps)) for rank, end in enumerate(order)]
    return out | dict(zip(("start", "end", "cost", "rank", "audit"), map(list, zip(*ways))))


def _pieces(table: pa.Table) -> pa.Table:
    rows = table.sort_by("at").to_pylist()
    edges = [0, *(k for k in range(1, len(rows)) if rows[k]["conv_id"] != rows[k - 1]["conv_id"]), len(rows)]
    # Only the first conversation of a chunk can have begun in an earlier one.
    every = (START, SYSTEM, USER, ASSISTANT)
    return pa.Table.from_pylist([
        _piece(rows[a:b], every if a == 0 else (START,)) for a, b in zip(edges, edges[1:])], _PIECE)


def _runs(rows: Iterator[dict]) -> Iterator[list[dict]]:
    run: list[dict] = []
    for row in rows:
        if run and row["conv_id"] != run[0]["conv_id"]:
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            yield from batch.slice(begin, 500).to_pylist()


_CHOICE = pa.schema([("at", pa.int64()), ("way", pa.int64()), ("state", pa.int64()), *((x, pa.int64()) for x in TALLIES)])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way through each piece, and on a conversation's first piece its tallies."""

    def chosen() -> Iterator[dict]:
        for run in _runs(_rows(batches)):
            togo = {state: cost for state, (cost, _) in ENDS.items()}
            ahead = [togo]
            for piece in reversed(run):
                ways = [(s, c + togo[e]) for s, e, c in zip(piece["start"], piece["end"], piece["cost"]) if e in togo]
                togo = {s: min(c for t, c in ways if t == s) for s, _ in ways}
                ahead.append(togo)
            ahead.reverse()
            tally = {"cost": ahead[0][START], "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0}
            low = high = last = None
            turns, state, out = 0, START, []
            for piece, togo in zip(run, ahead[1:]):
                way = min((c + togo[e], r, k) for k, (s, e, c, r) in enumerate(
                    zip(piece["start"], piece["end"], piece["cost"], piece["rank"])) if s == state and e in togo)[2]
                out.append({"at": piece["at"], "way": way, "state": state})
                state = piece["end"][way]
                for name in ("illegal", "blank", "duplicate", "truncated"):
                    tally[name] += piece[name]
                if piece["first_role"] is not None:
                    tally["illegal"] += last is not None and last + piece["first_role"] not in ("su", "ua", "au")
                    last = piece["last_role"]
                if piece["low"] is not None:
                    turns += piece["turns"] - (piece["low"] == high)
                    low = piece["low"] if low is None else low
                    high = piece["high"]
            out[0] |= tally | {"gaps": 0 if low is None else high - low + 1 - turns}
            yield from out

    yield from _batched(chosen(), _CHOICE)


def _ordered(rows: DataFrame, copies: Column) -> DataFrame:
    """The distinct rows with their copies, in order: at is the position (chunks of a partition are neighbours)."""
    own = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
           *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")), copies.cast("long").alias("copies")]
    there = F.col("copies") > 0
    counted = rows.select(*own).select("conv_id", *(F.when(there, F.col(x)).alias(x) for x in ("turn", "role", "text")), "copies").groupBy(
        "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ordered = counted.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    return stored(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")


def _solutions(ordered: DataFrame, chunk: int) -> DataFrame:
    """conv_id, at, state, audit, and on a conversation's first piece its tallies."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    slim = stored(ordered.select(
        "conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), "copies", (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"), F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256).alias("said")), "looks")
    firsts = slim.filter("copies > 0 AND NOT blank").groupBy("conv_id", "said").agg(
        F.min("at").alias("first"), F.count("*").alias("k")).filter("k > 1").select(
        F.col("conv_id").alias("own"), F.col("said").alias("its"), "first")
    looked = slim.join(firsts, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("said") == F.col("its")), "left").select(
        "conv_id", "at", "turn", "initial", "copies", "blank", "cut", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("seen"),
        F.expr(f"at div {chunk}").alias("chunk"))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    pieces = stored(looked.groupBy("chunk").applyInArrow(
        _pieces, ", ".join(f"{f.name} {kinds[f.type]}" for f in _PIECE)), "pieces")
    ways = pieces.drop("audit").repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(
        _choices, ", ".join(f"{f.name} long" for f in _CHOICE))
    return pieces.select("conv_id", "at", "audit").join(ways, "at").select(
        "conv_id", "at", "state", F.get("audit", F.col("way").cast("int")).alias("audit"), *TALLIES)


def _in_order(rows: DataFrame, copies: Column, chunk: int) -> DataFrame:
    """Each piece's solution before its rows, conversations whole and in order within a partition."""
    ordered = _ordered(rows, copies)
    solutions = _solutions(ordered, chunk)
    turns = ordered.filter("copies > 0").select("conv_id", "at", F.lit(1).alias("kind"), "role", "text", "copies")
    return solutions.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True).repartition(
        "conv_id").sortWithinPartitions("conv_id", "at", "kind")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict]]:
    """("conversation", its tallies), ("turn", ...) of what it is after the edits, ("edits", ...) of a piece."""
    began, conv, state, edits = False, None, START, iter("")

    def put(initial: str, role: str, text: str) -> tuple[str, dict]:
        nonlocal state
        state = NEXT[state, initial]
        return "turn", {"conv_id": conv, "role": role, "text": text}

    def inserted() -> tuple[str, dict]:
        initial = next(x for x in FULL if (state, x) in NEXT)
        return put(initial, FULL[initial], "")

    def ended() -> Iterator[tuple[str, dict]]:
        if began and ENDS[state][1]:
            yield "edits", {"audit": ENDS[state][1]}
            for _ in ENDS[state][1]:
                yield inserted()

    for row in _rows(batches):
        if row["kind"] == 0:
            if not began or row["cost"] is not None:  # the first piece of a conversation
                yield from ended()
                began, conv, state = True, row["conv_id"], START
                yield "conversation", row
            edits = iter(row["audit"])
            yield "edits", row
            continue
        op = next(edits)
        while op == "I":
            yield inserted()
            op = next(edits)
        if op == "K":
            yield put(row["role"][:1], row["role"], row["text"])
        elif op == "R":
            initial = next(x for x in FULL if (state, x) in NEXT)
            yield put(initial, FULL[initial], row["text"])
        for _ in range(row["copies"] - 1):
            next(edits)
    yield from ended()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def numbered() -> Iterator[dict]:
        place = 0
        for kind, row in _repaired(batches):
            if kind == "conversation":
                place = 0
            elif kind == "turn":
                yield row | {"turn": place}
                place += 1

    yield from _batched(numbered(), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]), 500)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in TALLIES), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def summed() -> Iterator[dict]:
        out, audit, digest, turns = None, [], hashlib.sha256(), 0
        for kind, row in _repaired(batches):
            if kind == "conversation":
                if out:
                    yield out | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                out, audit, digest, turns = {x: row[x] for x in ("conv_id", *TALLIES)}, [], hashlib.sha256(), 0
            elif kind == "edits":
                audit.append(row["audit"])
            else:
                digest.update(f"{chr(10) if turns else ''}{row['role']}:{row['text']}".encode("utf-8", "surrogatepass"))
                turns += 1
        if out:
            yield out | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _batched(summed(), schema)


def repaired(rows: DataFrame, copies: Column | None = None, *, chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn (from 0), role, text: the conversations after their cheapest edits."""
    return _in_order(rows, F.lit(1) if copies is None else copies, chunk).mapInArrow(
        _turns, "conv_id long, turn long, role string, text string")


def audited(rows: DataFrame, copies: Column | None = None, *, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation: faults found, cost and audit of its cheapest edits, SHA-256 of the repaired one.

    The digest is a chain over the turns, so the turns of a conversation pass through one task; they
    pass as a stream, and what is solved before it is solved in chunks.
    """
    return _in_order(rows, F.lit(1) if copies is None else copies, chunk).mapInArrow(
        _digests, "conv_id long, " + ", ".join(f"{x} long" for x in TALLIES) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with faults put in by the CRC-32 of conv_id:turn, and the column with their copies."""
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))
    text, kind = F.coalesce("text", F.lit(" ")), F.crc32(key.cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies")), F.col("copies")
