"""Conversation structure repair: the cheapest edits that make a dialogue well formed.

Rows are damaged by a hash of their place (op11's contract), then repaired so that the roles read
`(s?(ua)+)?`. Edits are deductions over items (rows read, state of the grammar): from an item and
the next row, keep, rerole and delete give the item one row on; insert gives another state of the
same row. Knuth's lightest-derivation agenda pops the least (cost, audit) first; every deduction
adds to both, so it is superior, and an item is final when it is popped. Two audits of one item
and cost are never each other's beginning (each further insert costs), so extending both keeps
their order, and the first derivation of the goal is the cheapest with the least audit.

A conversation may hold any share of the rows. Rows are sorted by range and cut into blocks; one
that lies inside a partition in one block is repaired there. Other blocks derive their items from
each of the four states, conversations are put together from these small tables, block by block,
and the chosen edits go back to the blocks, which write the repaired lines; only the digest reads
them in sequence, chunk by chunk. Rows that are alike are counted before they are shuffled. What a
task holds of a conversation is its audit, which is one value of the result.

Null ids, turns, roles and texts count as one space; rows of one turn are ordered by role, then by
a digest of role and text. Repeated rows are duplicates of the first. A row whose role has another
initial than s, u and a can't be kept. Texts of any length are kept whole. Other columns are
dropped, whatever their names. A conversation without rows left has zeros; an empty table none.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, saved, small_batches
from .ordered import by_range, hash_chunks

#: White space, ends of sentences, and what edits cost.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the grammar, the states each initial leads to, and those in which a dialogue may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Rows and bytes after which a block ends.
ROWS, BYTES = 1000, 4 << 20


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations as damaged: conv, has_turn, turn, role, text, copies (0: dropped)."""

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(filled("text"), ENDS, "")).otherwise(filled("text"))
    return turns.select(
        filled("conv_id").alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.when(code == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Rows that are alike as one with `n`, whether the `first` of them is the first of its role and text, `blank` and `cut` (no end of a sentence)."""
    place = ["conv", "has_turn", "turn", "same"]
    rows = rows.withColumn("same", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    counted = rows.groupBy(*place).agg(F.sum("copies").alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
    at = F.min(F.struct("has_turn", "turn")).alias("at")
    firsts = rows.where("copies > 0").groupBy("conv", "same").agg(at).select("conv", "at.has_turn", "at.turn", "same", F.lit(True).alias("first"))
    end = F.rtrim("text", F.lit(BLANKS))
    joined = counted.join(firsts, place, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return joined.withColumn("blank", end == "").withColumn("cut", ~F.right(end, F.lit(1)).isin(*ENDS))


def derive(rows: list[tuple[str, bool, int, int]], start: int, goals: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of each state that can be reached behind the rows; with goals, of the first of them only.

    A row is (initial, must go, how many, cost of leaving it).
    """
    agenda, final, out = [(0, "", 0, start)], set(), {}

    def deduce(cost: int, audit: str, i: int, state: int | None) -> None:
        if state is not None and (i, state) not in final:
            heapq.heappush(agenda, (cost, audit, i, state))

    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        spoken = ASSISTANT if state == USER else USER
        if i == len(rows):
            out[state] = (cost, audit)
            if goals and state in goals:
                return {state: (cost, audit)}
        else:
            initial, gone, n, left = rows[i]
            deduce(cost + DELETE * n, audit + "D" * n, i + 1, state)
            if not gone:
                deduce(cost + left, audit + "K", i + 1, NEXT.get((state, initial)))
                deduce(cost + REROLE + left, audit + "R", i + 1, spoken)
        deduce(cost + INSERT, audit + "I", i, spoken)
    return out


def lines(rows: list[tuple[str, str, int]], audit: str, state: int) -> list[str]:
    """The repaired `role:text` of rows (role, text, how many), by their audit."""
    source, out = itertools.chain.from_iterable(itertools.repeat((role, text), n) for role, text, n in rows), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state, role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = NAMES[state]
        out.append(f"{role}:{text}")
    return out


class Block:
    """Consecutive rows of a conversation, and what is counted over them."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int]] = []
        self.edits: list[tuple[str, bool, int, int]] = []
        self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.head = self.tail = None

    def add(self, has_turn: bool, turn: int, role: str, text: str, n: int, first: bool, blank: bool, cut: bool) -> None:
        if not n:
            return
        initial = role[:1]
        self.rows.append((role, text, n))
        self.bytes += len(text)
        if blank or not first:
            self.edits.append((initial, True, n, 0))
            self.blank, self.duplicate = self.blank + n * blank, self.duplicate + n * (not blank)
        else:
            self.edits.append((initial, False, 1, CUT * cut))
            self.edits += [(initial, True, n - 1, 0)] if n > 1 else []
            self.duplicate, self.truncated = self.duplicate + n - 1, self.truncated + cut
        self.illegal += (self.tail is not None and self.tail + initial not in ("su", "ua", "au")) + n - 1
        self.head, self.tail = initial if self.head is None else self.head, initial
        if has_turn:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def counts(self) -> dict:
        return {c: getattr(self, c) for c in COUNTS}


COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "head", "tail")
_COUNTS = pa.struct([(c, pa.string() if c in ("head", "tail") else pa.int64()) for c in COUNTS])
_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_AT = pa.struct([("part", pa.int32()), ("seq", pa.int32())])
_RESULT = [("conv", pa.string()), ("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS[:4]), ("cost", pa.int64()), ("audit", pa.string())]
COUNTS_DDL = "struct<blank: long, duplicate: long, truncated: long, illegal: long, distinct: long, low: long, high: long, head: string, tail: string>"
RESULT_DDL = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
AT_DDL = "struct<part: int, seq: int>"
BLOCK_DDL = f"{RESULT_DDL}, sha256 string, at {AT_DDL}, counts {COUNTS_DDL}, paths array<struct<entry: int, exit: int, cost: long, audit: string>>, rows array<struct<role: string, text: string, n: long>>"
_BLOCK = [*_RESULT, ("sha256", pa.string()), ("at", _AT), ("counts", _COUNTS), ("paths", _PATHS), ("rows", _ROWS)]


def _frame(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def result(conv: str, c: dict, cost: int, audit: str) -> tuple:
    gaps = c["high"] - c["low"] + 1 - c["distinct"] if c["low"] is not None else 0
    return (conv, gaps, *(c[x] for x in COUNTS[:4]), cost, audit)


def closed(conv: str, block: Block) -> tuple:
    cost, audit = next(iter(derive(block.edits, START, ACCEPTING).values()))
    text = "\n".join(lines(block.rows, audit, START))
    return (*result(conv, block.counts(), cost, audit), hashlib.sha256(text.encode()).hexdigest(), None, None, None, None)


def opened(conv: str, block: Block, at: dict) -> tuple:
    paths = [{"entry": q, "exit": r, "cost": cost, "audit": audit} for q in range(4) for r, (cost, audit) in derive(block.edits, q).items()]
    rows = [{"role": role, "text": text, "n": n} for role, text, n in block.rows]
    return (conv, *(None,) * 7, None, at, block.counts(), paths, rows)


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Of conversations inside a partition and a block the repaired result, of others the blocks (see BLOCK_DDL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, whole, current, block = TaskContext.get().partitionId(), 0, False, None, None
        for batch in pieces(batches, "text"):
            out = []
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "has_turn", "turn", "role", "text", "n", "first", "blank", "cut"))):
                ends = block is not None and conv != current
                if ends or (block is not None and (len(block.rows) >= most or block.bytes >= BYTES)):
                    out.append(closed(current, block) if ends and whole else opened(current, block, {"part": part, "seq": seq}))
                    seq, whole, block = seq + 1, ends, None  # the partition's first conversation may have begun before
                if block is None:
                    current, block = conv, Block()
                block.add(*row)
            if out:
                yield _frame(out, _BLOCK)
        if block is not None:
            yield _frame([opened(current, block, {"part": part, "seq": seq})], _BLOCK)

    ranged = by_range(rows.select("conv", "has_turn", "turn", "role", "text", "n", "first", "blank", "cut", "same"), "conv", "has_turn", "turn", "role", "same").drop("same")
    return saved(ranged.mapInArrow(run, BLOCK_DDL))


def put_together(parts: DataFrame) -> DataFrame:
    """Conversations of several blocks: their result, and each block's (at, audit, entry) in `chosen`."""

    def join(a: dict, b: dict) -> dict:
        c = {x: a[x] + b[x] for x in COUNTS[:5]}
        c["illegal"] += a["tail"] is not None and b["head"] is not None and a["tail"] + b["head"] not in ("su", "ua", "au")
        c["distinct"] -= a["high"] is not None and a["high"] == b["low"]
        c["low"], c["high"] = a["low"] if a["low"] is not None else b["low"], b["high"] if b["high"] is not None else a["high"]
        c["head"], c["tail"] = a["head"] if a["head"] is not None else b["head"], b["tail"] if b["tail"] is not None else a["tail"]
        return c

    def finish(conv: str, counts: dict, states: dict, back: list) -> tuple:
        (cost, audit), state = min((v, q) for q, v in states.items() if q in ACCEPTING)
        chosen = []
        for at, steps in reversed(back):
            entry, piece = steps[state]
            chosen.append({"at": at, "entry": entry, "audit": piece})
            state = entry
        return (*result(conv, counts, cost, audit), chosen)

    fields = [*_RESULT, ("chosen", pa.list_(pa.struct([("at", _AT), ("entry", pa.int32()), ("audit", pa.string())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = counts = states = back = None
        for batch in batches:
            out = []
            for c, at, own, paths in zip(*(batch.column(x).to_pylist() for x in ("conv", "at", "counts", "paths"))):
                if back is not None and c != conv:
                    out.append(finish(conv, counts, states, back))
                if back is None or c != conv:
                    conv, counts, states, back = c, None, {START: (0, "")}, []
                counts = own if counts is None else join(counts, own)
                reached, steps = {}, {}
                for p in paths:  # a deduction from the item before the block and the block's own
                    if p["entry"] in states:
                        cost, audit = states[p["entry"]]
                        item = (cost + p["cost"], audit + p["audit"])
                        if p["exit"] not in reached or item < reached[p["exit"]]:
                            reached[p["exit"]], steps[p["exit"]] = item, (p["entry"], p["audit"])
                states = reached
                back.append((at, steps))
            if out:
                yield _frame(out, fields)
        if back is not None:
            yield _frame([finish(conv, counts, states, back)], fields)

    ordered = parts.select("conv", "at", "counts", "paths").repartition("conv").sortWithinPartitions("conv", "at")
    return saved(ordered.mapInArrow(run, f"{RESULT_DDL}, chosen array<struct<at: {AT_DDL}, entry: int, audit: string>>"))


def repaired_chunks(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, at, chunk): the repaired lines of each block that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                conv, at, rows, entry, audit = (batch.column(c)[i].as_py() for c in ("conv", "at", "rows", "entry", "audit"))
                text = lines([(r["role"], r["text"], r["n"]) for r in rows], audit, entry)
                if text:
                    yield _frame([(conv, at, "\n".join(text).encode())], [("conv", pa.string()), ("at", _AT), ("chunk", pa.binary())])

    picked = chosen.select("conv", F.explode("chosen").alias("c")).select("conv", "c.at", "c.entry", "c.audit")
    joined = parts.select("conv", "at", "rows").join(picked, ["conv", "at"])
    return joined.mapInArrow(run, f"conv string, at {AT_DDL}, chunk binary")


def repair(turns: DataFrame, most: int = ROWS) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text), in blocks of at most `most` rows: conv_id, gaps, counts of faults, cost, audit, repaired_sha256."""
    small_batches(turns.sparkSession)
    found = blocks(marked(damaged(turns)), most)
    whole, parts = found.where("at is null"), found.where("at is not null")
    together = put_together(parts)
    hashed = hash_chunks(repaired_chunks(parts, together), "conv", b"\n")
    out = whole.select(*RESULT_COLUMNS, "sha256").unionByName(together.join(hashed, "conv", "left").select(*RESULT_COLUMNS, F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("sha256")))
    conv_id = F.when(F.col("conv") != " ", F.col("conv").try_cast(dict(turns.dtypes)["conv_id"]))
    return out.select(conv_id.alias("conv_id"), *RESULT_COLUMNS[1:], F.col("sha256").alias("repaired_sha256"))


RESULT_COLUMNS = tuple(c.split()[0] for c in RESULT_DDL.split(", "))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
