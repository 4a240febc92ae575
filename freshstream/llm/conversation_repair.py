"""Conversation structure repair: a weighted, generalised LR parse.

The roles of a repaired conversation spell ``(s?(ua)+)?``: an optional system
turn, then user and assistant in turns.  ``GRAMMAR`` says the same as rules, and
``lr_tables`` makes its LR automaton.  A parse carries a graph-structured
stack: cells of an LR state and the cell below, shared by all stacks that have them.
Per row the tops may insert an empty turn (any number of times), keep the row,
give it another role or delete it; equal tops become one with the minimum of
(cost, audit).  The audit is the string of edits (K, R, D, I), so ties go to the
ASCII-least one.

Scale: a conversation is not one task's work.  Rows are range-partitioned on
(conversation, turn, role, text hash) and parsed in blocks of ``BLOCK`` rows;
the block that may continue an earlier one is parsed from each of the (six)
stacks it can begin with.  A block's result is a small table "first stack, last
stack -> cost, audit", so conversations are put together from block results,
not rows.  Equal rows of one turn are counted before any shuffle.  Whole texts
move once, to be written out in order (``repaired``); there a conversation is
streamed through one task row by row, as one ordered output has to be.

Defined results
  * Row order: turn (NULL first), role, MD5 of the text; equal rows are copies.
  * NULL role and text count as one space.  A role that is empty or whose first
    character is not s, u or a can only be given another role or be deleted.
  * NULL conversation ids are one conversation.
  * A conversation without rows does not occur; an empty table gives no rows.
  * Texts are compared by MD5, taken as identity.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import written

GRAMMAR = (("C", ""), ("C", "L"), ("L", "sua"), ("L", "ua"), ("L", "Lua"))
INSERTED = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
LEGAL = ("su", "ua", "au")
BLOCK = 256
SPACE = r"\x20\x09-\x0D"


# -- the LR automaton -----------------------------------------------------------

def lr_tables(grammar=GRAMMAR) -> tuple[dict, dict]:
    """(goto, complete): ``goto[state, symbol]`` and ``complete[state]``, the
    rules (left side, length) that end in a state.  Upper-case letters are
    nonterminals, state 0 is the start."""
    def closure(items):
        items = set(items)
        while True:
            wanted = {grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}
            more = {(r, 0) for r, (left, _) in enumerate(grammar) if left in wanted} - items
            if not more:
                return frozenset(items)
            items |= more

    start = closure((r, 0) for r, (left, _) in enumerate(grammar) if left == grammar[0][0])
    states, goto, todo = {start: 0}, {}, [start]
    while todo:
        items = todo.pop()
        for symbol in sorted({grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}):
            after = closure((r, d + 1) for r, d in items if grammar[r][1][d:d + 1] == symbol)
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            goto[states[items], symbol] = states[after]
    complete = {states[items]: [(grammar[r][0], len(grammar[r][1])) for r, d in items if d == len(grammar[r][1])]
                for items in states}
    return goto, complete


GOTO, COMPLETE = lr_tables()
#: States with nothing to shift reduce at once, the others at the end only.
SHIFTS = {state for state, _ in GOTO}


#: A stack is a cell (LR state, cell below); equal cells are one object, so the
#: stacks of a parse form a graph with shared lower parts.
CELLS: dict[tuple, tuple] = {}
MOVES: dict[tuple, list[tuple]] = {}


def cell(state: int, below: tuple | None) -> tuple:
    return CELLS.setdefault((state, below), (state, below))


def shifted(top: tuple, symbol: str) -> list[tuple]:
    """The tops after shifting ``symbol`` on ``top`` and reducing what is complete."""
    if (top, symbol) not in MOVES:
        state, found = GOTO.get((top[0], symbol)), []
        if state is not None:
            found, todo = [], [cell(state, top)]
            while todo:
                new = todo.pop()
                if new[0] in SHIFTS:
                    found.append(new)
                    continue
                for left, length in COMPLETE[new[0]]:
                    base = popped(new, length)
                    todo.append(cell(GOTO[base[0], left], base))
        MOVES[top, symbol] = found
    return MOVES[top, symbol]


def popped(top: tuple, count: int) -> tuple:
    for _ in range(count):
        top = top[1]
    return top


def accepted(top: tuple) -> bool:
    """Does the stack, at the end of input, reduce to the start symbol?"""
    return any(left == GRAMMAR[0][0] and popped(top, length) == ROOT for left, length in COMPLETE[top[0]])


ROOT = cell(0, None)


def merge(tops: dict, top: tuple, weight: tuple) -> bool:
    """Equal tops are one, with the least (cost, audit); did it get less?"""
    if top in tops and tops[top] <= weight:
        return False
    tops[top] = weight
    return True


def with_inserts(tops: dict) -> dict:
    """``tops`` and all that inserted turns lead to."""
    out, todo = dict(tops), list(tops)
    while todo:
        top = todo.pop()
        cost, audit = out[top]
        for symbol in INSERTED:
            todo += [new for new in shifted(top, symbol) if merge(out, new, (cost + INSERT, audit + "I"))]
    return out


def after_row(tops: dict, initial: str, usable: bool, truncated: bool, deleted: int) -> dict:
    """One row that may be used, if ``usable``, then ``deleted`` copies that
    have to go.  Inserts come after deletions (the lesser audit), so
    deletions need no inserts before them."""
    if usable:
        out, extra = {top: (cost + DELETE, audit + "D") for top, (cost, audit) in tops.items()}, TRUNCATED * truncated
        for top, (cost, audit) in with_inserts(tops).items():
            for new in shifted(top, initial):
                merge(out, new, (cost + extra, audit + "K"))
            for symbol in INSERTED:
                for new in shifted(top, symbol):
                    merge(out, new, (cost + REROLE + extra, audit + "R"))
        tops = out
    if deleted:
        tops = {top: (cost + DELETE * deleted, audit + "D" * deleted) for top, (cost, audit) in tops.items()}
    return tops


def states(top: tuple | None) -> tuple:
    """A stack as its LR states from the bottom."""
    return () if top is None else (*states(top[1]), top[0])


def stack_of(numbers: Iterable[int]) -> tuple:
    top = None
    for state in numbers:
        top = cell(state, top)
    return top


def every_stack() -> list[tuple]:
    """All stacks a block can begin with, as states."""
    seen, todo = {ROOT}, [ROOT]
    while todo:
        more = {new for symbol in "sua" for new in shifted(todo[-1], symbol)} - seen
        todo.pop()
        todo += more
        seen |= more
    return sorted(map(states, seen))


# -- blocks and their composition -------------------------------------------------

def parse_block(rows: list[tuple], starts: Iterable[tuple]) -> list[dict]:
    """``rows`` of (initial, blank, duplicate, truncated, copies) from each
    start stack: [{first, last, cost, audit}]."""
    out = []
    for first in starts:
        tops = {stack_of(first): (0, "")}
        for initial, blank, duplicate, truncated, copies in rows:
            usable = not (blank or duplicate)
            tops = after_row(tops, initial, usable, truncated, copies - usable)
        out += [{"first": list(first), "last": list(states(last)), "cost": cost, "audit": audit}
                for last, (cost, audit) in tops.items()]
    return out


def compose(blocks: Iterable[list[dict]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits through all blocks, in order.

    Between blocks stands, per stack, the least cost and the rank of its audit
    among the others (audits of unlike stacks with the same rows never are
    prefixes of each other), so no long audit is compared or copied."""
    now, back = {(0,): (0, 0)}, []
    for block in blocks:
        best: dict[tuple, tuple] = {}
        for way in block:
            first, last = tuple(way["first"]), tuple(way["last"])
            if first in now:
                found = (now[first][0] + way["cost"], now[first][1], way["audit"], first)
                if last not in best or found < best[last]:
                    best[last] = found
        ranks = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values()}))}
        now = {last: (b[0], ranks[b[1:3]]) for last, b in best.items()}
        back.append({last: (b[3], b[2]) for last, b in best.items()})
    ends = []
    for stack, (cost, rank) in now.items():
        for last, (more, tail) in with_inserts({stack_of(stack): (0, "")}).items():
            if accepted(last):
                ends.append((cost + more, rank, tail, stack))
    cost, _, tail, stack = min(ends)
    audit = [tail]
    for ways in reversed(back):
        stack, piece = ways[stack]
        audit.append(piece)
    return cost, "".join(reversed(audit))


# -- on Spark -------------------------------------------------------------------

def conversation_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text (NULL: one space), copies; nothing else."""
    one = F.lit(1).cast("long") if copies is None else copies.cast("long")
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), one.alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn once, with their number, and the first fault each
    has: conv_id, turn, role, hash, blank, truncated, duplicate, copies.
    ``duplicate`` speaks of the first copy; the others always are duplicates."""
    light = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("hash"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"), "copies")
    runs = light.groupBy("conv_id", "turn", "role", "hash", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    runs = written(runs, "turns")                    # read twice below
    first = (runs.where(~F.col("blank")).groupBy("conv_id", "role", "hash")
             .agg(F.min(F.struct("turn")).alias("first"))
             .toDF("first_conv", "first_role", "first_hash", "first"))
    on = (F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("role") == F.col("first_role"))
          & (F.col("hash") == F.col("first_hash")))
    return runs.join(first, on, "left").select(
        "conv_id", "turn", "role", "hash", "blank", "truncated", "copies",
        F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False)).alias("duplicate"))


WAYS = "array<struct<first: array<int>, last: array<int>, cost: bigint, audit: string>>"
COUNTED = ["blank", "duplicate", "truncated", "illegal"]


def blocks(rows: DataFrame) -> DataFrame:
    """Block results, in order of (part, block) within a conversation."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    turn_type = rows.schema["turn"].dataType.simpleString()
    schema = (f"conv_id {conv_type}, part int, block int, turns bigint, min_turn {turn_type}, max_turn {turn_type}, "
              f"blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, ways {WAYS}")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        # only the first conversation of a partition can go on from another one
        everywhere = every_stack()
        held, made, conv, number, opening = [], [], None, 0, True

        def close():
            starts = everywhere if opening or number else [(0,)]
            turns = [r[0] for r in held]
            known = [t for t in turns if t is not None]
            pairs = [a[1] + b[1] for a, b in zip(held, held[1:])]
            usable = [not r[2] and not r[3] for r in held]
            made.append({
                "conv_id": conv, "part": part, "block": number, "turns": len(set(known)),
                "min_turn": known[0] if known else None, "max_turn": known[-1] if known else None,
                "blank": sum(r[5] for r in held if r[2]),
                "duplicate": sum(r[5] - u for r, u in zip(held, usable) if not r[2]),
                "truncated": sum(r[4] for r, u in zip(held, usable) if u),
                "illegal": sum(p not in LEGAL for p in pairs) + sum(r[5] - 1 for r in held),
                "head": held[0][1], "tail": held[-1][1],
                "ways": parse_block([r[1:] for r in held], starts)})

        begun = False
        for b in batches:
            for row in b.to_pylist():
                if begun and (row["conv_id"] != conv or len(held) >= BLOCK):
                    close()
                    held = []
                    if row["conv_id"] != conv:
                        opening, number = False, 0
                    else:
                        number += 1
                begun, conv = True, row["conv_id"]
                held.append((row["turn"], row["role"][:1], row["blank"], row["duplicate"], row["truncated"],
                             row["copies"]))
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made = []
        if held:
            close()
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    order = ["conv_id", "turn", "role", "hash"]
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conversation_rows``: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit."""
    rows = written(judged(rows), "turns-judged")     # range bounds are sampled from it
    parts = blocks(rows)
    schema = (f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps bigint, "
              + ", ".join(f"{c} bigint" for c in COUNTED) + ", cost bigint, audit string")

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(held):
            low = [b["min_turn"] for b in held if b["min_turn"] is not None]
            high = [b["max_turn"] for b in held if b["max_turn"] is not None]
            meet = sum(a["max_turn"] is not None and a["max_turn"] == b["min_turn"] for a, b in zip(held, held[1:]))
            out = {c: sum(b[c] for b in held) for c in COUNTED}
            out["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(held, held[1:]))
            out["gaps"] = high[-1] - low[0] + 1 - (sum(b["turns"] for b in held) - meet) if low else 0
            out["conv_id"] = held[0]["conv_id"]
            out["cost"], out["audit"] = compose(b["ways"] for b in held)
            return out

        held, made = [], []
        for b in batches:
            for row in b.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    made.append(whole(held))
                    held = []
                held.append(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made = []
        if held:
            yield pa.RecordBatch.from_pylist([whole(held)], arrow)

    return (parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, schema))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text, edit (K, R
    or I).  The rows of a conversation are in one partition, in order."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, position bigint, role string, text string, edit string"
    both = (rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("hash"), "text",
                        "copies", F.lit(None).cast("string").alias("audit"))
            .unionByName(edits.select("conv_id", F.lit(0).alias("kind"), "audit"), allowMissingColumns=True))

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ops, at, last, position, out = None, "", 0, "", 0, []

        def put(role, text, edit):
            nonlocal last, position
            out.append({"conv_id": conv, "position": position, "role": role, "text": text, "edit": edit})
            last, position = role[:1], position + 1

        def inserts():
            nonlocal at
            while at < len(ops) and ops[at] == "I":
                put(INSERTED["a" if last == "u" else "u"], "", "I")
                at += 1

        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == 0:
                    inserts()                        # what is left of the conversation before
                    conv, ops, at, last, position = row["conv_id"], row["audit"], 0, "", 0
                    continue
                for _ in range(row["copies"]):
                    inserts()
                    edit, at = ops[at], at + 1
                    if edit != "D":
                        put(row["role"] if edit == "K" else INSERTED["a" if last == "u" else "u"], row["text"], edit)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        inserts()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "hash")
            .mapInArrow(run, schema))


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines joined by newlines,
    streamed over ``repaired`` rows without another shuffle."""
    schema = f"conv_id {lines.schema['conv_id'].dataType.simpleString()}, sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        conv, digest, out = None, None, []
        for b in batches:
            for row in b.to_pylist():
                line = f"{row['role']}:{row['text']}".encode()
                if row["position"]:
                    digest.update(b"\n" + line)
                    continue
                if digest is not None:
                    out.append({"conv_id": conv, "sha256": digest.hexdigest()})
                conv, digest = row["conv_id"], hashlib.sha256(line)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha256": digest.hexdigest()}], arrow)

    return lines.mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage of ``conversation_rows``, by crc32 of
    ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes
    ``.!?``, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, 2 * F.col("copies")).otherwise(F.col("copies")).alias("copies"))
