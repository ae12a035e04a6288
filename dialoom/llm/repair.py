"""Conversation structure repair: a dynamic programme over the turns that stay.

The rows of a conversation are edited until their role initials read
(s?(ua)+)?: a row is kept, reroled to user or assistant, or deleted, and empty
turns are inserted. Between two rows that stay the pair of their roles says how
many turns are inserted, and the deletions cost the difference of two sums of
deletions; so each state needs only the running minimum over the rows that may
come next. Backwards over a conversation this gives the least cost to go after
each row; forwards the first letter in ASCII order that attains it is taken,
since a state and a letter determine the next state.

Both passes are streams over sorted rows: memory does not grow with a
conversation but for its audit, and its rows are spilled by Spark's sort. The
hash of a conversation's repaired text is a sequential thing, so one task reads
each conversation, whatever its share of the table.

Defined results: a null role or text is one space; rows sort by (turn, role,
text), null turns first, so ties and repeated rows have one order; rows with a
null conversation id are one conversation; an empty table gives an empty one.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import in_batches

SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Prices:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: A truncated row that is not deleted.
    truncated: int = 5


#: States: no turn yet, or the role of the last turn that stays.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 60
#: Turns inserted between a state and the next turn that stays.
INSERTS = {
    (NONE, SYSTEM): 0,
    (NONE, USER): 0,
    (NONE, ASSISTANT): 1,
    (SYSTEM, USER): 0,
    (SYSTEM, ASSISTANT): 1,
    (USER, USER): 1,
    (USER, ASSISTANT): 0,
    (ASSISTANT, USER): 0,
    (ASSISTANT, ASSISTANT): 1,
}
#: Turns inserted after the last one that stays.
CLOSING = (0, 2, 1, 0)
#: The role of an inserted turn, by state.
FOLLOWS = (USER, USER, ASSISTANT, USER)

OK, BLANK, DUPLICATE, TRUNCATED = range(4)


def staying(initial: str, fault: int, p: Prices) -> dict[int, int]:
    """What a row costs in each role that it can stay in; empty if it must go."""
    if fault in (BLANK, DUPLICATE):
        return {}
    extra = p.truncated if fault == TRUNCATED else 0
    out = {USER: p.rerole + extra, ASSISTANT: p.rerole + extra}
    if initial in STATE:
        out[STATE[initial]] = extra
    return out


class Gaps:
    """Costs to go from each state, row by row from the last.

    least[q] is the least, over the rows seen that may be the next to stay and
    do so in role q, of the cost from there on less the deletions from that row
    to the end; so the cost to go needs the sum of all deletions once.
    """

    def __init__(self, p: Prices):
        self.p = p
        self.deletions = 0
        self.least = {SYSTEM: _NEVER, USER: _NEVER, ASSISTANT: _NEVER}

    def to_go(self) -> list[int]:
        p, least = self.p, self.least
        out = [p.insert * CLOSING[r] for r in range(4)]
        for (r, q), k in INSERTS.items():
            out[r] = min(out[r], least[q] + p.insert * k)
        return [self.deletions + v for v in out]

    def before(self, cost: dict[int, int], after: list[int]) -> None:
        """Take the row before all rows seen; after is the cost to go behind it."""
        self.deletions += self.p.delete
        for q, c in cost.items():
            self.least[q] = min(self.least[q], c + after[q] - self.deletions)


def edits_of(initial: str, fault: int, state: int, after: list[int], p: Prices) -> Iterator[tuple[str, int]]:
    """The (letter, state then) of the ASCII-least cheapest edits from a state up to and with a row."""
    cost = staying(initial, fault, p)

    def to_go(r):
        return min([p.delete + after[r]] + [p.insert * INSERTS[r, q] + c + after[q] for q, c in cost.items() if (r, q) in INSERTS])

    best = to_go(state)
    while True:
        if p.delete + after[state] == best:
            yield "D", state
            return
        follows = FOLLOWS[state]
        if p.insert + to_go(follows) == best:
            best -= p.insert
            state = follows
            yield "I", state
            continue
        kept = STATE.get(initial)
        if kept is not None and INSERTS.get((state, kept)) == 0 and cost[kept] + after[kept] == best:
            yield "K", kept
        else:
            yield "R", follows
        return


def faults(role: Column, text: Column, earlier: Column) -> Column:
    """A row's first fault; earlier says whether its role and text were seen before."""
    stripped = F.rtrim(text, F.lit(SPACES))
    return (
        F.when(F.length(stripped) == 0, BLANK)
        .when(earlier, DUPLICATE)
        .when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(OK)
        .cast("int")
    )


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, there: Column) -> DataFrame:
    """The rows of each conversation in one partition, with their first fault.

    The rows are shuffled once: the window and both sorts keep to the partition.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        there.alias("there"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", F.xxhash64("text"), F.md5("text"), "there").orderBy(F.asc_nulls_first("turn"))
    return rows.withColumn("fault", faults(F.col("role"), F.col("text"), F.row_number().over(same) > 1))


_FIELDS = "conv_id bigint, turn bigint, role string, text string, there boolean, fault int, v0 bigint, v1 bigint, v2 bigint, v3 bigint"


def priced(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None, prices: Prices = Prices()) -> DataFrame:
    """Each row with the costs to go behind it from each state, in order within its partition.

    Rows that are not there stand for their conversation only.
    """
    rows = _prepared(turns, conv, turn, role, text, F.lit(True) if there is None else there)
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "there", "fault")
    again = F.col("fault") == DUPLICATE  # of equal rows the one that counts comes first
    behind = rows.sortWithinPartitions(F.desc_nulls_last("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), again.desc())

    def run(batches):
        now, gaps = object(), Gaps(prices)
        for b in batches:
            out = []
            col = {n: b.column(n).to_pylist() for n in ("conv_id", "role", "there", "fault")}
            for conv_id, r, here, fault in zip(*col.values(), strict=True):
                if conv_id != now:
                    now, gaps = conv_id, Gaps(prices)
                after = gaps.to_go()
                out.append(after)
                if here:
                    gaps.before(staying(r[:1], fault, prices), after)
            costs = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *costs], [*b.schema.names, "v0", "v1", "v2", "v3"])

    done = in_batches(behind, run, _FIELDS)
    return done.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", again.asc())


@dataclass
class Edit:
    """One letter of an audit; an inserted turn has no row, a deleted one no role of its own."""

    letter: str
    role: str
    text: str
    turn: int | None = None
    fault: int = OK


class Conversation:
    """The edits of one conversation, taken row by row."""

    def __init__(self, conv_id, prices: Prices):
        self.conv_id, self.prices, self.state, self.rows = conv_id, prices, NONE, 0

    def row(self, turn, role: str, text: str, fault: int, after: list[int]) -> Iterator[Edit]:
        self.rows += 1
        for letter, state in edits_of(role[:1], fault, self.state, after, self.prices):
            self.state = state
            if letter == "I":
                yield Edit("I", NAMES[state], "")
            else:
                yield Edit(letter, NAMES[state] if letter == "R" else role, text, turn, fault)

    def end(self) -> Iterator[Edit]:
        for _ in range(CLOSING[self.state]):
            self.state = FOLLOWS[self.state]
            yield Edit("I", NAMES[self.state], "")


def _conversations(batches, prices: Prices) -> Iterator[tuple[str, Conversation, object]]:
    """("row", conversation, (turn, role, fault)), ("edit", conversation, edit) and ("end", conversation, None) in order."""
    now = None
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "there", "fault", "v0", "v1", "v2", "v3")]
        for conv_id, turn, role, text, there, fault, *after in zip(*cols, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield from (("edit", now, e) for e in now.end())
                    yield "end", now, None
                now = Conversation(conv_id, prices)
            if there:
                yield "row", now, (turn, role, fault)
                yield from (("edit", now, e) for e in now.row(turn, role, text, fault, after))
    if now is not None:
        yield from (("edit", now, e) for e in now.end())
        yield "end", now, None


#: Characters of text in one batch of repaired turns.
_OUT_CHARS = 1 << 22
REPAIRED = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())])


def repair(turns: DataFrame, prices: Prices = Prices(), **names) -> DataFrame:
    """Every edit of every conversation: (conv_id, seq, edit, turn, role, text, fault).

    The repaired conversation is what is not deleted (edit other than D), by seq.
    """

    def run(batches):
        out: list[tuple] = []
        size = seq = 0
        for what, c, e in _conversations(batches, prices):
            if what == "end":
                seq = 0
            if what != "edit":
                continue
            out.append((c.conv_id, seq, e.letter, e.turn, e.role, e.text, e.fault))
            seq += 1
            size += len(e.text) + 64
            if size >= _OUT_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), REPAIRED)], schema=REPAIRED)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), REPAIRED)], schema=REPAIRED)

    return in_batches(priced(turns, prices=prices, **names), run, "conv_id bigint, seq bigint, edit string, turn bigint, role string, text string, fault int")


class Digest:
    """The counts and the hash of one conversation, as its rows and edits come."""

    def __init__(self):
        self.turns = self.cost = self.illegal = 0
        self.first = self.last = self.before = None
        self.faults = [0, 0, 0, 0]
        self.audit = bytearray()
        self.sha = hashlib.sha256()
        self.any = False

    def row(self, turn, role: str, fault: int) -> None:
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]

    def edit(self, e: Edit, p: Prices) -> None:
        self.audit += e.letter.encode()
        self.cost += {"I": p.insert, "D": p.delete, "K": 0, "R": p.rerole}[e.letter]
        if e.letter != "D":
            self.cost += p.truncated if e.fault == TRUNCATED else 0
            self.sha.update(("\n" if self.any else "").encode() + f"{e.role}:{e.text}".encode())
            self.any = True

    def values(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


_DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_DIGEST_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _DIGEST.split(", ")])


def repair_digest(turns: DataFrame, prices: Prices = Prices(), there: Column | None = None, **names) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the hash of what they make of it."""

    def run(batches):
        digest, out = Digest(), []
        for what, c, x in _conversations(batches, prices):
            if what == "row":
                digest.row(*x)
            elif what == "edit":
                digest.edit(x, prices)
            else:
                out.append((c.conv_id, *digest.values()))
                digest = Digest()
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _DIGEST_ARROW)], schema=_DIGEST_ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _DIGEST_ARROW)], schema=_DIGEST_ARROW)

    return in_batches(priced(turns, prices=prices, there=there, **names), run, _DIGEST)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults, and there = false for a dropped one, by a checksum of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    r, t = F.coalesce(F.col(role), space), F.coalesce(F.col(text), space)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), kind.alias("kind"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")
