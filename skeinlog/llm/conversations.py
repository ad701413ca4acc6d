"""Conversation structure repair: the cheapest edits that make the roles alternate, found by a Viterbi pass whose
backpointer tree is cut as soon as its survivors coalesce.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. Rows may
be kept (K, 0), given the role user or assistant (R, 2) or deleted (D, 3; required for blank and duplicate rows), and
empty user or assistant turns may be inserted anywhere (I, 2); a truncated row that is not deleted adds 1. Of equally
cheap lists of edits the one whose letters come first in ASCII wins.

After each row at most one survivor stands for each place in the pattern (nothing yet, system, user, assistant). A node
of the tree is one edit; it counts the edits and survivors that refer to it and goes when none is left. While the root
has one child and no survivor, that child's edit is final: it is emitted and becomes the root. So only edits on which the
survivors still disagree are held, however long the conversation. Survivors that another one can overtake whatever
follows are dropped, which is what makes the others meet. Ties compare whole unresolved suffixes: the survivors are kept
in the order of their letters, which no two share and none of which begins another (each ends with the edit of the same
row), so the order of two extended suffixes follows from the old order and the new letters alone.

Rows of a conversation come in the order of turn (nulls first), then role, then MD5 of the text; equal rows can't be told
apart. Whether a role and text were seen before is an aggregation over all rows, whose result travels to the first such
row as a mark beside it, so no set of seen texts is held. Each conversation is one sorted stream through one task, since
the hash of its repaired text takes its bytes in order; what the task holds is the unresolved rows.

Defined cases: null role and text count as one space, so a null text is blank and a null role must be replaced or
deleted. Null conversation ids form one conversation. Null turns come first and don't count as turns. A conversation
without rows has zeros, an empty audit and the hash of the empty string. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinlog.llm.shared import sliced

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RETYPE, DELETE, INSERT, CUT = 2, 3, 2, 1

#: Places in the pattern, named by the last role, and the role that each one wants next.
START, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What a survivor at the first place pays at most to do whatever one at the second place may still do: inserted turns,
#: or the deletion of a system row that only an empty conversation can begin with. The last column tells whether the
#: letters are then the same apart from the insertions, so that equal costs are decided by the order of the survivors.
OVERTAKES = [
    (START, USER, INSERT, True), (START, ASSISTANT, 2 * INSERT, True), (SYSTEM, USER, INSERT, True),
    (SYSTEM, ASSISTANT, 2 * INSERT, True), (USER, ASSISTANT, INSERT, True), (ASSISTANT, USER, INSERT, True),
    (ASSISTANT, SYSTEM, 0, True), (USER, SYSTEM, INSERT, True), (ASSISTANT, START, DELETE, False), (USER, START, INSERT + DELETE, False),
]


class Edit:
    """A node of the backpointer tree: the edit's letter, the turn it puts out, who refers to it."""

    __slots__ = ("parent", "letter", "turn", "kids", "held")

    def __init__(self, parent: Edit | None, letter: str, turn: tuple[str, str] | None):
        self.parent, self.letter, self.turn, self.kids, self.held = parent, letter, turn, [], 0
        if parent is not None:
            parent.kids.append(self)


class Repair:
    """Takes the rows of one conversation in order and calls ``emit(letter, turn or None)`` for each edit once it is final."""

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]):
        self.emit, self.root = emit, Edit(None, "", None)
        self.root.held = 1
        self.survivors = {START: (0, 0, self.root)}  # place: (cost, order among the survivors, last edit)

    def feed(self, role: str, text: str, deleted: bool, cut: bool) -> None:
        """One row: ``deleted`` if it must go, ``cut`` if it is truncated."""
        best: dict[str, tuple] = {}
        for place, (cost, order, _) in self.survivors.items():
            for inserted in range(3 if place in (START, SYSTEM) else 2):
                wants = NEXT[place]
                ways = [(DELETE, "D", place)]
                if not deleted:
                    if role[:1] == wants or (role[:1] == SYSTEM and place == START):
                        ways.append((cut * CUT, "K", role[:1]))
                    ways.append((RETYPE + cut * CUT, "R", wants))
                for more, letter, to in ways:
                    way = (cost + more, order, "I" * inserted + letter)
                    if to not in best or way < best[to][:3]:
                        best[to] = (*way, to)
                cost, place = cost + INSERT, wants
        kept = [way for way in best.values() if not self._overtaken(way, best)]
        base = {order: (place, node) for place, (_, order, node) in self.survivors.items()}
        made: dict[tuple[int, str], Edit] = {}
        new = {}
        for rank, (cost, order, letters, to) in enumerate(sorted(kept, key=lambda w: (w[1], w[2]))):
            place, node = base[order]
            for k, letter in enumerate(letters):
                at = order, letters[:k + 1], letter if letter != "R" else ROLES[to]
                if letter == "I":
                    place = NEXT[place]
                if at not in made:
                    turn = {"I": (ROLES.get(place, ""), ""), "K": (role, text), "R": (ROLES.get(to, ""), text), "D": None}[letter]
                    made[at] = Edit(node, letter, turn)
                node = made[at]
            node.held += 1
            new[to] = (cost, rank, node)
        old, self.survivors = self.survivors, new
        for _, _, node in old.values():
            self._drop(node)
        self._settle()

    @staticmethod
    def _overtaken(way: tuple, best: dict[str, tuple]) -> bool:
        for by, place, pays, ties in OVERTAKES:
            if place == way[3] and by in best:
                cost = best[by][0] + pays
                if cost < way[0] or ties and cost == way[0] and best[by][1:3] < way[1:3]:
                    return True
        return False

    def _drop(self, node: Edit) -> None:
        node.held -= 1
        while not node.held and not node.kids and node.parent is not None:
            node.parent.kids.remove(node)
            node = node.parent

    def _settle(self) -> None:
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.emit(self.root.letter, self.root.turn)

    def unresolved(self) -> int:
        """Edits held."""
        todo, count = [self.root], -1
        while todo:
            node = todo.pop()
            count += 1
            todo += node.kids
        return count

    def finish(self) -> int:
        """Emits the edits that are left; the cost of all."""
        cost, _, place, node = min((cost + {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[place] * INSERT, order, place, node)
                                   for place, (cost, order, node) in self.survivors.items())
        tail = []
        while node is not self.root:
            tail.append(node)
            node = node.parent
        for edit in reversed(tail):
            self.emit(edit.letter, edit.turn)
        while place in (SYSTEM, USER):
            place = NEXT[place]
            self.emit("I", (ROLES[place], ""))
        return cost


class Report:
    """Faults, audit and hash of one conversation, row by row."""

    def __init__(self, conv=None):
        self.conv, self.audit, self.hash, self.empty = conv, [], sha256(), True
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None
        self.repair = Repair(self.edit)

    def edit(self, letter: str, turn: tuple[str, str] | None) -> None:
        self.audit.append(letter)
        if turn is not None:
            self.hash.update(("" if self.empty else "\n").encode() + f"{turn[0]}:{turn[1]}".encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self, turn: int | None, role: str, text: str, fresh: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        fault = fault_of(text, fresh)
        if fault:
            self.faults[fault] += 1
        self.repair.feed(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def values(self) -> tuple:
        cost = self.repair.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


def fault_of(text: str, fresh: bool) -> str | None:
    """The first fault of a row; ``fresh`` unless its role and text were seen before."""
    body = text.rstrip(BLANK)
    return "blank" if not body else "duplicate" if not fresh else None if body[-1] in ENDS else "truncated"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults set by crc32 of ``conv_id:turn``; dropped rows keep their conv_id only."""
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")), "UTF-8")) % 20
    some = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), spelt("role").alias("role"), spelt("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    there = F.col("kind") != 0
    return some.select("conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
                       F.when(there, text).alias("text"), copies.alias("copy")).drop("copy")


def _stream(rows: DataFrame) -> DataFrame:
    """Rows and marks (conv_id, turn, role, text, mark) with each conversation together, in order.

    A mark stands before the first row of its role and text in a conversation. Rows without a role and a text only name
    their conversation.
    """
    named = rows.select("conv_id", "turn", "role", "text", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    first = named.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("at"))
    marks = first.select("conv_id", F.col("at.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), "digest", F.lit(True).alias("mark"))
    both = named.filter("role is not null").withColumn("mark", F.lit(False)).unionByName(marks)
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "digest", F.col("mark").desc()]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "mark")


def _conversations(batches: Iterator[pa.RecordBatch], new: Callable) -> Iterator[list]:
    """Feeds each conversation's rows to a ``new(conv_id)``; after each slice the conversations ended in it, and the open one."""
    name, now, marked = None, None, False
    for batch in sliced(batches):
        ended = []
        for conv, turn, role, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != name:
                if now is not None:
                    ended.append(now)
                name, now, marked = conv, new(conv), False
            if not mark:
                now.row(turn, role, text, marked)
            marked = mark  # a mark stands directly before its row
        yield ended, now
    if now is not None:
        yield [now], None


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reports(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost and letters of the cheapest edits, and the hash of the repaired turns.

    Takes (conv_id, turn, role, text); rows whose role and text are null only name their conversation.
    """
    name = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(name), *[pa.int64()] * 6, *[pa.string()] * 2]

    def run(batches):
        for ended, _ in _conversations(batches, Report):
            if ended:
                yield _batch([(r.conv, *r.values()) for r in ended], ["conv_id", *NAMES], kinds)

    return _stream(rows).mapInArrow(run, f"conv_id {name.simpleString()}, " + ", ".join(f"{n} {'bigint' if k == pa.int64() else 'string'}" for n, k in zip(NAMES, kinds[1:], strict=True)))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, position from 0, role, text, edit (K, R or I). Memory is what is unresolved."""
    class Turns(Report):
        def __init__(self, conv):
            super().__init__(conv)
            self.position, self.out = 0, []

        def edit(self, letter, turn):
            if turn is not None:
                self.out.append((self.conv, self.position, *turn, letter))
                self.position += 1

    name = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(name), pa.int64(), *[pa.string()] * 3]

    def run(batches):
        for ended, now in _conversations(batches, Turns):
            for turns in ended:
                turns.repair.finish()
            out = [t for turns in ended for t in turns.out]
            if now is not None:  # what is final of the open conversation goes out now
                out, now.out = out + now.out, []
            if out:
                yield _batch(out, ["conv_id", "position", "role", "text", "edit"], kinds)

    return _stream(_spelt(rows)).mapInArrow(run, f"conv_id {name.simpleString()}, position bigint, role string, text string, edit string")


def _spelt(rows: DataFrame) -> DataFrame:
    """Undamaged rows as the stream takes them: a null role or text is one space."""
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """The reports of the damaged rows."""
    return reports(damaged(rows))
