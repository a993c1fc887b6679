"""Conversation structure repair: the cheapest edits that make turns alternate, by tables over blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeledger.llm.common import numbered, settle

#: White space of a text; any other character makes it not blank.
_BLANK = r"\x20\x09-\x0D"
#: Turns that are gathered into one row of symbols, before those rows are joined per conversation.
CHUNK = 4_096
#: Turns of a block.
BLOCK = 4
DELETE, INSERT, REROLE = 3, 2, 2

#: A turn's symbol: 2 * role (system, user, assistant, other) + 1 if truncated, or the one of turns that must go.
SYMBOLS, GONE = 9, 8
#: What stands before: nothing, a system turn, a user turn, an assistant turn. Where an inserted or reroled turn leads.
START, SYSTEM, USER, ASSISTANT = range(4)
_MADE = (USER, USER, ASSISTANT, USER)
#: Where a kept turn of a role leads from a state, if it may stand there.
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
#: Cheapest end from each state: nothing, user and assistant, assistant, nothing.
_END = (0, 2 * INSERT, INSERT, 0)


def _before_turn(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cost to the end from each state before a turn, from the costs behind it."""
    cost = [DELETE + c for c in after]
    if symbol != GONE:
        role, truncated = divmod(symbol, 2)
        for state in range(4):
            cost[state] = min(cost[state], REROLE + truncated + after[_MADE[state]])
            if (to := _KEPT.get((state, role))) is not None:
                cost[state] = min(cost[state], truncated + after[to])
    for _ in range(2):
        cost = [min(c, INSERT + cost[_MADE[state]]) for state, c in enumerate(cost)]
    return tuple(cost)


class Tables:
    """What a block of turns does to a vector of costs, for every block and every vector that can occur.

    A vector holds the cheapest cost to the end from each state, less the smallest of them: few such vectors
    exist, and a block takes one to another and adds a number. Blocks are read from the end of a
    conversation to its start, so vectors are costs to the end.
    """

    def __init__(self):
        self.vectors, self.number = [_END], {_END: 0}
        follow, added, at = [], [], 0
        while at < len(self.vectors):
            row, sums = [], []
            for symbol in range(SYMBOLS):
                cost = _before_turn(self.vectors[at], symbol)
                least = min(cost)
                normal = tuple(c - least for c in cost)
                if normal not in self.number:
                    self.number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append(self.number[normal])
                sums.append(least)
            follow.append(row)
            added.append(sums)
            at += 1
        self.follow, self.added = np.array(follow), np.array(added)
        # blocks of one turn, of two, ...: the turn in front is read last
        block_follow, block_added = self.follow, self.added
        for _ in range(BLOCK - 1):
            block_added = (block_added[:, None, :] + self.added[block_follow].transpose(0, 2, 1)).reshape(len(follow), -1)
            block_follow = self.follow[block_follow].transpose(0, 2, 1).reshape(len(follow), -1)
        self.block_follow, self.block_added = block_follow.tolist(), block_added.tolist()
        self.expand = lru_cache(maxsize=200_000)(self._expand)

    def _expand(self, block: tuple[int, ...], behind: int, state: int) -> tuple[str, int]:
        """Edits of a block that is entered in a state, with the vector behind it; and the state it is left in.

        The vectors between its turns are found from its end; then, from its start, the edit of the smallest
        letter that keeps the cost is taken. Each letter leads to one state only, so no tie is left open.
        """
        vectors = [self.vectors[behind]]
        for symbol in reversed(block):
            vectors.append(_before_turn(vectors[-1], symbol))
        vectors.reverse()
        edits = []
        for symbol, here, after in zip(block, vectors, vectors[1:]):
            role, truncated = divmod(symbol, 2)
            while True:
                cost = here[state]
                kept = None if symbol == GONE else _KEPT.get((state, role))
                if cost == DELETE + after[state]:
                    edits.append("D")
                    break
                if cost == INSERT + here[_MADE[state]]:
                    edits.append("I")
                    state = _MADE[state]
                elif kept is not None and cost == truncated + after[kept]:
                    edits.append("K")
                    state = kept
                    break
                else:
                    edits.append("R")
                    state = _MADE[state]
                    break
        return "".join(edits), state

    def repair(self, symbols: list[int]) -> tuple[int, str]:
        """Cost and edits, the smallest of the cheapest in the order of their letters."""
        head = len(symbols) % BLOCK
        vector, cost, behind = 0, 0, []
        for start in range(len(symbols) - BLOCK, head - 1, -BLOCK):
            block = 0
            for symbol in symbols[start:start + BLOCK]:
                block = block * SYMBOLS + symbol
            behind.append(vector)
            cost += self.block_added[vector][block]
            vector = self.block_follow[vector][block]
        state, edits = START, []
        if head:
            first, end = tuple(symbols[:head]), self.vectors[vector]
            for symbol in reversed(first):
                end = _before_turn(end, symbol)
            cost += end[START]
            edit, state = self.expand(first, vector, state)
            edits.append(edit)
        else:
            cost += self.vectors[vector][START]
        for start, vector in zip(range(head, len(symbols), BLOCK), reversed(behind)):
            edit, state = self.expand(tuple(symbols[start:start + BLOCK]), vector, state)
            edits.append(edit)
        edits.append("I" * (_END[state] // INSERT))
        return cost, "".join(edits)


#: A turn's letter, from 'A': 4 * role (system, user, assistant, other) + fault (none, blank, duplicate, truncated).
_SYMBOL = [GONE if fault in (1, 2) else 2 * role + (fault == 3) for role in range(4) for fault in range(4)]


def _found(letters: Column) -> Column:
    """Faults, illegal neighbours, cost and edits from a conversation's letters."""
    schema = "struct<blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"

    @F.arrow_udf(schema)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = Tables()
        for batch in batches:
            rows = []
            for value in batch:
                code = np.frombuffer(value.as_py().encode(), np.uint8) - ord("A")
                role, fault = code >> 2, np.bincount(code & 3, minlength=4)
                a, b = role[:-1], role[1:]
                legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
                cost, audit = tables.repair([_SYMBOL[c] for c in code.tolist()])
                rows.append((int(fault[1]), int(fault[2]), int(fault[3]), len(a) - int(legal.sum()), cost, audit))
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], pa.string() if i == 5 else pa.int64()) for i in range(6)],
                ["blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return found(letters)


def _edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, from the edits and the turns in order."""
    made, state = {USER: "user", ASSISTANT: "assistant"}, START
    for edit in audit:
        if edit == "I":
            state = _MADE[state]
            yield edit, made[state], ""
            continue
        role, text = next(turns)
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield edit, role, text
        elif edit == "R":
            state = _MADE[state]
            yield edit, made[state], text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(c).to_pylist() for c in ("conversation", "role", "text")))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, str, str]]]]:
    """Each conversation's key and repaired turns, from rows sorted by conversation, the row of edits first."""
    rows = _stream(batches)
    row = next(rows, None)
    while row is not None:
        key, audit, ahead = row[0], row[2], []

        def turns() -> Iterator[tuple[str, str]]:
            while (one := next(rows, None)) is not None and one[0] == key:
                yield one[1], one[2]
            ahead.append(one)

        rest = turns()
        edited = _edited(audit, rest)
        yield key, edited
        for _ in edited:
            pass
        for _ in rest:
            pass
        row = ahead[0]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, digests = [], []
    for key, edited in _conversations(batches):
        digest, between = hashlib.sha256(), b""
        for _, role, text in edited:
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        keys.append(key)
        digests.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["conversation", "repaired_sha256"])


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conversation", "position", "edit", "role", "text"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)

    for key, edited in _conversations(batches):
        for position, (edit, role, text) in enumerate(edited):
            held.append((key, position, edit, role, text))
            size += len(text) + 64
            if size > 4 << 20:
                yield batch()
                held, size = [], 0
    yield batch()


class Repair:
    """Turns in order, numbered, and what was found about each conversation. Starts jobs.

    ``turns``: columns conv_id, turn, role, text under the given names; others are not read. Turns of a
    conversation go by turn (NULL first); turns of one number go by the MD5 of role and text. NULL roles
    and texts are one space. Of a turn's faults the first counts: blank; duplicate (same role and text as an
    earlier one); truncated (its last character that is no white space is none of ``.!?``).

    Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2;
    blank and duplicate turns must go; a truncated one that stays adds 1. The result has at most one system
    turn, at the start, and user and assistant by turns, from user to assistant, or nothing. Roles count by
    their first letter. Among the cheapest edits the ones of the smallest letters are taken.

    A conversation of any length is sorted over many tasks and gathered as one letter per turn; its edits are
    found from these letters by lookups of whole blocks, and one task at a time reads its turns in order to
    repair or hash them, without holding them.

    Defined results: a NULL conv_id is a conversation like any other; repeated rows are duplicates of the
    first; an empty table has no conversations; other columns, whatever their names, are not read.
    """

    def __init__(self, turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        space = F.lit(" ")
        rows = turns.select(F.col(conv_id).alias("conv_id"), F.to_json(F.struct(F.col(conv_id).alias("c"))).alias("conversation"), F.col(turn).alias("turn"),
                            F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
        rows = rows.withColumn("same", F.md5(F.concat(F.md5("role"), F.md5("text")))).withColumn("tie", F.monotonically_increasing_id())
        order = [F.asc("conversation"), F.asc_nulls_first("turn"), F.asc("same"), F.asc("tie")]
        self.turns = numbered(rows, order, "place")
        self.found = settle(self._facts())

    def _facts(self) -> DataFrame:
        last = F.regexp_extract("text", rf"([^{_BLANK}])[{_BLANK}]*\z", 1)
        role = F.coalesce(F.element_at(F.create_map(*map(F.lit, ["s", 0, "u", 1, "a", 2])), F.substring("role", 1, 1)), F.lit(3))
        narrow = settle(self.turns.select(
            "conv_id", "conversation", "turn", "place", "same", role.alias("role"),
            F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).alias("fault")))
        first = narrow.groupBy("conversation", "same").agg(F.min("place").alias("first")).select("first")
        # places are unique: the join has no hot key
        marked = narrow.join(first, F.col("place") == F.col("first"), "left")
        fault = F.when(F.col("fault") == 1, 1).when(F.col("first").isNull(), 2).otherwise(F.col("fault"))
        letter = F.char(F.lit(ord("A")) + 4 * F.col("role") + fault)
        chunks = (marked.withColumn("letter", letter).groupBy("conversation", F.floor(F.col("place") / CHUNK).alias("chunk"))
                  .agg(F.first("conv_id").alias("conv_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("letters"),
                       F.size(F.collect_set("turn")).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high")))
        whole = chunks.groupBy("conversation").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("chunk", "letters", "turns", "low", "high"))).alias("parts"))
        # turns go up from chunk to chunk, so neighbours share one number at most
        neighbours = F.arrays_zip(F.slice("parts", 1, F.size("parts") - 1).alias("a"), F.slice("parts", 2, F.size("parts")).alias("b"))
        shared = F.size(F.filter(neighbours, lambda x: x["a"]["high"] == x["b"]["low"]))
        distinct = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["turns"]) - shared
        gaps = F.coalesce(F.array_max(F.transform("parts", lambda p: p["high"])) - F.array_min(F.transform("parts", lambda p: p["low"])) + 1 - distinct, F.lit(0))
        letters = F.array_join(F.transform("parts", lambda p: p["letters"]), "")
        return (whole.select("conversation", "conv_id", gaps.cast("long").alias("gaps"), letters.alias("letters"))
                .select("conversation", "conv_id", "gaps", _found(F.col("letters")).alias("found"))
                .select("conversation", "conv_id", "gaps", "found.*"))

    def _in_order(self, task: Callable, schema: str) -> DataFrame:
        edits = self.found.select("conversation", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
        return (edits.union(self.turns.select("conversation", "place", "role", "text")).repartition("conversation")
                .sortWithinPartitions("conversation", "place").select("conversation", "role", "text").mapInArrow(task, schema))

    def report(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

        ``gaps``: numbers missing between the smallest and the largest turn; ``illegal``: neighbours that may not
        follow each other; the hash is that of the repaired turns as ``role:text`` lines.
        """
        hashes = self._in_order(_hashes, "conversation string, repaired_sha256 string")
        return self.found.join(hashes, "conversation").drop("conversation")

    def turns_repaired(self) -> DataFrame:
        """conv_id, position (from 0), edit (K, R or I), role, text of every repaired turn."""
        rows = self._in_order(_repaired_rows, "conversation string, position long, edit string, role string, text string")
        ids = F.from_json("conversation", f"c {dict(self.turns.dtypes)['conv_id']}")["c"]
        return rows.select(ids.alias("conv_id"), "position", "edit", "role", "text")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the CRC-32 of ``conv_id:turn`` modulo 20 (NULLs are one space).

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    dealt = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                         (F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (dealt.filter("fate <> 0")
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy"))
