"""Shards of near equal bytes by a minimax contiguous partition."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeledger.llm.common import settle

#: Hex digits of the first and of each later refinement, and of the part of a slot's order that is dealt out.
FIRST, STEP, SLOT_DIGITS = 4, 2, 4


class Line:
    """The groups in order on a line of bytes, known as cells: (prefix, bytes, whether it is one group).

    A cell is what starts with a prefix of the order key. Only its ends are known, unless it is one group.
    """

    def __init__(self, cells: list[tuple[str, int, bool]]):
        self.cells = sorted(cells)
        self.ends = [0]
        for _, size, _ in self.cells:
            self.ends.append(self.ends[-1] + size)
        self.total = self.ends[-1]
        self.unclear: set[str] = set()

    def before(self, place: int) -> int:
        """The last known end of a group at or before a place; notes a cell that may hide a later one."""
        at = bisect_right(self.ends, place) - 1
        if self.ends[at] < place and at < len(self.cells) and not self.cells[at][2]:
            self.unclear.add(self.cells[at][0])
        return self.ends[at]

    def after(self, place: int) -> int:
        """The first known end of a group after a known end."""
        at = bisect_right(self.ends, place) - 1
        if at < len(self.cells) and not self.cells[at][2]:
            self.unclear.add(self.cells[at][0])
        return self.ends[min(at + 1, len(self.cells))]

    def fluid(self, place: int) -> int:
        """As before(), if cells of several groups could be cut anywhere: never less than the truth."""
        at = bisect_right(self.ends, place) - 1
        return place if self.ends[at] < place and at < len(self.cells) and not self.cells[at][2] else self.ends[at]

    def fits(self, capacity: int, shards: int, cut) -> bool:
        """Whether filling one shard after the other to the capacity needs no more than ``shards``."""
        place = 0
        for _ in range(shards):
            step = cut(min(self.total, place + capacity))
            if step <= place:
                return place >= self.total
            place = step
        return place >= self.total

    def smallest(self, shards: int, cut) -> int:
        """The smallest capacity that fits, by bisection."""
        low, high = max(0, -(-self.total // shards) - 1), self.total
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, cut) else (middle, high)
        return high

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Where each shard but the last ends: at its even share of what is left, as far as the capacity allows.

        ``floor[j]`` is the least place from which ``j`` shards of the capacity still reach the end.
        """
        floor = [self.total]
        for _ in range(shards):
            start = max(0, floor[-1] - capacity)
            first = self.before(start)
            floor.append(first if first == start else self.after(first))
        out, place = [], 0
        for left in range(shards, 1, -1):
            aim = place + -(-(self.total - place) // left)
            step = self.before(max(aim, floor[left - 1]))
            place = step if step > place else self.after(place)
            out.append(place)
        return out


def _cells(rows: DataFrame, digits: int, within: list[str] | None) -> list[tuple[str, int, bool]]:
    if within is not None:
        rows = rows.filter(F.substring("key", 1, digits - STEP).isin(within))
    found = (rows.groupBy(F.substring("key", 1, digits).alias("prefix"))
             .agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("one")))
    return [(r["prefix"], r["size"], r["one"]) for r in found.collect()]


def plan_cuts(rows: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity and the key prefixes at which shards 1, 2, ... begin.

    rows: key (32 hex digits, or empty), size. The driver holds a summary of bounded size: at most 16^4
    cells, then 16^2 for each cell that a cut may fall into; a cell's groups are looked at only there.
    """
    known, digits, within = {}, FIRST, None
    while True:
        for prefix in within or []:
            known.pop(prefix)
        for prefix, size, one in _cells(rows, digits, within):
            known[prefix] = (prefix, size, one or digits >= 32)
        line = Line(list(known.values()))
        at_most, at_least = line.smallest(shards, line.before), line.smallest(shards, line.fluid)
        line.unclear.clear()
        if at_most == at_least:
            ends = line.cuts(at_most, shards)
        else:
            for capacity in (at_least, at_most):
                line.fits(capacity, shards, line.before)
                low = high = 0
                for _ in range(shards):  # the cells between the two bounds of each cut
                    low, high = line.before(min(line.total, low + at_least)), line.fluid(min(line.total, high + at_most))
                    first, last = bisect_right(line.ends, low) - 1, bisect_right(line.ends, high) - 1
                    line.unclear.update(c[0] for c in line.cells[first:last + 1] if not c[2])
        if not line.unclear:
            starts = dict(zip(line.ends, (c[0] for c in line.cells)))
            return at_most, [starts[e] for e in dict.fromkeys(ends) if e < line.total]
        # cells differ in depth: refine the shallowest ones
        digits = min(map(len, line.unclear)) + STEP
        within = [p for p in line.unclear if len(p) == digits - STEP]


def shard_rows(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    Groups of equal texts are atomic. They are ordered by the MD5 of the text, which is how a shard gets a
    mixture of all sources, and cut into contiguous shards whose largest is as small as can be; among such
    cuts each shard gets its even share of what is left. The shard of a row is a comparison of its key with
    the cuts, so no group is gathered anywhere, however many copies it has.

    Slots: rows of a shard are ordered by (4 digits of the MD5 of doc_id, key, doc_id); counts per digit
    group are summed first, so that no task numbers a whole shard.

    Defined results: NULL and empty texts have size 1 and are two groups, the CRC of a NULL text is NULL;
    a NULL doc_id is ordered as an empty one; equal rows get neighbouring slots; an empty table gives an
    empty result; with fewer groups than shards the last shards stay empty; other columns are not read.
    """
    source, of_text = F.col(doc_id), F.col(text)
    rows = settle(docs.select(
        source.alias("doc_id"),
        (F.coalesce(F.octet_length(of_text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(of_text).alias("text_crc32"),
        F.coalesce(F.md5(of_text), F.lit("")).alias("key")))
    _, starts = plan_cuts(rows, shards)
    placed = rows.withColumn("shard", shard_of(F.col("key"), starts)).withColumn(
        "part", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, SLOT_DIGITS))
    ahead = (placed.groupBy("shard", "part").count()
             .withColumn("ahead", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count"))
             .select(F.col("shard").alias("of_shard"), F.col("part").alias("of_part"), "ahead"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id")) - 1
    return (placed.withColumn("place", place)
            .join(ahead, (F.col("shard") == F.col("of_shard")) & (F.col("part") == F.col("of_part")))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("place")).alias("slot")))


def shard_of(key: Column, starts: list[str]) -> Column:
    """How many shards begin at or before a key."""
    out = F.lit(0)
    for start in starts:
        out = out + (key >= start).cast("int")
    return out
