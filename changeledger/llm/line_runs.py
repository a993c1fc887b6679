"""Line dedup: classes of equal line runs by prefix doubling; later copies of repeated runs are deleted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeledger.llm.common import settle, unused
from changeledger.llm.texts import encoded

#: A repeated run counts if it has this many words.
LEAST_WORDS = 10


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The lines of each text that have words.

    k counts them, line counts all lines, id is the MD5 of the line without blanks at its end. forth is the
    number of lines of the shortest run of ``least`` words that begins here, back of the one that ends
    here; 0 if the text has none.
    """
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    for batch in batches:
        out: list[list] = [[] for _ in types]
        owner: list[int] = []
        for place, text in enumerate(encoded(batch.column("text"))):
            kept = [(i, line.rstrip(), n) for i, line in enumerate(text.split(b"\n")) if (n := len(line.split()))]
            if not kept:
                continue
            words = [n for _, _, n in kept]
            upto, n, here = np.concatenate([[0], np.cumsum(words)]), len(kept), np.arange(len(kept))
            ends = np.searchsorted(upto, upto[:-1] + least)                 # run [k, ends)
            starts = np.searchsorted(upto, upto[1:] - least, "right") - 1   # run [starts, k + 1)
            forth, back = np.where(ends <= n, ends - here, 0), np.where(starts >= 0, here + 1 - starts, 0)
            owner += [place] * n
            for column, values in zip(out, (here.tolist(), [i for i, _, _ in kept], words, [hashlib.md5(line).digest() for _, line, _ in kept],
                                            forth.tolist(), back.tolist())):
                column += values
        which = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").take(which), batch.column("doc_id").take(which), *(pa.array(c, t) for c, t in zip(out, types))],
            ["row", "doc_id", "k", "line", "words", "id", "forth", "back"])


def _place(doc_id: str = "doc_id") -> Column:
    """Where a line stands in the corpus: documents by id, NULL last, rows of one id as written."""
    return F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), "row", "k")


def _classes(places: DataFrame, by: list[str]) -> DataFrame:
    """places with ``first``, the first place that agrees on ``by``; places that are alone go.

    First places and sizes are partial minima and sums, and reach the places in a join that can split a
    frequent value: no task gets a whole class.
    """
    found = (places.groupBy(*by).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(*[F.col(c).alias(f"of_{c}") for c in by], "first"))
    same = [F.col(c) == F.col(f"of_{c}") for c in by]
    return places.join(found, same).drop(*[f"of_{c}" for c in by])


def _number(first: str = "first") -> Column:
    """A class by its first place, as one short value for joins."""
    return F.concat_ws(":", F.col(f"{first}.row").cast("string"), F.col(f"{first}.k").cast("string"))


def _ahead(places: DataFrame, level: DataFrame, by: Column) -> DataFrame:
    """places with y, the class of the suffix ``by`` lines on, where there is one."""
    other = level.select(F.col("row").alias("r"), F.col("k").alias("j"), F.col("class").alias("y"))
    return places.join(other, (F.col("row") == F.col("r")) & (F.col("k") + by == F.col("j"))).drop("r", "j")


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """row, line, words of each line that is to be deleted. docs: row (long), doc_id, text.

    A run is a sequence of lines with words (blank lines count neither as lines nor as ends). A run of
    ``least`` words or more that also stands earlier in the corpus is deleted; its first copy stays.

    Suffixes of the line sequences are kept in classes by their first h lines, h = 1, 2, 4, ..., as in
    the construction of a suffix array by prefix doubling: the class of 2h lines is the pair of the classes
    of h lines here and h lines on. A suffix that is alone in its class is settled and leaves. (The order
    between classes, which makes an array of them, is not needed.) Two suffixes have a common prefix of
    m lines exactly if their classes of h lines agree here and m - h lines on, h <= m < 2h: this gives the
    interval of suffixes with a common prefix of m lines, for any m. A maximal repeated run is covered by the
    shortest runs of ``least`` words from each of its lines on and up to each of its lines, so these are the m that
    are looked up, and in each interval all but the first copy are marked. As equal runs are looked up
    together, the first is the first of the corpus. Doubling ends where the longest m is reached.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *(T.StructField(n, t) for n, t in (("k", T.IntegerType()), ("line", T.IntegerType()), ("words", T.IntegerType()),
                                                              ("id", T.BinaryType()), ("forth", T.IntegerType()), ("back", T.IntegerType())))])
    lines = settle(docs.select("row", "doc_id", "text").mapInArrow(lambda batches: _cut(batches, least), schema))
    known = settle(_classes(lines, ["id"]).withColumn("class", _number()).drop("id", "first"))
    level = known.select("row", "doc_id", "k", "class")
    forth = known.filter("forth > 0").select("row", "doc_id", "k", F.col("forth").alias("m"))
    back = known.filter("back > 0").select("row", "doc_id", (F.col("k") - F.col("back") + 1).alias("k"), F.col("back").alias("m"))
    runs = settle(forth.union(back).distinct())
    longest, h, marked = runs.agg(F.max("m")).first()[0] or 0, 1, None
    while h <= longest:
        here = level.select(F.col("row").alias("r0"), F.col("k").alias("k0"), F.col("class").alias("x"))
        own = (runs.filter((F.col("m") >= h) & (F.col("m") < 2 * h))
               .join(here, (F.col("row") == F.col("r0")) & (F.col("k") == F.col("k0"))).drop("r0", "k0"))
        later = (_classes(_ahead(own, level, F.col("m") - h), ["m", "x", "y"]).filter(F.col("first") != _place())
                 .select("row", "k", "m"))
        marked = later if marked is None else marked.union(later)
        if 2 * h <= longest:
            pairs = _ahead(level.withColumnRenamed("class", "x"), level, F.lit(h))
            level = settle(_classes(pairs, ["x", "y"]).select("row", "doc_id", "k", _number().alias("class")))
        h *= 2
    if marked is None:
        return known.limit(0).select("row", "line", "words")
    covered = settle(marked).select("row", F.explode(F.expr("sequence(k, k + m - 1)")).alias("k")).distinct()
    return settle(covered.join(known.select(F.col("row").alias("r"), F.col("k").alias("j"), "line", "words"),
                               (F.col("row") == F.col("r")) & (F.col("k") == F.col("j"))).select("row", "line", "words"))


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later copies of repeated runs cut out of the text, and the columns n_lines, n_deleted,
    n_deleted_words, deleted (numbers of the deleted lines from 0, in order).

    The corpus is ordered by doc_id, NULL last; rows of one id by their place as written. What stays of a text
    keeps its lines as they are.

    Defined results: NULL stays NULL and has no lines; the empty text has one line, without words; blank
    lines stay; of equal rows only the first keeps its runs; a run may overlap its earlier copy; an empty
    table gives an empty result; a column with a result's name is replaced.
    """
    row, of_row, gone_lines, gone_words = (unused(docs, c) for c in ("row_number", "of_row", "gone_lines", "gone_words"))
    written = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = repeated_lines(written.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), least)
    lists = (gone.groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("d"), F.sum("words").alias("w"))
             .select(F.col("row").alias(of_row), F.col("d").alias(gone_lines), F.col("w").alias(gone_words)))
    joined = written.join(lists, F.col(row) == F.col(of_row), "left")
    lines, deleted = F.split(F.col(text), "\n"), F.coalesce(F.col(gone_lines), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), deleted)
    clean = F.when(F.size(deleted) > 0, F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).otherwise(F.col(text))
    return (joined.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)), "n_deleted": F.size(deleted),
                                "n_deleted_words": F.coalesce(F.col(gone_words), F.lit(0)), "deleted": deleted, text: clean})
            .drop(row, of_row, gone_lines, gone_words))
