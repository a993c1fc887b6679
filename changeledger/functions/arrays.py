"""Helpers for work that stays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def add_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that are used in several places.

    The optimizer copies an ordinary column into every filter and expression
    that refers to it.  The output of a generator is not copied, so the
    expressions run once per row.
    """
    fields = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select("*", F.inline(F.array(fields))) if columns else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used inside a lambda is evaluated again for every element;
    a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


#: From so many elements on, sums are kept in several levels.
LARGE = 4_096
#: Elements per sum of a level.
FANOUT, LEVELS = 16, 4


def _in_one_level(a: Column) -> Column:
    """Sums per block of sqrt(n) elements: about n * sqrt(n) additions."""
    def with_block(size: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), size)
        block_sums = F.transform(starts, lambda s: _total(F.slice(a, s + 1, size)))
        return let(
            let(block_sums, lambda b: F.transform(b, lambda _, i: _total(F.slice(b, F.lit(1), i)))),
            lambda offsets: F.transform(a, lambda _, i: (
                F.get(offsets, F.floor(i / size).cast("int"))
                + _total(F.slice(a, i - i % size + 1, i % size)))))

    return let(F.greatest(F.floor(F.sqrt(F.size(a))).cast("int"), F.lit(1)), with_block)


def _in_levels(a: Column) -> Column:
    """Each level holds the sums of FANOUT elements of the one below; an element adds less than FANOUT numbers of
    each level, and of the last one as many as lie in front."""
    def climb(levels: list[Column]) -> Column:
        if len(levels) <= LEVELS:
            starts = F.sequence(F.lit(0), F.greatest(F.size(levels[-1]) - 1, F.lit(0)), F.lit(FANOUT))
            above = F.transform(starts, lambda s: _total(F.slice(levels[-1], s + 1, FANOUT)))
            return let(above, lambda sums: climb([*levels, sums]))

        def before(i: Column) -> Column:
            total = _total(F.slice(levels[-1], F.lit(1), F.shiftright(i, 4 * LEVELS)))
            for level, sums in enumerate(levels[:-1]):
                at = F.shiftright(i, 4 * level)
                total = total + _total(F.slice(sums, at - at % FANOUT + 1, at % FANOUT))
            return total

        return F.transform(a, lambda _, i: before(i))

    return climb([a])


def sums_before(values: Column) -> Column:
    """For every element, the sum of the elements in front of it, without a shuffle.

    Long arrays take time in proportion to their length: five short sums per element up to some millions.
    """
    return let(values, lambda a: F.when(F.size(a) < LARGE, _in_one_level(a)).otherwise(_in_levels(a)))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
