"""Splitting script text into statements.

A dialect without line directives and procedural blocks is split by regular
expressions inside the JVM.  The others need a left-to-right scan, which runs
as an Arrow-batched UDF over the text column.  Both are narrow: a script is one
row, and no rows move.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from changeledger.functions.arrays import let, newlines, sums_before

# The UDF below travels with its code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: statements that open a block ended by a line holding only "/".
PLSQL_BLOCK = (
    r"(?:CREATE(?:\s+OR\s+REPLACE)?(?:\s+(?:EDITIONABLE|NONEDITIONABLE))?\s+"
    r"(?:PROCEDURE|FUNCTION|PACKAGE\s+BODY|PACKAGE|TRIGGER|TYPE)\b|DECLARE\b|BEGIN\b)")


@dataclass(frozen=True)
class Dialect:
    identifier_quote: str = '"'
    dollar_quoting: bool = False
    backslash_escapes: bool = False
    hash_comments: bool = False
    delimiter_directive: bool = False
    block_start: str | None = None
    separator: str = ";"

    def __post_init__(self):
        if not self.separator:
            raise ValueError("separator must not be empty")

    @property
    def is_regular(self) -> bool:
        return not self.delimiter_directive and not self.block_start


POSTGRESQL = Dialect(dollar_quoting=True)
MYSQL = Dialect(identifier_quote="`", backslash_escapes=True, hash_comments=True,
                delimiter_directive=True)
ORACLE = Dialect(block_start=PLSQL_BLOCK)

# Trimmed from a statement: the space and the control characters below it.
_TRIMMED = "".join(map(chr, range(33)))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def _comment_patterns(dialect: Dialect, end: str) -> list[str]:
    """Line and block comments; the "*" of the opening may be that of the end."""
    patterns = [r"--[^\r\n]*+", rf"/(?=\*)(?s:.*?)(?:\*/|{end})"]
    return patterns + ([r"#[^\r\n]*+"] if dialect.hash_comments else [])


def _quoted_patterns(dialect: Dialect, end: str, tag_char: str) -> list[str]:
    """Literals, quoted identifiers and dollar quotes, closed by ``end`` of text
    at the latest.  Possessive loops keep the matcher off the stack."""
    q = _quote(dialect.identifier_quote)
    escaped = r"|\\(?s:.)?" if dialect.backslash_escapes else ""
    no_backslash = r"\\" if dialect.backslash_escapes else ""
    patterns = [rf"'(?:[^'{no_backslash}]++|''{escaped})*+(?:'|{end})",
                rf"{q}(?:[^{q}]++|{q}{q})*+(?:{q}|{end})"]
    if dialect.dollar_quoting:
        patterns.append(rf"(?P<tag>\${tag_char}*+\$)(?s:.*?)(?:(?P=tag)|{end})")
    return patterns


def _plain_pattern(dialect: Dialect, separator: str) -> str:
    stops = set("-/'\r\n" + dialect.identifier_quote + separator[0])
    stops |= {"$"} if dialect.dollar_quoting else set()
    stops |= {"#"} if dialect.hash_comments else set()
    return "[^" + "".join(map(_quote, sorted(stops))) + "]++"


# ------------------------------------------------------------ in the JVM

def _split_regular(text: Column, dialect: Dialect) -> Column:
    end, sep = r"\z", _quote(dialect.separator)
    comments = _comment_patterns(dialect, end)
    quoted = [p.replace("(?P<tag>", "(?<tag>").replace("(?P=tag)", r"\k<tag>")
              for p in _quoted_patterns(dialect, end, r"[\p{L}\p{Nd}_]")]
    plain, special = _plain_pattern(dialect, dialect.separator), "|".join([*comments, *quoted, "(?s:.)"])
    piece = rf"((?:{plain}|(?!{sep})(?:{special}))*+)(?:{sep}|{end})"
    no_code = rf"^(?:\p{{javaWhitespace}}++|{'|'.join(comments)})*+"

    unix = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    pieces = F.regexp_extract_all(unix, F.lit(piece), F.lit(1))

    def located(p: Column, before: Column) -> Column:
        return F.transform(p, lambda body, i: let(
            F.regexp_extract(body, no_code, 0), lambda skipped: F.struct(
                (F.get(before, i) + newlines(skipped) + 1).cast("int").alias("line"),
                F.btrim(body, F.lit(_TRIMMED)).alias("sql"),
                (F.length(skipped) < F.length(body)).alias("code"))))

    found = let(pieces, lambda p: let(
        sums_before(F.transform(p, newlines)), lambda before: located(p, before)))
    return F.transform(
        F.filter(found, lambda s: s["code"]),
        lambda s, i: F.struct((i + 1).alias("stmt_no"), s["line"], s["sql"]))


# -------------------------------------------------------------- in Python

_NEWLINE = re.compile(r"\r\n?|\n")
_CODE = re.compile("[^\\s]|[\u0085\u00a0\u2007\u202f]")
_DIRECTIVE = re.compile(r"DELIMITER\s+(\S+)", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?\*/|--[^\n]*", re.DOTALL)


def _scanner(dialect: Dialect, separator: str | None) -> re.Pattern:
    end = r"\Z"
    groups = {
        "newline": [r"\r\n?|\n"],
        "separator": [_quote(separator)] if separator else [],
        "comment": _comment_patterns(dialect, end),
        "quoted": _quoted_patterns(dialect, end, r"\w"),
        "plain": [_plain_pattern(dialect, separator or dialect.separator), "(?s:.)"],
    }
    return re.compile("|".join(
        f"(?P<{name}>{'|'.join(patterns)})" for name, patterns in groups.items() if patterns))


def _unix_newlines(token: str, dialect: Dialect) -> tuple[str, int]:
    """Token with LF line ends, and how many lines it adds.  A newline behind a
    backslash belongs to the escape: kept as it is and not counted."""
    if "\n" not in token and "\r" not in token:
        return token, 0
    if not (dialect.backslash_escapes and token[0] == "'"):
        return _NEWLINE.subn("\n", token)
    added = 0

    def replace(match):
        nonlocal added
        if match.group()[0] == "\\":
            return match.group()
        added += 1
        return "\n"

    return re.sub(r"\\(?s:.)|\r\n?|\n", replace, token), added


def split_text(text: str, dialect: Dialect) -> Iterator[tuple[int, str]]:
    """(line, sql) of each statement of one script."""
    separator, in_block = dialect.separator, False
    block_start = re.compile(dialect.block_start, re.IGNORECASE) if dialect.block_start else None
    above, current = [], []          # statement so far: finished lines, current line
    line, code_line, pos = 1, 0, 0   # code_line 0: no code yet
    kind = token = ""
    scanner = _scanner(dialect, separator)

    def finish(with_current=True):
        nonlocal code_line
        sql = "".join(above) + ("".join(current) if with_current else "")
        found = (code_line, sql.strip(_TRIMMED))
        above.clear(), current.clear()
        has_code, code_line = code_line > 0, 0
        return [found] if has_code else []

    while pos < len(text):
        match = scanner.match(text, pos)
        kind, token, pos = match.lastgroup, match.group(), match.end()
        if kind == "tag":
            kind = "quoted"
        if kind == "newline":
            last = "".join(current).strip(_TRIMMED)
            directive = (not in_block and dialect.delimiter_directive
                         and _DIRECTIVE.fullmatch(last))
            if directive:
                separator = directive.group(1)
                scanner = _scanner(dialect, separator)
                current.clear()
                if not "".join(above).strip(_TRIMMED):
                    code_line = 0
            elif in_block and last == "/":
                yield from finish(with_current=False)
                in_block = False
                scanner = _scanner(dialect, separator)
            else:
                above.append("".join(current) + "\n")
                current.clear()
            line += 1
        elif kind == "separator":
            so_far = "".join(above + current) if block_start else ""
            if block_start and block_start.match(_COMMENT.sub(" ", so_far).strip(_TRIMMED)):
                in_block = True
                scanner = _scanner(dialect, None)
                current.append(token)
            else:
                yield from finish()
        else:
            if not code_line and (kind == "quoted" or kind == "plain" and _CODE.search(token)):
                code_line = line
            token, added = _unix_newlines(token, dialect)
            line += added
            if added:
                head, _, tail = token.rpartition("\n")
                above.append("".join(current) + head + "\n")
                current[:] = [tail]
            else:
                current.append(token)

    last = "".join(current).strip(_TRIMMED)
    if kind in ("comment", "quoted"):
        # A token that would take more text is still open; the line is not complete.
        longer = scanner.match(token + "\u0001")
        last = "" if longer.end() > len(token) else last
    if not in_block and dialect.delimiter_directive and _DIRECTIVE.fullmatch(last):
        return
    yield from finish(with_current=not (in_block and last == "/"))


_STATEMENTS = "array<struct<stmt_no:int,line:int,sql:string>>"
_STATEMENTS_ARROW = pa.list_(pa.struct([("stmt_no", pa.int32()), ("line", pa.int32()), ("sql", pa.string())]))
# Characters of scripts whose statements a task holds as Python objects at a time.
TOGETHER = 1 << 20


def _lots(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in order, in lots; a lot ends with the text that brings it to TOGETHER characters."""
    lot, size = [], 0
    for value in texts:
        text = value.as_py()
        lot.append(text)
        size += 1 + len(text or "")
        if size >= TOGETHER:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _statement_arrays(batches: Iterator[pa.Array], dialect: Dialect) -> Iterator[pa.Array]:
    """Statements of each text. A batch of Spark's may hold many or long scripts; its statements leave lot by lot."""
    for texts in batches:
        for lot in _lots(texts):
            yield pa.array([None if t is None else [
                {"stmt_no": i, "line": line, "sql": sql}
                for i, (line, sql) in enumerate(split_text(t, dialect), 1)] for t in lot], _STATEMENTS_ARROW)


def _split_scanned(text: Column, dialect: Dialect) -> Column:
    @F.arrow_udf(_STATEMENTS)
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _statement_arrays(batches, dialect)

    return split(text)


# ------------------------------------------------------------------- use

def statements_of(text: Column, dialect: Dialect = POSTGRESQL) -> Column:
    """Array of (stmt_no, line, sql); ``line`` is where the first code is."""
    split = _split_regular if dialect.is_regular else _split_scanned
    return split(text, dialect)


def split_statements(scripts: DataFrame, dialect: Dialect = POSTGRESQL,
                     text: str = "text") -> DataFrame:
    """One row per statement: the other columns of ``scripts`` + stmt_no, line, sql."""
    kept = [c for c in scripts.columns if c != text]
    # The outer form: for the inner one the optimizer adds a check that the array is
    # not empty below the split, and the text would be split twice.
    split = scripts.select(*kept, statements_of(F.col(text), dialect).alias("_statements"))
    return split.select(*kept, F.inline_outer("_statements")).filter(F.col("stmt_no").isNotNull())


def with_batches(statements: DataFrame, size: int) -> DataFrame:
    """Number of the batch each statement is sent in."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    return statements.withColumn("batch_no", F.floor((F.col("stmt_no") - 1) / size).cast("int"))
