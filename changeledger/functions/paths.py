"""Script paths: globs, filters, directory versions and file-name kinds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession, functions as F

from changeledger.functions.versions import VERSION_PATTERN
from changeledger.schema import (
    BAD_SETTING, CALLBACK, IGNORED, INVALID_VERSION, LEGACY_REPEATABLE, LedgerError,
    REPEATABLE, SQL, UNDO_SQL)

# Fixed value: directory version, taken from whole path segments.
DIRECTORY_VERSION_PATTERN = r"(?:^|/)(?<version>\d+(?:\.\d+)*)(?=$|/)"

# Scripts at the root that are hooks, not changes.
CALLBACK_SCRIPTS = [
    "beforeMigrate.sql", "beforeEachMigrate.sql", "afterEachMigrate.sql",
    "afterEachMigrateError.sql", "afterMigrate.sql", "afterMigrateError.sql",
    "beforeValidate.sql", "afterValidate.sql", "beforeClean.sql", "afterClean.sql",
    "beforeBaseline.sql", "afterBaseline.sql", "beforeRepair.sql", "afterRepair.sql",
    "beforeUndo.sql", "afterUndo.sql",
]


def parent_of(script: Column) -> Column:
    return F.regexp_extract(script, r"(?s)^(.*)/[^/]*\z", 1)


def file_name_of(script: Column) -> Column:
    return F.substring_index(script, "/", -1)


# ---------------------------------------------------------------- filters

_GLOB_TOKEN = re.compile(r"/\*\*\Z|\*\*/|\*\*|\*|\?|.", re.DOTALL)
_GLOB_REGEX = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "/**": "(?:/.*)?"}


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` stay inside a directory, ``**`` crosses directories,
    ``**/`` also matches no directory, a final ``/**`` also the directory itself."""
    return "".join(_GLOB_REGEX.get(t) or re.sub(r"([\\.\[\]{}()+\-^$|])", r"\\\1", t)
                   for t in _GLOB_TOKEN.findall(glob))


def checked_regex(regex: str, what: str) -> str:
    """``regex`` if it can be compiled as the column functions will; 4002 otherwise.  Starts no job."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(regex)
        except IllegalArgumentException as error:
            raise LedgerError(BAD_SETTING, f"{what}: not a regular expression: {regex!r}") from error
    return regex


def full_match(value: Column, regex: str) -> Column:
    return value.rlike(rf"^(?:{regex})\z")


@dataclass(frozen=True)
class PathFilter:
    """Conditions on the directory, the file name and the whole path; all must hold."""

    directory_glob: str | None = None
    directory_regex: str | None = None
    file_glob: str | None = None
    file_regex: str | None = None
    path_glob: str | None = None
    path_regex: str | None = None

    def __post_init__(self):
        for part in ("directory", "file", "path"):
            self._regex(part)

    def _regex(self, part: str) -> str | None:
        glob = (getattr(self, f"{part}_glob") or "").strip()
        regex = (getattr(self, f"{part}_regex") or "").strip()
        if glob and regex:
            raise LedgerError(BAD_SETTING, f"{part}: give a glob or a regex, not both")
        return glob_to_regex(glob) if glob else checked_regex(regex, part) if regex else None

    def matches(self, script: Column) -> Column:
        values = {"directory": parent_of(script), "file": file_name_of(script), "path": script}
        condition = F.lit(True)
        for part, value in values.items():
            regex = self._regex(part)
            if regex:
                condition = condition & full_match(value, regex)
        return condition


# ------------------------------------------------------- directory version

_GROUP_SCAN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\((\?<(?![=!])(\w+)>|\?)?", re.DOTALL)


def version_group(regex: str) -> int:
    """Number of the group called ``version``, else 1."""
    if not regex or not regex.strip():
        raise LedgerError(BAD_SETTING, "directory version regex is empty")
    checked_regex(regex, "directory version")
    count, named = 0, None
    for match in _GROUP_SCAN.finditer(regex):
        if match.group().startswith("(") and match.group(1) != "?":
            count += 1
            if match.group(2) == "version":
                named = count
    if not count:
        raise LedgerError(BAD_SETTING, "directory version regex needs a capture group")
    return named or 1


def directory_version(script: Column, regex: str = DIRECTORY_VERSION_PATTERN) -> Column:
    """Last match of ``regex`` in the parent path; NULL when there is none."""
    found = F.regexp_extract_all(parent_of(script), F.lit(regex), F.lit(version_group(regex)))
    return F.nullif(F.try_element_at(found, F.lit(-1)), F.lit(""))


# --------------------------------------------------------------- file names

@dataclass(frozen=True)
class Naming:
    """How file names mark versioned, undo and repeatable scripts."""

    versioned: str = "V"
    undo: str = "U"
    repeatable: str = "R"
    separator: str = "__"
    suffix: str = ".sql"

    @staticmethod
    def _quote(text: str) -> str:
        return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)

    @property
    def _tail(self) -> str:
        return rf"{self._quote(self.separator)}([^/]+){self._quote(self.suffix)}\z"

    def kind(self, script: Column) -> Column:
        """SQL, UNDO_SQL, REPEATABLE, CALLBACK, IGNORED, or the code of a naming error."""
        name = file_name_of(script)
        q, tail = self._quote, self._tail
        versioned = name.rlike(rf"^{q(self.versioned)}{VERSION_PATTERN}{tail}")
        undo = name.rlike(rf"^{q(self.undo)}{VERSION_PATTERN}{tail}")
        unreadable = ((name.startswith(self.versioned) | name.startswith(self.undo))
                      & name.endswith(self.suffix))
        return (F.when(script.isin(CALLBACK_SCRIPTS), CALLBACK)
                .when(name.rlike(rf"^{q(self.repeatable)}\d+{tail}"), LEGACY_REPEATABLE)
                .when(name.rlike(rf"^{q(self.repeatable)}{tail}"), REPEATABLE)
                .when(versioned, SQL)
                .when(undo, UNDO_SQL)
                .when(unreadable, INVALID_VERSION)
                .otherwise(IGNORED))

    def _group(self, script: Column, group: int) -> Column:
        prefix = "|".join(map(self._quote, (self.versioned, self.undo)))
        pattern = rf"^(?:(?:{prefix})({VERSION_PATTERN})|{self._quote(self.repeatable)}){self._tail}"
        return F.nullif(F.regexp_extract(file_name_of(script), pattern, group), F.lit(""))

    def version(self, script: Column) -> Column:
        return self._group(script, 1)

    def description(self, script: Column) -> Column:
        return self._group(script, 2)
