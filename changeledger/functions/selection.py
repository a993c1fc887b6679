"""Which versions a run covers, as a predicate on catalog columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from changeledger.functions.paths import checked_regex, full_match
from changeledger.functions.versions import in_family, version_key_of
from changeledger.schema import BAD_SETTING, INVALID_VERSION, LedgerError

ALL = "ALL"
EXACT = "EXACT"
RANGE = "RANGE"
FAMILY = "FAMILY"
FAMILY_RANGE = "FAMILY_RANGE"
REGEX = "REGEX"

# Arguments each mode takes; the range modes need at least one of theirs.
_ARGUMENTS = {
    ALL: set(), EXACT: {"target"}, FAMILY: {"target"}, REGEX: {"regex"},
    RANGE: {"start", "end"}, FAMILY_RANGE: {"start", "end"},
}


@dataclass(frozen=True)
class VersionSelection:
    """``mode`` may be left out: ``target`` implies EXACT, ``start``/``end`` RANGE.

    With ``by_directory`` the directory version is compared instead of the file
    version.  Items without the compared version only pass ALL.
    """

    mode: str | None = None
    target: str | None = None
    start: str | None = None
    end: str | None = None
    regex: str | None = None
    by_directory: bool = False

    def __post_init__(self):
        given = {k for k in ("target", "start", "end", "regex") if getattr(self, k)}
        mode = self.mode.upper().replace("-", "_") if self.mode else (
            EXACT if "target" in given else RANGE if given & {"start", "end"} else ALL)
        if mode not in _ARGUMENTS:
            raise LedgerError(BAD_SETTING, f"unknown selection mode {self.mode!r}")
        if mode == ALL and "regex" in given:
            raise LedgerError(BAD_SETTING, "a regex needs mode REGEX")
        if mode == REGEX and not given:
            raise LedgerError(BAD_SETTING, "mode REGEX needs a regex")
        if "regex" in given:
            checked_regex(self.regex, "selection")
        allowed = _ARGUMENTS[mode]
        if mode != ALL and (not given or given - allowed):
            raise LedgerError(INVALID_VERSION, f"mode {mode} takes {sorted(allowed)}, got {sorted(given)}")
        object.__setattr__(self, "mode", mode)
        keys = {k: version_key_of(getattr(self, k)) for k in given - {"regex"}}
        if {"start", "end"} <= set(keys) and keys["start"] > keys["end"]:
            raise LedgerError(INVALID_VERSION, f"start {self.start} is after end {self.end}")

    @property
    def version_column(self) -> str:
        return "dir_version" if self.by_directory else "version"

    @property
    def key_column(self) -> str:
        return "dir_vsort" if self.by_directory else "vsort"

    @property
    def must_hit(self) -> bool:
        """Whether finding no item at all is a mistake."""
        return self.mode in (EXACT, FAMILY, REGEX)

    def predicate(self) -> Column:
        key = F.col(self.key_column)
        if self.mode == ALL:
            return F.lit(True)
        if self.mode == EXACT:
            hit = key == version_key_of(self.target)
        elif self.mode == FAMILY:
            hit = in_family(key, version_key_of(self.target))
        elif self.mode == REGEX:
            hit = key.isNotNull() & full_match(F.col(self.version_column), checked_regex(self.regex, "selection"))
        else:
            hit = key.isNotNull()
            if self.start:
                hit = hit & (key >= version_key_of(self.start))
            if self.end:
                end = version_key_of(self.end)
                below = key <= end
                if self.mode == FAMILY_RANGE:
                    below = below | in_family(key, end)
                hit = hit & below
        return F.coalesce(hit, F.lit(False))

    def left_out_by_end(self) -> Column:
        """Members of the end version's family that a RANGE cuts off."""
        if self.mode != RANGE or not self.end:
            return F.lit(False)
        key, end = F.col(self.key_column), version_key_of(self.end)
        return F.coalesce((key > end) & in_family(key, end), F.lit(False))
