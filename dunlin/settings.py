"""Session settings that change answers."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Settings:
    exact: bool = False
    ansi: bool = False
    deleted: bool = True
    collate: str = "MACHINE"
    null: bool = False
    near: bool = False
    sql: bool = True
    #: Unknown names and functions are errors; if not, they are NULL.
    strict: bool = False
    memowidth: int = 50
    point: str = "."


class DialectError(Exception):
    """An error of the dialect; code is its number where it has one."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(f"{message} (error {code})" if code else message)
        self.code = code
