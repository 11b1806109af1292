"""Located errors and limits shared by every text format."""

from __future__ import annotations

from dataclasses import dataclass

ERROR_TYPE = "struct<code:string,message:string,offset:bigint,line:int,col:int>"


class TextError(ValueError):
    """A rejected text: code, message and where (offset in characters, line and column from 1)."""

    def __init__(self, code: str, message: str, text: str = "", offset: int = 0):
        super().__init__(f"{code} at {offset}: {message}")
        self.code, self.message, self.offset = code, message, offset
        before = text[:offset]
        self.line = before.count("\n") + 1
        self.col = offset - (before.rfind("\n") + 1) + 1

    def row(self) -> dict:
        return {"code": self.code, "message": self.message, "offset": self.offset, "line": self.line, "col": self.col}

    def __reduce__(self):
        return _remade, (self.code, self.message, self.offset, self.line, self.col)


def _remade(code: str, message: str, offset: int, line: int, col: int) -> TextError:
    made = TextError(code, message)
    made.offset, made.line, made.col = offset, line, col
    return made


@dataclass(frozen=True)
class Limits:
    """Bounds that every parser enforces; exceeding one is an error with code ``limit``."""

    depth: int = 256
    total: int = 64 << 20
    items: int = 1 << 20
    string: int = 16 << 20
