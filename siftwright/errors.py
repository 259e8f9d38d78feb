"""Errors of the filter language, and how parse errors are shown."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class SchemeError(ValueError):
    """A field, function or list is declared twice or wrongly."""


class UnknownField(KeyError):
    def __str__(self) -> str:
        return f"unknown field: {self.args[0]}"


class TypeMismatch(TypeError):
    """A value of the wrong type is set, or a record or frame has another scheme's types."""


class SchemeMismatch(ValueError):
    """A filter meets a record of another scheme."""


class MissingField(ValueError):
    """A mandatory field has no value."""


@dataclass
class Failure(Exception):
    """A parse failure inside the scanner: what is wrong, and the span of the whole input (to its end, if end is None)."""

    kind: str
    start: int
    end: int | None = None
    message: str = ""
    details: dict[str, Any] = field(default_factory=dict)


@dataclass
class ParseError(Exception):
    """A failure with the line that it is on; columns and lines count from 0."""

    kind: str
    message: str
    input: str
    line_number: int
    span_start: int
    span_len: int
    details: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(text: str, failure: Failure) -> ParseError:
        end = len(text) if failure.end is None else failure.end
        line_number = text.count("\n", 0, failure.start)
        begin = text.rfind("\n", 0, failure.start) + 1
        stop = text.find("\n", begin)
        line = text[begin:] if stop < 0 else text[begin:stop]
        column = failure.start - begin
        return ParseError(failure.kind, failure.message, line, line_number, column, max(0, min(end - failure.start, len(line) - column)), failure.details)

    def __str__(self) -> str:
        marks = "^" * max(1, self.span_len)
        return f"Filter parsing error ({self.line_number + 1}:{self.span_start + 1}):\n{self.input}\n{' ' * self.span_start}{marks} {self.message}\n"
