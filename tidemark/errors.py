"""Errors of the engine, with the status code that a session reports."""

from __future__ import annotations


class EngineError(Exception):
    """A command that can't be carried out."""

    code = 1


class InvalidArgument(EngineError):
    code = 2


class NotFound(EngineError):
    code = 3


class Conflict(EngineError):
    code = 4


class TransactionError(EngineError):
    code = 5


class Blocked(EngineError):
    """The scan governor refused a query."""

    code = 6
