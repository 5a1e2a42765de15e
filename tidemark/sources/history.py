"""The commands of sessions, kept in a workspace: one small file a command, so that no store needs appends."""

from __future__ import annotations

import json
import time

from .files import Store

FOLDER = "_sessions"
DAY_MS = 86_400_000


class History:
    """Sessions of a workspace, numbered from 1. A session is open until it is ended."""

    def __init__(self, store: Store):
        self.store = store
        self._next: dict[int, int] = {}

    def begin(self, client: str) -> int:
        """The number of a new session of a client."""
        number = max([0, *self.sessions()]) + 1
        self._write(number, "begin", {"client": client, "ts_ms": _now()})
        return number

    def record(self, number: int, command: str) -> None:
        at = self._next.get(number, len(self._names(number, "c")))
        self._write(number, f"c{at:08d}", {"command": command, "ts_ms": _now()})
        self._next[number] = at + 1

    def end(self, number: int) -> None:
        self._write(number, "end", {"ts_ms": _now()})

    def sessions(self) -> list[int]:
        return sorted(int(n) for n in self.store.names(FOLDER, folders=True) if n.isdigit())

    def commands(self, number: int) -> list[str]:
        """A session's commands in order; none of an unknown session."""
        return [self._read(number, n)["command"] for n in self._names(number, "c")]

    def info(self, number: int) -> dict | None:
        """client, began, ended (None while open) and commands of a session; None of an unknown one."""
        if not self._names(number, "begin"):
            return None
        begun = self._read(number, "begin.json")
        ended = self._read(number, "end.json")["ts_ms"] if self._names(number, "end") else None
        return {"client": begun["client"], "began": begun["ts_ms"], "ended": ended, "commands": len(self._names(number, "c"))}

    def cleanup(self, days: int) -> list[int]:
        """Delete sessions that ended more than so many days ago."""
        limit = _now() - days * DAY_MS
        gone = [n for n in self.sessions() if ((self.info(n) or {}).get("ended") or limit) < limit]
        for number in gone:
            self.store.delete(f"{FOLDER}/{number}")
        return gone

    def _names(self, number: int, start: str) -> list[str]:
        return [n for n in self.store.names(f"{FOLDER}/{number}", folders=False) if n.startswith(start) and n.endswith(".json")]

    def _read(self, number: int, name: str) -> dict:
        return json.loads(self.store.read(f"{FOLDER}/{number}/{name}"))

    def _write(self, number: int, name: str, row: dict) -> None:
        self.store.write(f"{FOLDER}/{number}/{name}.json", json.dumps(row), overwrite=False)


def _now() -> int:
    return int(time.time() * 1000)
