"""A small DB-API 2.0 facade over the query engine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from cairnlake.plans.engine import Engine, QueryError

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    pass


class DatabaseError(Error):
    pass


class ProgrammingError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class Cursor:
    """Rows of one execution; ``truncated`` says why there are no more, if so."""

    arraysize = 100

    def __init__(self, engine: Engine):
        self._engine, self._rows, self._at = engine, [], 0
        self.description: list[tuple] | None = None
        self.rowcount, self.truncated, self.closed = -1, None, False

    def execute(self, sql: str, params: Sequence[Any] = ()) -> Cursor:
        if self.closed:
            raise ProgrammingError("the cursor is closed")
        try:
            r = self._engine.execute(sql, params)
        except QueryError as e:
            raise (ProgrammingError if e.code == "sql_invalid" else OperationalError)(f"{e.code}: {e.message}") from None
        self.description = [(n, t, None, None, None, None, None) for n, t in zip(r.columns, r.types)]
        self._rows, self._at, self.rowcount, self.truncated = [tuple(x) for x in r.rows], 0, len(r.rows), r.truncated
        return self

    def executemany(self, sql: str, many: Sequence[Sequence[Any]]) -> Cursor:
        for params in many:
            self.execute(sql, params)
        return self

    def fetchone(self) -> tuple | None:
        rows = self.fetchmany(1)
        return rows[0] if rows else None

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        if self.description is None:
            raise ProgrammingError("nothing was executed")
        out = self._rows[self._at : self._at + (size or self.arraysize)]
        self._at += len(out)
        return out

    def fetchall(self) -> list[tuple]:
        return self.fetchmany(len(self._rows) or 1)

    def __iter__(self) -> Iterator[tuple]:
        while row := self.fetchone():
            yield row

    def close(self) -> None:
        self.closed = True


class Connection:
    def __init__(self, engine: Engine):
        self._engine, self._closed = engine, False

    def cursor(self) -> Cursor:
        if self._closed:
            raise ProgrammingError("the connection is closed")
        return Cursor(self._engine)

    def commit(self) -> None:
        """Queries only read: there is nothing to commit."""

    def rollback(self) -> None:
        """Queries only read: there is nothing to undo."""

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def connect(engine: Engine) -> Connection:
    return Connection(engine)
