"""The query registry and the shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    covers: tuple[str, ...]
    statement: str | None
    needs: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        """The checking SQL with the fragments it reads in front."""
        return None if self.statement is None else with_fragments(self.statement, *self.needs)


QUERIES: dict[str, Query] = {}
# A factor just above one: figures that fall on a rounding tie round up on both engines.
TIE = 1.00000000001
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, body: str, *needs: str) -> None:
    """A named subquery that ``with_fragments`` can put in front of a statement."""
    FRAGMENTS[name] = (needs, body.strip())


def with_fragments(statement: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in FRAGMENTS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    statement = statement.replace(" TIE,", f" {TIE!r}e0,")
    if not ordered:
        return statement.strip()
    parts = ",\n".join(f"{n} AS (\n{FRAGMENTS[n][1]}\n)" for n in ordered)
    return f"WITH {parts}\n{statement.strip()}"


def query(name: str, covers: str, sql: str | None = None, needs: str = "") -> Callable[[Build], Build]:
    """Register a query; ``covers`` are inventory rows, ``needs`` the fragments its SQL reads."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, build, tuple(covers.split()), sql, tuple(needs.split()))
        return build

    return register
