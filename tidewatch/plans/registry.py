"""Catalogue of named queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    body: str | None

    @property
    def oracle(self) -> str | None:
        """The full statement; blocks are looked up only now, when all modules are loaded."""
        return with_blocks(self.body) if self.body else None


CATALOGUE: dict[str, Entry] = {}
# Named SQL building blocks; one may use others.
BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    if name in BLOCKS:
        raise ValueError(f"block defined twice: {name}")
    BLOCKS[name] = sql.strip()


def with_blocks(body: str) -> str:
    """Prefix a statement with the blocks it uses, directly or through other blocks."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(BLOCKS[name])
                ordered.append(name)

    visit(body)
    parts = [f"{n} AS (\n{BLOCKS[n]}\n)" for n in ordered]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body.strip()


def query(name: str, oracle: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query registered twice: {name}")
        CATALOGUE[name] = Entry(build, oracle)
        return build

    return add
