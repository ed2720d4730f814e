"""Connector registry: the first connector that accepts a URL serves it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Read = Callable[[SparkSession, str, bool], DataFrame]
Write = Callable[[DataFrame, str, dict], None]


@dataclass(frozen=True)
class Connector:
    """``accepts(url)``; ``read(spark, url, recursive)`` gives ``path, content``; ``write(df, url, options)``."""

    accepts: Callable[[str], bool]
    read: Read
    write: Write | None = None


@dataclass
class Registry:
    connectors: list[Connector] = field(default_factory=list)

    def register(self, connector: Connector) -> None:
        self.connectors.append(connector)

    def find(self, url: str) -> Connector:
        for connector in self.connectors:
            if connector.accepts(url):
                return connector
        raise ValueError(f"no connector accepts {url}")
