"""Ingest plugins: functions from (path, text) rows to triplet rows, by name or extension."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Plugin:
    """What a plugin is called, which extensions it takes, and what it does."""

    name: str
    extensions: tuple[str, ...]
    ingest: Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Plugins in order of registration; the first that fits is used, whatever the case."""

    plugins: list[Plugin] = field(default_factory=list)

    def register(self, plugin: Plugin) -> None:
        """Add a plugin."""
        self.plugins.append(plugin)

    def by_extension(self, path: str) -> Plugin | None:
        """The plugin for a file."""
        ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
        return next((p for p in self.plugins if ext in (e.lower().lstrip(".") for e in p.extensions)), None)

    def by_name(self, name: str) -> Plugin | None:
        """The plugin of a name."""
        return next((p for p in self.plugins if p.name.lower() == name.lower()), None)
