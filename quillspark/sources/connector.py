"""Connectors as a streaming data source: a handler pulls items and a new state; the state is the stream's offset, so it is kept with the
query's checkpoint, and items are delivered again after a failure, never lost.

    spark.dataSource.register(ConnectorSource)
    spark.readStream.format("quillspark_connector").option("type", "folder").option("config", '{"path": "/notes"}').load()

Defined cases: an unknown type is an error when the stream starts; a handler that fails leaves the state as it was."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

Pulled = tuple[list[tuple[str, str, str]], dict]
HANDLERS: dict[str, Callable[[dict, dict], Pulled]] = {}


def handler(name: str) -> Callable:
    """Register a function (config, state) -> (items (id, title, content), new state)."""

    def add(f: Callable[[dict, dict], Pulled]) -> Callable[[dict, dict], Pulled]:
        HANDLERS[name] = f
        return f

    return add


@handler("folder")
def pull_folder(config: dict, state: dict, most: int = 500) -> Pulled:
    """Files below config['path'] whose modification time isn't the one of the state, at most `most` by path; hidden folders are skipped."""
    suffixes = tuple(config.get("suffixes", (".md", ".txt", ".html", ".rst", ".org", ".tex", ".adoc")))
    now: dict[str, float] = {}
    for root, dirs, names in os.walk(config["path"]):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        for n in names:
            if n.endswith(suffixes):
                p = os.path.join(root, n)
                now[p] = os.path.getmtime(p)
    before = state.get("mtimes", {})
    changed = [p for p in sorted(now) if before.get(p) != now[p]][:most]
    items = []
    for p in changed:
        with open(p, encoding="utf-8", errors="replace") as f:
            items.append((p, os.path.splitext(os.path.basename(p))[0].replace("-", " ").replace("_", " "), f.read()))
    kept = {p: t for p, t in before.items() if p in now and p not in changed}
    return items, {"mtimes": kept | {p: now[p] for p in changed}}


class ConnectorReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.kind, self.config = options["type"], json.loads(options.get("config", "{}"))
        if self.kind not in HANDLERS:
            raise ValueError(f"no such connector: {self.kind}")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"state": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        items, state = HANDLERS[self.kind](self.config, json.loads(start["state"]))
        return iter(items), {"state": json.dumps(state, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        items, _ = HANDLERS[self.kind](self.config, json.loads(start["state"]))
        return iter(items)


class ConnectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillspark_connector"

    def schema(self) -> str:
        return "id string, title string, content string"

    def simpleStreamReader(self, schema) -> ConnectorReader:  # noqa: N802, ANN001
        return ConnectorReader(dict(self.options))
