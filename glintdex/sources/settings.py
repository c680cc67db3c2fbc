"""Configuration as JSON and search history as tab-separated lines, both small and on the driver."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintdex.functions.text import EXTENSIONS, IGNORED

HISTORY = 500


@dataclass
class Config:
    watched: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=lambda: list(IGNORED))
    #: Shown only; files are taken by the fixed list.
    supported: list[str] = field(default_factory=lambda: [e for e in EXTENSIONS if e != ".yaml"])
    max_text_bytes: int = 15 << 20
    max_pdf_bytes: int = 5 << 20

    @classmethod
    def quick(cls) -> Config:
        """The smaller limits that a first run may choose."""
        return cls(max_text_bytes=5 << 20, max_pdf_bytes=2 << 20)

    def add(self, path: str) -> None:
        if path not in self.watched:
            self.watched.append(path)

    def remove(self, path: str) -> bool:
        found = path in self.watched
        if found:
            self.watched.remove(path)
        return found

    def is_ignored(self, name: str) -> bool:
        return name in self.ignored

    def is_supported(self, extension: str) -> bool:
        return extension.lower() in self.supported

    def missing(self) -> list[str]:
        return [p for p in self.watched if not os.path.isdir(p)]


def expand(path: str) -> str:
    """``~`` and relative parts resolved."""
    if not path or not path.strip():
        raise ValueError("a path is needed")
    return os.path.abspath(os.path.expanduser(path.strip()))


def home_folders(home: str = "~", most: int = 8) -> list[str]:
    """The first visible folders of the user's home, which a first run offers to index."""
    home = expand(home)
    return sorted(d.path for d in os.scandir(home) if d.is_dir() and not d.name.startswith("."))[:most]


def load(home: str) -> Config:
    path = os.path.join(home, "config.json")
    if not os.path.exists(path):
        return Config()
    with open(path) as f:
        return Config(**json.load(f))


def save(home: str, config: Config) -> None:
    os.makedirs(home, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=home, delete=False) as f:
        json.dump(asdict(config), f, indent=1)
    os.replace(f.name, os.path.join(home, "config.json"))


def delete(home: str) -> None:
    for name in ("config.json", "history.tsv"):
        if os.path.exists(os.path.join(home, name)):
            os.unlink(os.path.join(home, name))


def remember(home: str, query: str | None, now: datetime | None = None) -> None:
    """Adds a query; blank ones are not kept, nor more than ``HISTORY``."""
    if not query or not query.strip():
        return
    os.makedirs(home, exist_ok=True)
    path = os.path.join(home, "history.tsv")
    with open(path, "a") as f:
        f.write(f"{(now or datetime.now()).strftime('%Y-%m-%dT%H:%M:%S')}\t{query.strip()}\n")
    with open(path) as f:
        lines = f.readlines()
    if len(lines) > HISTORY:
        with open(path, "w") as f:
            f.writelines(lines[-HISTORY:])


def history(home: str, limit: int = 20) -> list[str]:
    """The latest first."""
    path = os.path.join(home, "history.tsv")
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return [x for x in (line.rstrip("\n") for line in reversed(f.readlines())) if x.strip()][:limit]


def clear_history(home: str) -> None:
    path = os.path.join(home, "history.tsv")
    if os.path.exists(path):
        os.unlink(path)


def recent(lines: DataFrame, limit: int = 20) -> DataFrame:
    """The latest of ``lines`` (line, query, ...), those with the highest line, without blank queries."""
    return lines.where(F.trim("query") != "").orderBy(F.desc("line")).limit(limit)


def trimmed(lines: DataFrame) -> DataFrame:
    """The lines that a history keeps."""
    return lines.orderBy(F.desc("line")).limit(HISTORY)


def history_table(spark: SparkSession, home: str) -> DataFrame:
    """line number (1 for the oldest), ts and query."""
    own = history(home, HISTORY)
    lines = [(len(own) - i, *x.split("\t", 1)) for i, x in enumerate(own) if "\t" in x]
    made = spark.createDataFrame(lines, "line int, at string, query string")
    return trimmed(made.select("line", F.to_timestamp("at", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "query"))
