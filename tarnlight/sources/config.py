"""Lookups from a JSON configuration."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLE = re.compile(r"(?!\d)\w+", re.ASCII)


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Lookup:
    name: str
    reader: str = "markdown"
    threshold: float = 0.0
    dir: str = ""
    db_file: str = ""
    db_table: str = ""
    name_match: str | None = None
    url: str | None = None
    search_default: bool = False


@dataclass(frozen=True)
class Config:
    lookups: list[Lookup]
    settings: dict = field(default_factory=dict)


def config_path(given: str | None = None, home: Path | None = None) -> Path:
    """The given path, else ./config.json if there, else the one in the user's settings."""
    if given:
        return Path(given).expanduser()
    here = Path("config.json")
    return here if here.exists() else (home or Path.home()) / ".config" / "tarnlight" / "config.json"


def parse_target(db: str) -> tuple[str, str]:
    """file@table, split at the last @."""
    file, at, name = str(db).rpartition("@")
    if not at or not file.strip() or not name.strip():
        raise ConfigError(f"db must be file@table: {db!r}")
    if not TABLE.fullmatch(name):
        raise ConfigError(f"invalid table name: {name!r}")
    return file, name


def parse_config(data: dict) -> Config:
    found: list[Lookup] = []
    for entry in data.get("paths") or []:
        name = str(entry.get("name") or "").strip()
        if not name:
            raise ConfigError("a lookup needs a name")
        if any(x.name == name for x in found):
            raise ConfigError(f"two lookups are named {name!r}")
        file, table = parse_target(entry["db"]) if entry.get("db") else ("", "")
        found.append(Lookup(name, entry.get("reader") or "markdown", float(entry.get("threshold") or 0), entry.get("dir") or "", file, table, entry.get("nameMatch"), entry.get("url"), bool(entry.get("searchDefault"))))
    return Config(found, {k: v for k, v in data.items() if k != "paths"})


def load_config(path: str | Path) -> Config:
    return parse_config(json.loads(Path(path).read_text(encoding="utf-8")))


def resolve_lookups(config: Config, names: list[str] | None, default_only: bool = True) -> list[Lookup]:
    """The named lookups, blanks and repeats dropped, unknown names passed over; without names the search defaults, or all."""
    wanted = list(dict.fromkeys(n.strip() for n in names or [] if n and n.strip()))
    if wanted:
        by_name = {x.name: x for x in config.lookups}
        return [by_name[n] for n in wanted if n in by_name]
    chosen = [x for x in config.lookups if x.search_default] if default_only else []
    return chosen or config.lookups


def selected_for_map(config: Config, given: str | None) -> list[Lookup]:
    """Lookups of a map: a comma or JSON list, else map.includePaths, else all; in the configuration's order, unknown ones an error."""
    names = (json.loads(given) if given.strip().startswith("[") else given.split(",")) if given else (config.settings.get("map") or {}).get("includePaths") or []
    wanted = [str(n).strip() for n in names if str(n).strip()]
    if unknown := set(wanted) - {x.name for x in config.lookups}:
        raise ConfigError(f"unknown lookups: {', '.join(sorted(unknown))}")
    return [x for x in config.lookups if not wanted or x.name in wanted]


def lookup_table(spark: SparkSession, lookups: list[Lookup]) -> DataFrame:
    schema = "lookup string, reader string, threshold double, url string, search_default boolean, dir string, name_match string"
    return spark.createDataFrame([(x.name, x.reader, x.threshold, x.url, x.search_default, x.dir, x.name_match) for x in lookups], schema)


def health(path: str | Path) -> dict:
    """That a configuration can be read, where it is and the digest of its bytes."""
    data = Path(path).read_bytes()
    parse_config(json.loads(data))
    return {"status": "ok", "config": str(path), "configDigest": hashlib.sha256(data).hexdigest()}
