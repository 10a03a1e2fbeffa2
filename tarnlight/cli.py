"""Command line: index, query and map over a configuration of lookups."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import sys
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators import ingest
from tarnlight.plans import mapping, retrieval
from tarnlight.session import session
from tarnlight.sources.config import Config, ConfigError, Lookup, config_path, load_config, resolve_lookups, selected_for_map
from tarnlight.sources.files import build_mode, chunked, scan, to_index


def embedder(name: str) -> Callable:
    """A function by module:name, such as one that turns a list of texts into vectors."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def store_of(spark: SparkSession, lookup: Lookup) -> ingest.Store:
    if not lookup.db_file:
        raise ConfigError(f"lookup {lookup.name!r} has no db")
    return ingest.Store(spark, f"{lookup.db_file}/{lookup.db_table}")


def chunks_of(spark: SparkSession, lookups: list[Lookup]) -> DataFrame:
    """Chunks of the lookups that have an index."""
    found = [c for c in (store_of(spark, x).chunks() for x in lookups) if c is not None]
    if not found:
        raise ConfigError("none of the lookups has an index")
    return reduce(DataFrame.unionByName, found)


def run_index(spark: SparkSession, config: Config, embed: Callable, mode: str = "delta", allow_empty_prune: bool = False, workers: int = 4) -> list[dict]:
    """Indexes the lookups, so many at once; gives their summaries in the configuration's order."""

    def one(lookup: Lookup) -> list[dict]:
        started = dt.datetime.now(dt.timezone.utc)
        store = store_of(spark, lookup)
        files = scan(spark, lookup.dir, lookup.name_match)
        full = build_mode(mode, store.chunks() is not None, store.last_scan()) == "full"
        read = chunked(to_index(files, None if full else store.last_scan()), lookup.name, lookup.reader)
        matched = files.select(F.lit(lookup.name).alias("lookup"), "path")
        return [r.asDict() for r in ingest.index(store, matched, read, embed, started, allow_empty_prune).collect()]

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return [row for rows in pool.map(one, config.lookups) for row in rows]


def text_index_of(spark: SparkSession, lookups: list[Lookup]) -> tuple[DataFrame, DataFrame] | None:
    """The full-text index of the lookups that have chunks; None if one of them has none."""
    stores = [s for s in (store_of(spark, x) for x in lookups) if s.chunks() is not None]
    found = [s.text_index() for s in stores]
    if not found or None in found:
        return None
    return reduce(DataFrame.unionByName, [x.lengths for x in found]), reduce(DataFrame.unionByName, [x.postings for x in found])


def run_query(spark: SparkSession, config: Config, embed: Callable, text: str, names: list[str] | None = None, top: int = 10, concise: bool = True, brief_chars: int = 300, chat: Callable | None = None) -> list[dict]:
    """Files for a query over the lookups' chunks and full-text indexes; with chat, a function from a prompt to a reply, the query is expanded."""
    lookups = resolve_lookups(config, names)
    options = {"lookups": [x.name for x in lookups], "thresholds": {x.name: x.threshold for x in lookups}, "index": text_index_of(spark, lookups)}
    chunks, cache = chunks_of(spark, lookups), retrieval.EmbedCache(lambda t: embed([t])[0])
    if chat is None:
        found = retrieval.retrieve_q(chunks, text, cache, top, **options)
    else:
        found = retrieval.retrieve_q_plus(chunks, text, cache, lambda q: chat(f"Say this search query in other words, in one line:\n{q}"), lambda q: chat(f"Keywords for this search query, with commas between them:\n{q}"), top, **options)
    return [r.asDict(recursive=True) for r in (retrieval.compact(found.files, brief_chars) if concise else found.files).collect()]


def shown(rows: list[dict], form: str) -> str:
    """Rows as JSON, JSON lines or ranked text."""
    if form == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2)
    if form == "jsonl":
        return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    return "\n".join(f"{i}. {r['score']:.4f} {r.get('file') or r.get('path')} [{r.get('path') if 'file' in r and 'path' in r else r['lookup']}]" for i, r in enumerate(rows, 1))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnlight")
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("--build-mode", choices=["delta", "full"], default="delta")
    index.add_argument("--allow-empty-prune", action="store_true")
    query = sub.add_parser("query")
    query.add_argument("text")
    query.add_argument("-p", "--paths", default="", help="names of lookups, with commas")
    query.add_argument("-l", "--limit", type=int, default=10)
    query.add_argument("-f", "--format", choices=["json", "jsonl", "text"], default="text")
    query.add_argument("--full", action="store_true")
    query.add_argument("--brief-chars", type=int, default=300)
    query.add_argument("--plus", metavar="CHAT", help="expand the query by module:function from a prompt to a reply")
    chart = sub.add_parser("map")
    chart.add_argument("--include", default=None)
    chart.add_argument("--stage", choices=mapping.STAGES, default="all")
    chart.add_argument("--seed", type=int)
    chart.add_argument("--output", type=Path)
    chart.add_argument("--debug", action="store_true")
    for p in (index, query, chart):
        p.add_argument("-c", "--config")
    for p in (index, query):
        p.add_argument("--embedder", required=True, help="module:function from a list of texts to vectors")
    return top


def main(words: Sequence[str] | None = None) -> int:
    args = parser().parse_args(words)
    try:
        config = load_config(config_path(args.config))
        spark = session("tarnlight")
        if args.command == "index":
            rows = run_index(spark, config, embedder(args.embedder), args.build_mode, args.allow_empty_prune)
            print(json.dumps(rows, indent=2))
            return int(any(r["errors"] for r in rows))
        if args.command == "query":
            names = [n for n in args.paths.split(",") if n.strip()]
            print(shown(run_query(spark, config, embedder(args.embedder), args.text, names, args.limit, not args.full, args.brief_chars, embedder(args.plus) if args.plus else None), args.format))
            return 0
        settings = config.settings.get("map") or {}
        options = mapping.MapOptions.of(settings)
        options = mapping.replace(options, stage=args.stage, seed=options.seed if args.seed is None else args.seed)
        built = mapping.build(chunks_of(spark, selected_for_map(config, args.include)), options)
        target = args.output or Path(settings.get("path") or "map_data.json")
        mapping.write_json(mapping.payload(built, cache=target.with_name(target.name + ".labels.json")), target)
        if args.debug:
            mapping.write_json(mapping.debug(built), target.with_name(target.name + ".debug.json"))
        return 0
    except (ConfigError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
