"""Command line: setup, search, add, remove, watch, stats, history, config, reset, completion.

Exit codes: 0 done; 1 nothing found, not watched, locked or cancelled; 2 no index, or a path that is no folder.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import asdict

from glintdex.engine import Engine
from glintdex.sources import settings
from glintdex.sources.storage import Locked, Missing

VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glintdex", description="Search folders of text files.")
    p.add_argument("--version", action="version", version=f"glintdex {VERSION}")
    p.add_argument("--index", help="the index's folder on shared storage")
    p.add_argument("--home", default=os.path.expanduser("~/.glintdex"))
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    for flag in ("fuzzy", "prefix", "regex"):
        s.add_argument(f"--{flag}", action="store_true")
    for option in ("ext", "min-size", "modified-after"):
        s.add_argument(f"--{option}")
    for name in ("add", "remove"):
        sub.add_parser(name).add_argument("path")
    for name in ("watch", "stats", "config"):
        sub.add_parser(name)
    h = sub.add_parser("history")
    h.add_argument("-n", "--limit", type=int, default=20)
    h.add_argument("--clear", action="store_true")
    sub.add_parser("reset").add_argument("-y", "--yes", action="store_true")
    f = sub.add_parser("setup", help="a first run: indexes folders of the user's home")
    f.add_argument("-y", "--yes", action="store_true")
    f.add_argument("--quick", action="store_true", help="smaller limits for files that are read")
    f.add_argument("--user-home", default="~")
    sub.add_parser("completion", help="a script for bash")
    return p


def completion() -> str:
    """Completes commands and, after one, its options; made from the parser."""
    commands = next(a.choices for a in parser()._actions if isinstance(a, argparse._SubParsersAction))
    cases = "\n".join(f"    {name}) words='{' '.join(o for a in own._actions for o in a.option_strings)}' ;;" for name, own in commands.items())
    return f"""_glintdex() {{
  local words='{" ".join(commands)}'
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -o default -F _glintdex glintdex"""


def _setup(engine: Engine, a: argparse.Namespace) -> int:
    """Offers the folders of the user's home; keeps the smaller limits if asked to."""
    if a.quick:
        config, quick = engine.config, settings.Config.quick()
        config.max_text_bytes, config.max_pdf_bytes = quick.max_text_bytes, quick.max_pdf_bytes
        settings.save(engine.home, config)
    chosen = [p for p in settings.home_folders(a.user_home) if a.yes or input(f"Index {p}? [y/N] ").strip().lower() == "y"]
    for path in chosen:
        print(path, json.dumps(asdict(engine.add(path))))
    return 0 if chosen else 1


def _search(engine: Engine, a: argparse.Namespace) -> int:
    options = {"fuzzy": a.fuzzy, "prefix": a.prefix, "regex": a.regex, "ext": a.ext, "min_size": a.min_size, "modified_after": a.modified_after}
    if a.verbose:
        print(json.dumps({k: v for k, v in engine.explain(a.query, **options).items() if k != "plan"}))
    start = time.monotonic()
    total = engine.search(a.query, **options).count()
    for r in engine.top(a.query, before="\x1b[1;33m", after="\x1b[0m", **options).collect():
        print(f"[{r['rank']}] {r['score']:.3f}  {r['path']}  ({r['extension'] or 'no ext'}, {r['size_bytes']} B)\n    {r['snippet']}")
    print(f"{total} results in {1000 * (time.monotonic() - start):.0f} ms")
    if not total:
        print("Try --fuzzy for typos, --prefix for the beginning of a word, or fewer filters.")
    return 0 if total else 1


def _watch(engine: Engine) -> None:
    running = engine.watch(on_event=lambda what, path: print(time.strftime("[%H:%M:%S]"), what, path, flush=True))
    try:
        running.awaitTermination()
    except KeyboardInterrupt:
        print("stopped")
    finally:
        running.stop()


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "completion":
        print(completion())
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("glintdex").getOrCreate()
    engine = Engine(spark, a.home, a.index)
    try:
        if a.command == "setup":
            return _setup(engine, a)
        if a.command == "search":
            return _search(engine, a)
        if a.command == "add":
            print(json.dumps(asdict(engine.add(a.path))))
        elif a.command == "remove":
            print(f"{engine.remove(a.path)} documents removed")
        elif a.command == "watch":
            _watch(engine)
        elif a.command == "stats":
            print(json.dumps(engine.location()))
            for name, df in engine.stats().items():
                print(name)
                df.show(truncate=False)
        elif a.command == "history":
            if a.clear:
                engine.clear_history()
            print("\n".join(engine.history(a.limit)))
        elif a.command == "config":
            print(json.dumps(asdict(engine.config) | {"missing": engine.config.missing(), "index": engine.store.exists()}, indent=1))
        elif a.command == "reset":
            if not a.yes and input("Delete index, configuration and history? [y/N] ").strip().lower() != "y":
                return 1
            engine.reset()
    except (Missing, NotADirectoryError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except (Locked, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
