"""Run registered queries from the command line: python -m lakeloom SETTINGS.json QUERY... [--format parquet|csv] [--list]."""

from __future__ import annotations

import argparse
import sys

from lakeloom import plans
from lakeloom.session import load_settings, preflight, session
from lakeloom.sources.reports import write_csv, write_json, write_parquet


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakeloom")
    parser.add_argument("settings", nargs="?")
    parser.add_argument("queries", nargs="*")
    parser.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    parser.add_argument("--list", action="store_true", help="name the queries and stop")
    given = parser.parse_args(arguments)
    if given.list:
        print("\n".join(sorted(plans.QUERIES)))
        return 0
    if not given.settings:
        parser.error("settings are needed")
    unknown = [q for q in given.queries if q not in plans.QUERIES]
    if unknown:
        parser.error(f"no such query: {', '.join(unknown)}")
    settings = load_settings(given.settings)
    found = preflight(settings)
    if not found["ok"]:
        print("\n".join(found["problems"]), file=sys.stderr)
        return 2
    spark, write, done = session(settings), {"parquet": write_parquet, "csv": write_csv}[given.format], {}
    for name in given.queries:
        done[name] = write(plans.QUERIES[name](spark, settings.path(settings.tables)), f"{settings.path(settings.output)}/{name}")
    write_json(spark, {"status": "success", "outputs": done}, f"{settings.path(settings.output)}/report")
    return 0


if __name__ == "__main__":
    sys.exit(main())
