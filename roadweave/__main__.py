"""Command line: ``python -m roadweave route`` and ``python -m roadweave days``."""

from __future__ import annotations

import argparse
import dataclasses
import os

from pyspark.sql import SparkSession

from .config import PlannerConfig
from .plans.engine import PlanResult, plan_days, plan_route
from .sources.depot import address_search, parse_place, resolve_depot
from .sources.network import http_fetcher
from .sources.project import read_sections

#: Folder of the road tiles, under the user's home.
CACHE = os.path.join("~", ".cache", "roadweave", "tiles")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="roadweave", description="Plan the driving of road sections from a KML file or a map project (.mpz).")
    programs = parser.add_subparsers(dest="program", required=True)
    route = programs.add_parser("route", help="one continuous route over all open sections")
    route.add_argument("input", help="KML file or map project")
    route.add_argument("--gpx", default="survey_route.gpx", help="track file")
    route.add_argument("--html", default="route_preview.html", help="map page")
    route.add_argument("--mpz", default="survey_route.mpz", help="map project; '' to skip it")
    route.add_argument("--start", metavar="LAT,LON", help="place to start from")
    days = programs.add_parser("days", help="balanced days from a depot and back")
    days.add_argument("input", help="KML file or map project")
    days.add_argument("--hotel", "--depot", dest="depot", required=True, metavar="ADDRESS_OR_LATLON", help="where every day starts and ends")
    days.add_argument("--hours", type=float, default=PlannerConfig.shift_hours, help="driving hours of a day at most")
    days.add_argument("--collect-mph", type=float, default=PlannerConfig.collect_mph, help="average speed while collecting")
    days.add_argument("--transfer-mph", type=float, default=PlannerConfig.transfer_mph, help="average speed on transfers")
    days.add_argument("--min-miles", type=float, help="flag days under so many miles in all")
    days.add_argument("--days", type=int, help="number of days (else sized from --hours, five at most)")
    days.add_argument("--lock", type=int, metavar="N", help="lock in day N and write remaining_segments.mpz")
    days.add_argument("--out-dir", default="daily_plan", help="folder for the files")
    for program in (route, days):
        program.add_argument("--no-osm", action="store_true", help="fetch no roads; transfers may leave them")
        program.add_argument("--cache", default=CACHE, help="folder of fetched road tiles")
    return parser


def run(spark: SparkSession, given: list[str]) -> PlanResult:
    """Do what a command line says; wrong values end it like an unknown option does."""
    parser = arguments()
    args = parser.parse_args(given)
    roads = {} if args.no_osm else {"fetch": http_fetcher(), "cache_folder": os.path.expanduser(args.cache)}
    if args.program == "route":
        start = parse_place(args.start) if args.start else None
        if args.start and start is None:
            parser.error("--start must be LAT,LON")
        title = os.path.splitext(os.path.basename(args.input))[0] + "_route"
        names = {"gpx": args.gpx, "html": args.html, "mpz": args.mpz, "title": title}
        result = plan_route(spark, read_sections(spark, args.input), start, out_dir=".", names=names, **roads)
        print(result.summary())
        return result
    config = dataclasses.replace(PlannerConfig(), shift_hours=args.hours, collect_mph=args.collect_mph, transfer_mph=args.transfer_mph)
    depot = resolve_depot(args.depot, address_search())
    result = plan_days(spark, read_sections(spark, args.input), depot, args.days, args.lock, args.min_miles, out_dir=args.out_dir, config=config, **roads)
    print(result.report)
    return result


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("roadweave").getOrCreate(), sys.argv[1:])
