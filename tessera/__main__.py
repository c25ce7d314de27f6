"""python -m tessera build (--file PATH | --url URL) --read-as owl|rdf|skos [--out DIR] [--lang en]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.engine import Ontology
from .sinks.site import write_site


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    build = parser.add_subparsers(dest="command", required=True).add_parser("build", help="write a static documentation site")
    source = build.add_mutually_exclusive_group(required=True)
    source.add_argument("--url")
    source.add_argument("--file")
    build.add_argument("--read-as", required=True, choices=["owl", "rdf", "skos"])
    build.add_argument("--out", default="./site")
    build.add_argument("--lang", default="en")
    build.add_argument("--imported", action="store_true")
    build.add_argument("--closure", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    own = Ontology.load(spark, given.url or given.file, given.read_as, given.imported, given.closure)
    n = write_site(own.view(given.lang), own.page_values(given.lang), given.out, given.read_as)
    print(f"{n} pages in {given.out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
