"""python -m graticula list | info NAME | points NAME [--limit N] | latitudes N: grids from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graticula.sources import grids


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graticula", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="patterns of grid names")
    info = sub.add_parser("info", help="size, rows and bounds of a grid, as JSON")
    info.add_argument("name")
    points = sub.add_parser("points", help="points of a grid, one JSON line each")
    points.add_argument("name")
    points.add_argument("--limit", type=int, default=10)
    latitudes = sub.add_parser("latitudes", help="Gaussian latitudes and weights")
    latitudes.add_argument("n", type=int)
    args = parser.parse_args(argv)
    if args.what == "list":
        print("\n".join(pattern for pattern, _ in grids.BUILDERS))
        return
    if args.what == "latitudes":
        for lat, w in zip(grids.gaussian_latitudes(args.n), grids.gaussian_weights(args.n), strict=True):
            print(f"{lat:.12f} {w:.15f}")
        return
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    grid = grids.grid(spark, args.name)
    if args.what == "info":
        size = grid.agg(F.count("*").alias("points"), F.countDistinct("j").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))))
        print(json.dumps({"name": args.name, "uid": grids.uid({"name": args.name}), **size.first().asDict()}))
    else:
        for row in grid.orderBy("gidx").limit(args.limit).toJSON().collect():  # as many as asked for
            print(row)


if __name__ == "__main__":
    main()
