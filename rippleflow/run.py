"""Command line of the simulation: runs of a file of configurations over a data directory, as run records.

    python -m rippleflow.run --data DIR --configs FILE --out DIR [--first N --last N] [--master M]

FILE holds one JSON list of configurations (the columns of plans.simulate.CONFIG and, if need be, OPTIONS). OUT gets one
JSON record a run, in the shape that sources.tables.run_records reads; a run that fails has its error as its record.
--first and --last take a slice of the configurations by run_id, so that jobs can share a file.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import session
from .operators.iterate import cut
from .plans import campaign, simulate
from .sources import sinks, tables
from .sources.adapter import Network

log = logging.getLogger("rippleflow.run")


def run(spark: SparkSession, data: str, configs: str, out: str, first: int | None = None, last: int | None = None) -> int:
    """Simulates and writes; the number of records with an error."""
    every = tables.json_list(spark, configs, f"{simulate.CONFIG}, {simulate.OPTIONS}")
    mine = cut(every.where((F.col("run_id") >= first if first is not None else F.lit(True)) & (F.col("run_id") <= last if last is not None else F.lit(True))))
    world = campaign._world(Network(spark, data))
    log.info("%d firms, %d links", len(world.size), len(world.edges))
    series, firms = (cut(simulate.simulate(mine, world, what)) for what in ("series", "firms"))
    sinks.json_lines(simulate.records(mine, series, firms), out)
    failed = series.where("error IS NOT NULL").select("run_id", "error").orderBy("run_id").collect()  # a row a failed run
    for r in failed:
        log.warning("run %d: %s", r["run_id"], r["error"])
    log.info("%d runs, %d failed", mine.count(), len(failed))
    return len(failed)


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("data", "configs", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--first", type=int)
    parser.add_argument("--last", type=int)
    parser.add_argument("--master")
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    return 1 if run(session.build(a.master), a.data, a.configs, a.out, a.first, a.last) else 0


if __name__ == "__main__":
    raise SystemExit(main())
