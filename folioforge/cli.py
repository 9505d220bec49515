"""Harvest a feed into the record table: python -m folioforge.cli --store FOLDER --base-url URL ...

Exit codes: 0 done, 2 a setting is wrong, 3 the feed reported an error.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .engine import Engine
from .sources import feed
from .sources.store import Folder
from .streaming import ingest


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="folioforge", description="Harvests a feed's records into versioned tables.")
    p.add_argument("--store", help="folder of tables, landed pages and checkpoints, in any store that Spark reaches")
    p.add_argument("--base-url", help="the feed's address")
    p.add_argument("--prefixes", default=",".join(feed.PREFIXES), help="passes, in order, with commas between them")
    p.add_argument("--from", dest="since", help="earliest datestamp")
    p.add_argument("--until", help="latest datestamp")
    p.add_argument("--set", dest="set_spec", help="the feed's set")
    p.add_argument("--state-file", help="where the passes' tokens are kept (default: state.json in the store)")
    p.add_argument("--resume", action="store_true", help="go on behind the last landed page")
    p.add_argument("--timeout", type=float, default=60, help="seconds for a page")
    p.add_argument("--sleep", type=float, default=0.5, help="seconds between pages")
    p.add_argument("--max-pages", type=int, default=0, help="pages a pass, 0: all")
    p.add_argument("--max-records", type=int, default=0, help="records a pass, looked at between pages, 0: all")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, get: Callable = feed.fetch, say: Callable[[str], None] = print) -> int:
    a = arguments(argv)
    try:
        prefixes = feed.prefixes_of(a.prefixes)
        if not a.store or not a.base_url:
            raise feed.BadConfiguration("--store and --base-url are needed")
    except feed.BadConfiguration as e:
        print(e, file=sys.stderr)
        return feed.BAD_CONFIGURATION
    spark = spark or SparkSession.builder.appName("folioforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = a.store.rstrip("/")
    engine = Engine(spark, f"{store}/tables")
    engine.create()
    journal = feed.Journal(spark, a.state_file or f"{store}/state.json")
    job = feed.Harvest(spark, a.base_url, f"{store}/landing", journal, a.since, a.until, a.set_spec, a.max_pages, a.max_records, a.sleep, a.timeout, get, say=say)
    for k, prefix in enumerate(prefixes):
        entry = job.run(prefix, a.resume, keep=k > 0)
        if Folder(spark, job.folder(prefix)).names(".xml"):  # what has landed is merged also where the pass ended in an error
            ingest.ingest(spark, job.folder(prefix), prefix, engine.tables["documents"], f"{store}/checkpoints/{prefix}", a.base_url).awaitTermination()
        if error := entry.get("error"):
            print(f"feed error {error['code']}: {error['message']} ({prefix})", file=sys.stderr)
            return feed.FEED_ERROR
    say(f"done: {', '.join(prefixes)}")
    return feed.OK


if __name__ == "__main__":
    raise SystemExit(main())
