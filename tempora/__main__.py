"""python -m tempora run QUERY FOLDER [--out PATH] | python -m tempora ask INDEX.json [--keyword WORD]... [--attention-only] | python -m tempora list"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tempora", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run", help="a timeline query over a folder of tables")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out")
    ask = sub.add_parser("ask", help="time ranges of an index that are worth a closer look")
    ask.add_argument("index")
    ask.add_argument("--keyword", action="append")
    ask.add_argument("--attention-only", action="store_true")
    ask.add_argument("--out")
    sub.add_parser("list", help="names of the timeline queries")
    a = p.parse_args(argv)

    from tempora.operators import focus
    from tempora.plans.queries import QUERIES
    from tempora.plans.ship import ship

    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.what == "run" and a.query not in QUERIES:
        print(f"no query {a.query!r}; 'list' names them", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tempora").getOrCreate()
    ship(spark)
    _give(QUERIES[a.query](spark, a.folder) if a.what == "run" else focus.query_index(spark, a.index, None, a.keyword, a.attention_only)["ranges"], a.out)
    return 0


def _give(df: DataFrame, out: str | None) -> None:
    from tempora.sources.readers import write_json

    if out:
        write_json(df, out)
    else:
        df.show(truncate=False)


if __name__ == "__main__":
    sys.exit(main())
