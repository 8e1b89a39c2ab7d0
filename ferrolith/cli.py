"""python -m ferrolith.cli QUERY --tables DIR [--out PATH] | validate FILE: runs a query over a folder of tables, or checks a record file. Exit code 1 on findings."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from ferrolith.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("what")
    p.add_argument("path", nargs="?")
    p.add_argument("--tables")
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = local_session()
    if a.what == "validate":
        from ferrolith.sources.records import errors, read_json

        bad = read_json(spark, a.path).withColumn("errors", errors()).filter((F.size("errors") > 0) | (F.size("unexpected") > 0) | F.col("corrupt").isNotNull())
        bad.select("id", "errors", "unexpected").show(20, truncate=False)
        return int(not bad.isEmpty())
    from ferrolith.plans import core, reference

    q = {**reference.queries(), **core.queries()}
    if a.what not in q:
        print(f"no query {a.what}", file=sys.stderr)
        return 2
    out = q[a.what](spark, a.tables)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
