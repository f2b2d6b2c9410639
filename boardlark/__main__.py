"""Command line: publish a snapshot, audit a snapshot or store.

    python -m boardlark publish --input posts.json --store /shared/store
    python -m boardlark audit --json posts.json --fail-on P1 --examples-per-code 3
    python -m boardlark audit --store /shared/store --format json
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from boardlark.operators import audit, search
from boardlark.operators.classify import classified
from boardlark.operators.normalize import notices
from boardlark.operators.store import Store
from boardlark.session import session
from boardlark.sources import snapshot


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("boardlark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("publish")
    p.add_argument("--input", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--min-records", type=int, default=1)
    p.add_argument("--min-retain-ratio", type=float, default=0.5)
    a = commands.add_parser("audit")
    where = a.add_mutually_exclusive_group(required=True)
    where.add_argument("--json")
    where.add_argument("--store")
    a.add_argument("--fail-on", choices=list(audit.RANK), default="P1")
    a.add_argument("--examples-per-code", type=int, default=3)
    a.add_argument("--format", choices=["text", "json"], default="text")
    o = parser.parse_args(args)
    spark = session()
    if o.command == "publish":
        rows = search.searchable(classified(notices(snapshot.array(spark, o.input))))
        print(Store(spark, o.store).publish(rows, o.min_records, o.min_retain_ratio))
        return 0
    records = snapshot.records(snapshot.array(spark, o.json)) if o.json else Store(spark, o.store).notices().select("id", "content")
    issues = audit.audit(records).cache()
    gate = audit.fails(issues, o.fail_on).first().asDict() | {"records": records.count()}
    counts = [r.asDict() for r in audit.summary(issues).orderBy("severity", "code").collect()]  # one row for each code
    shown = [r.asDict() for r in audit.examples(issues, o.examples_per_code).orderBy("severity", "code", F.col("k")).collect()]
    if o.format == "json":
        print(json.dumps(gate | {"summary": counts, "examples": shown}, ensure_ascii=False))
    else:
        print(f"records={gate['records']} issues={gate['total']} failing={gate['failing']}")
        for r in counts:
            print(f"- {r['severity']} {r['code']}: {r['n']}")
        for r in shown:
            print(f"  [{r['severity']} {r['code']}] {r['id']}:{r['line']} {r['excerpt']}")
    return int(gate["failed"])


if __name__ == "__main__":
    sys.exit(main())
