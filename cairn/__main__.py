"""``python -m cairn ls BUCKET [PREFIX] | head BUCKET KEY | durability DOMAINS FAILURES_A_YEAR REPAIR_HOURS TARGET | queries | query NAME``, over the tables in $CAIRN_TABLES."""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F

from cairn.functions import durability
from cairn.operators import listing, merge
from cairn.plans import catalogue
from cairn.session import session
from cairn.sources.views import Lake


def main(args: list[str]) -> int:
    if args[:1] == ["durability"] and len(args) == 5:
        got = durability.choose(int(args[1]), float(args[2]) / durability.YEAR, 1 / float(args[3]), float(args[4]))
        print("no scheme fits" if got is None else f"{got[0]}+{got[1]}: {got[2]:.3g} lost a year" + ("" if got[3] else ", short of the target"))
        return 0
    if args == ["queries"]:
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if args[:1] == ["query"] and len(args) == 2 and args[1] in catalogue.queries():
        spark = session(os.environ.get("CAIRN_MASTER", "local[*]"))
        catalogue.queries()[args[1]](spark, os.environ["CAIRN_TABLES"]).show(1000, truncate=False)
        return 0
    if args[:1] not in (["ls"], ["head"]) or len(args) < 2 + (args[0] == "head"):
        print(__doc__, file=sys.stderr)
        return 2
    lake = Lake(session(os.environ.get("CAIRN_MASTER", "local[*]")), os.environ["CAIRN_TABLES"])
    if args[0] == "ls":
        listing.list_objects(lake.version_log(), args[1], args[2] if len(args) > 2 else "", "/").show(1000, truncate=False)
    else:
        merge.current(lake.version_log().where((F.col("bucket") == args[1]) & (F.col("key") == args[2])), ["bucket", "key"]).show(vertical=True, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
