"""Regenerate labelspark/plans/rounding.py: the DOUBLE and ARRAY<DOUBLE>
output columns of every registered query (read from the Spark schemas), so
the oracle SQL can round them to 6 places exactly like the Spark side."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from labelspark.plans.catalog import queries  # noqa: E402
from labelspark.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8, 8)
    out = {}
    for name, fn in sorted(queries().items()):
        sch = fn(spark, sf).schema
        dbl = [f.name for f in sch.fields if isinstance(f.dataType, T.DoubleType)]
        arr = [f.name for f in sch.fields if isinstance(f.dataType, T.ArrayType)
               and isinstance(f.dataType.elementType, T.DoubleType)]
        if dbl or arr:
            out[name] = (dbl, arr)
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                        "labelspark", "plans", "rounding.py")
    with open(path, "w") as fh:
        fh.write('"""Generated by scripts/gen_rounding.py: DOUBLE / ARRAY<DOUBLE> output\n'
                 'columns per query, rounded to 6 places in the oracle SQL."""\n\n')
        fh.write("ROUND_COLUMNS: dict[str, tuple[list[str], list[str]]] = {\n")
        for k, (d, a) in out.items():
            fh.write(f"    {k!r}: ({d!r}, {a!r}),\n")
        fh.write("}\n")
    print(f"wrote {len(out)} entries to {path}")


if __name__ == "__main__":
    main()
