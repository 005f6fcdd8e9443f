"""Command: python -m siftwork ROOT --output-dir DIR [--formats csv json md html] [--fail-on УЗ-1] [--ci] [--no-skip]."""

import argparse
import sys

from pyspark.sql import SparkSession

from siftwork.operators.classify import LEVELS
from siftwork.plans.run import run


def main() -> int:
    p = argparse.ArgumentParser("siftwork")
    p.add_argument("root", nargs="?")
    p.add_argument("--output-dir", default="reports")
    p.add_argument("--formats", nargs="+", default=["csv", "json", "md", "html"], choices=["csv", "json", "md", "html"])
    p.add_argument("--fail-on", default=LEVELS[0], choices=LEVELS)
    p.add_argument("--ci", action="store_true", help="exit with the code of the worst level")
    p.add_argument("--no-skip", action="store_true", help="search short texts, too")
    a = p.parse_args()
    try:
        written, code = run(SparkSession.builder.appName("siftwork").getOrCreate(), a.root, a.output_dir, tuple(a.formats), a.fail_on, not a.no_skip)
    except (FileNotFoundError, NotADirectoryError) as e:
        print(e, file=sys.stderr)
        return 1
    for kind, path in written.items():
        print(f"{kind}: {path}")
    return code if a.ci else 0


if __name__ == "__main__":
    sys.exit(main())
