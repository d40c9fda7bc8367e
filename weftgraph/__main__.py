"""python -m weftgraph SOURCE [FOLDER]: the graph of a folder, with all renderings and the whole result."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .streaming.watch import OUTPUT, build_output


def main(args: list[str]) -> int:
    if not 1 <= len(args) <= 2:
        print(__doc__, file=sys.stderr)
        return 2
    folder = args[1] if len(args) > 1 else OUTPUT
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    result = build_output(spark, args[0], folder=folder)
    with open(os.path.join(folder, "result.json"), "w", encoding="utf-8") as f:
        f.write(result.to_json())
    print(result.artifacts["report"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
