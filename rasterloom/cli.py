"""``python -m rasterloom.cli -a settings.yaml`` or ``-i image.tif -br 1,2,3 ...``"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from rasterloom.config import from_command_line
from rasterloom.plans.pipeline import SceneSegmenter


def main(argv: Sequence[str] | None = None) -> str:
    settings = from_command_line(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("rasterloom").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    mask = SceneSegmenter(spark, settings=settings)(settings.image)
    print(mask)
    return mask


if __name__ == "__main__":
    main()
