"""Command line: build a dictionary from XML, or tokenize a file of lines.

    spark-submit sorakana/cli.py build --xml-path JMdict_e.gz --db-path out
    spark-submit sorakana/cli.py tokenize --db-path out --input lines.txt --output tokens
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sorakana.operators.tokenize import tokenize, with_glosses
from sorakana.sources.dictionary import Dictionary, read_sqlite, read_xml


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sorakana")
    steps = parser.add_subparsers(dest="step", required=True)
    build = steps.add_parser("build")
    build.add_argument("--db-path", required=True)
    build.add_argument("--xml-path")
    build.add_argument("--sqlite-path")
    build.add_argument("--quiet", action="store_true")
    walk = steps.add_parser("tokenize")
    walk.add_argument("--db-path", required=True)
    walk.add_argument("--input", required=True)
    walk.add_argument("--output", required=True)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("sorakana").getOrCreate()
    try:
        if given.step == "build":
            if not (given.xml_path or given.sqlite_path):
                raise ValueError("give --xml-path or --sqlite-path; nothing is downloaded")
            d = (read_xml(spark, given.xml_path) if given.xml_path else read_sqlite(spark, given.sqlite_path)).write(given.db_path)
            if not given.quiet:
                d.statistics().show()
        else:
            d = Dictionary.read(spark, given.db_path)
            lines = spark.read.text(given.input).select(F.xxhash64("value").alias("text_id"), F.col("value").alias("text"))
            with_glosses(tokenize(lines.distinct(), d), d).write.mode("overwrite").parquet(given.output)
    except Exception as error:  # the exit code is the contract of a command
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
