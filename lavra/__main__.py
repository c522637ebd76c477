"""``python -m lavra IN OUT``: converts a folder of files and writes the results as Parquet."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from lavra.plans.options import Options, load
from lavra.plans.pipeline import convert_folder, rollup
from lavra.sources.sinks import write_files, write_results


def parser() -> argparse.ArgumentParser:
    """A flag for each option; switches also have a ``--no-`` form."""
    p = argparse.ArgumentParser(prog="lavra", description=__doc__)
    p.add_argument("path", help="a folder of .txt, .md, .docx and .pdf files")
    p.add_argument("out", help="where the results go")
    p.add_argument("--glob", help="names to read, such as *.docx")
    p.add_argument("--files", help="a folder that gets each document as a file of its own, such as file:///data/out")
    p.add_argument("--config", help="a JSON or YAML file of options")
    for f in fields(Options):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(name, action=argparse.BooleanOptionalAction, default=None)
        else:
            p.add_argument(name)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lavra").getOrCreate()
    results = convert_folder(spark, a.path, load(a.config, vars(a)), a.glob)
    write_results(results, a.out)
    written = spark.read.parquet(a.out)
    if a.files:
        write_files(written, a.files)
    done = rollup(written).first()
    print(f"{done['total']} documents: {done['converted']} converted, {done['failed']} failed")
    return int(done["failed"] > 0)


if __name__ == "__main__":
    raise SystemExit(main())
