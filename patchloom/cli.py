"""Command line: pairs, features and classify over a table of code pairs."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from patchloom import config, plugins
from patchloom.operators import classify, datasets, features, pairs
from patchloom.sources import tables


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="patchloom", description=__doc__)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-m", "--mode", choices=("pairs", "features", "classify"), default="pairs")
    p.add_argument("-g", "--granularity", choices=("statement", "method"))
    p.add_argument("-s", "--strategy", help="aligned, strict or one of a plug-in")
    p.add_argument("--plugins", help="modules that register languages or strategies, separated by commas")
    p.add_argument("--config", help="a YAML file of settings; what is given here comes first")
    p.add_argument("--split-input", help="the statement table's path: read if it is there, else made and written to it")
    p.add_argument("--models", help="names, separated by commas")
    p.add_argument("--test-size")
    p.add_argument("--cv-folds", type=int)
    p.add_argument("--formats")
    p.add_argument("--no-xai", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parse(argv)
    plugins.load(args.plugins.split(",") if args.plugins else [])
    spark = spark or SparkSession.builder.appName("patchloom").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "WARN")
    source, found = tables.read_pairs(spark, args.input), config.load(args.config)
    if args.mode == "pairs":
        made, counted = pairs.pair(source, args.granularity or found["pairs"]["granularity"], args.strategy or found["pairs"]["strategy"])
        tables.write_csv(made, args.output)
        counted.show(truncate=False)
    elif args.mode == "features":
        features_to(source, args.output).show(truncate=False)
    else:
        path = args.split_input or found["classification"]["split_input"]
        if path and not tables.exists(spark, path):
            features_to(source, path).show(truncate=False)
        table = tables.read_csv(spark, path) if path else features.features(source)
        set_here = {"models": named(args.models.split(","), found["classification"]["models"]) if args.models else None, "test_size": datasets.parse_test_size(args.test_size) if args.test_size else None, "cv_folds": args.cv_folds, "importance": False if args.no_xai else None}
        report = classify.compare(source, table, classify.Config.of(found, **set_here))
        report |= {"README": spark.createDataFrame(classify.README, "item string, text string"), "config": config.table(spark, found)}
        formats = args.formats.split(",") if args.formats else found["classification"]["output_formats"]
        for path in tables.write_report(report, tables.run_folder(args.output), tuple(formats)):
            print(path)
        report["summary"].show(truncate=False)
        tables.discard(spark)


def named(names: list[str], known: list) -> list:
    """Models by name: where the settings file has one of this label or name, whatever the case, with its parameters."""

    def called(model: str | dict) -> set[str]:
        return {str(x).lower() for x in ((model.get("label"), model.get("name")) if isinstance(model, dict) else (model,)) if x}

    return [next((m for m in known if name.lower() in called(m)), name) for name in (n.strip() for n in names) if name]


def features_to(source: DataFrame, path: str) -> DataFrame:
    """The statement table of source, written to path; its counters, observed while it is written. Code is parsed once and nothing is kept."""
    counted = features.Counted(source)
    tables.write_csv(features.table_of(counted.parsed), path)
    return counted.row()


if __name__ == "__main__":
    main()
