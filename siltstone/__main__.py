"""Command line: ``python -m siltstone [--format text|json|yaml] [--metadata-only] [--detect-only] [--output FILE] [--parallel] [--verbose] FILE ...``

Files are read in one Spark job; results come in the order in which the files were
named. A file that can't be read is reported beside the results; the exit code is
1 if none could.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shown(spark: SparkSession, paths: list[str], form: str = "text", detect_only: bool = False, metadata_only: bool = False) -> DataFrame:
    """(place, path, shown, error) of the files in the order given; a file named twice is shown twice."""
    from .operators.extract import extract
    from .plans import sinks
    from .sources.files import read_files

    names = [Path(p).absolute().as_uri() if "://" not in p else p for p in paths]
    listed = spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(zip(paths, names))], "place int, name string, uri string")
    plain = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    files = read_files(spark, sorted(set(names)))
    found = extract(files, "content", path="path", what="detect" if detect_only else "metadata" if metadata_only else "all")
    if detect_only:
        x = F.struct("mime_type", F.col("detection_confidence").alias("confidence"), "detected_by")
        said = {"text": sinks.detection_text, "json": sinks.detection_json, "yaml": sinks.detection_yaml}[form](x)
        found = found.select("path", said.alias("shown"), F.lit(None).cast("string").alias("error"))
    else:
        text = F.lit(None).cast("string") if metadata_only else F.col("text")
        said = {"text": sinks.text, "json": sinks.json, "yaml": sinks.yaml}[form](F.col("mime_type"), F.col("detection_confidence"), F.col("metadata"), text, metadata_only)
        found = found.select("path", F.when(F.col("error").isNull(), said).alias("shown"), F.concat_ws(": ", "error.kind", "error.message").alias("error"))
    by_uri = found.withColumn("key", plain("path"))
    return listed.withColumn("key", plain("uri")).join(by_uri, "key", "left").select("place", F.col("name").alias("path"), "shown", F.when(F.col("shown").isNull(), F.coalesce("error", F.lit("not found"))).alias("error"))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description="Type, text and metadata of files.")
    parser.add_argument("files", nargs="+")
    parser.add_argument("-f", "--format", choices=("text", "json", "yaml"), default="text")
    parser.add_argument("-m", "--metadata-only", action="store_true")
    parser.add_argument("-d", "--detect-only", action="store_true")
    parser.add_argument("-o", "--output")
    parser.add_argument("-p", "--parallel", action="store_true", help="use all cores; results keep their order")
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(arguments)
    missing = [p for p in args.files if "://" not in p and not Path(p).is_file()]
    present = [p for p in args.files if p not in missing]
    own = spark or SparkSession.builder.master("local[*]" if args.parallel else "local[1]").appName("siltstone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    good, bad = 0, len(missing)
    for p in missing:
        print(f"Error processing {p}: not found", file=sys.stderr)
    out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
    try:
        rows = shown(own, present, args.format, args.detect_only, args.metadata_only).orderBy("place").toLocalIterator() if present else ()
        for r in rows:
            if r.shown is None:
                bad += 1
                print(f"Error processing {r.path}: {r.error}", file=sys.stderr)
                continue
            if args.format == "text":
                out.write(("\n---\n\n" if good else "") + (f"File: {r.path}\n" if len(args.files) > 1 else ""))
            out.write(r.shown if r.shown.endswith("\n") else r.shown + "\n")
            good += 1
    finally:
        if args.output:
            out.close()
        if spark is None:
            own.stop()
    if args.verbose and len(args.files) > 1:
        print(f"Summary: {good} succeeded, {bad} failed", file=sys.stderr)
    return int(bad > 0 and not good)


if __name__ == "__main__":
    sys.exit(main())
