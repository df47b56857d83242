"""Command line: structure, generate, translate, shrink, sync, config."""

from __future__ import annotations

import argparse
import importlib
import logging
import logging.handlers
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import relational
from quirelake.operators.generate import Policy
from quirelake.plans import flows
from quirelake.session import cut, ship
from quirelake.sources import codecs, pdf, structure
from quirelake.sources.archive import archives_of
from quirelake.streaming import sync


def configure_logging(title: str | None = None, verbose: bool = False) -> logging.Logger:
    """To the console, and with a title to a file of its own that turns over at 10 MB."""
    log = logging.getLogger("quirelake")
    log.handlers.clear()
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    log.addHandler(logging.StreamHandler())
    if title:
        log.addHandler(logging.handlers.RotatingFileHandler(f"{title}.log", maxBytes=10 << 20, backupCount=7, encoding="utf-8"))
    return log


def _plugged(path: str | None):
    """The object behind ``module:name``; a class or function is called without arguments."""
    if path is None:
        return None
    module, _, name = path.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found() if callable(found) and not hasattr(found, "generate") or isinstance(found, type) else found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quirelake")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("structure", "generate", "translate"):
        p = sub.add_parser(name)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-c", "--config")
        p.add_argument("-s", "--source-language")
        p.add_argument("-t", "--target-language")
        p.add_argument("--title")
        p.add_argument("--target-title")
        p.add_argument("--author")
        p.add_argument("--num-retries", type=int)
        p.add_argument("--max-backoff-seconds", type=float)
        p.add_argument("--previous-content-limit", type=int)
        p.add_argument("--max-continuation-attempts", type=int)
        p.add_argument("--log", help="folder of checkpoints: what they call done is not asked for again")
        p.add_argument("--generator", help="module:name of the model service")
        p.add_argument("--decoder", help="module:name of the page decoder; PDF files, if not given")
        p.add_argument("--codec", help="module:name of the image codec")
        p.add_argument("--stamp", help="date of the package; now, if not given")
    p = sub.add_parser("shrink")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--dpi", type=int, default=150)
    p.add_argument("--quality", type=int, default=60)
    p.add_argument("--grayscale", action="store_true")
    p.add_argument("--compressor", help="module:name of the compressor")
    p = sub.add_parser("sync")
    p.add_argument("source", help="folder to upload from, or to download to")
    p.add_argument("target", help="folder or store to upload to, or to download from")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--final", action="store_true", help="one round")
    p.add_argument("--download", action="store_true", help="from target to source")
    p.add_argument("--seconds", type=float, default=300.0)
    p.add_argument("--endpoint")
    p.add_argument("--access-key")
    p.add_argument("--secret-key")
    p.add_argument("--verbose", action="store_true")
    p = sub.add_parser("config")
    p.add_argument("file")
    p.add_argument("key")
    return top


def _books(spark: SparkSession, path: str):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("book"), "content")


def _sync(spark: SparkSession, args) -> None:
    store = {k: v for k, v in (("endpoint", args.endpoint), ("access_key", args.access_key), ("secret_key", args.secret_key)) if v}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in (("fs.s3a.endpoint", args.endpoint), ("fs.s3a.access.key", args.access_key), ("fs.s3a.secret.key", args.secret_key)):
        if value:
            conf.set(key, value)
    source, target = (args.target, args.source) if args.download else (args.source, args.target)
    sync.poll(spark, source, target, args.checkpoint, args.seconds, 1 if args.final or args.download else None, store or None)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, generator=None, decoder=None, compressor=None, codec=None) -> int:
    """Runs a command. Generators, decoders, codecs and compressors of real services are passed in or named on the command line; a
    command that needs one doesn't run without. 0: done, 1: some books failed, 2: not run."""
    args = parser().parse_args(argv)
    log = configure_logging(getattr(args, "title", None), getattr(args, "verbose", False))
    if args.command == "config":
        print(structure.config_value(args.file, args.key) or "")
        return 0
    given = {k: _plugged(getattr(args, k, None)) for k in ("generator", "decoder", "compressor", "codec")}
    generator, decoder, compressor, codec = generator or given["generator"], decoder or given["decoder"] or pdf.PdfPages(), compressor or given["compressor"], codec or given["codec"]
    needed = {"structure": [("generator", generator)], "translate": [("generator", generator)], "generate": [("generator", generator)], "shrink": [("compressor", compressor)]}
    if missing := [name for name, value in needed.get(args.command, ()) if value is None]:
        log.error("%s needs --%s", args.command, " and --".join(missing))
        return 2
    spark = spark or SparkSession.builder.appName("quirelake").getOrCreate()
    ship(spark)
    if args.command == "sync":
        _sync(spark, args)
    elif args.command == "shrink":
        ladder = ((args.dpi, codecs.checked_quality(args.quality), args.grayscale),)
        done = codecs.bounded(_books(spark, args.input), compressor, -1, ladder)
        done.select("book", "content", "input_size", "output_size", relational.size_stats(F.col("input_size"), F.col("output_size")).alias("stats")).write.mode("overwrite").parquet(args.output)
    else:
        settings = {k: v for k, v in vars(args).items() if k in {f.name for f in fields(structure.Config)}}
        config = structure.load_config(args.config, **settings) if args.config else structure.Config(**{k: v for k, v in settings.items() if v is not None})
        policy = Policy(config.num_retries, config.max_backoff_seconds)
        if args.command == "translate":
            return int(flows.translate_path(spark, args.input, args.output, generator, config, args.log) > 0)
        books = _books(spark, args.input).withColumns({"title": F.lit(config.title).cast("string"), "author": F.lit(config.author).cast("string")})
        asked = cut(flows.structures(books, generator, policy), "structures")
        if args.command == "structure":
            structure.write_structures(asked, args.output)
        else:
            stamp = args.stamp or spark.range(1).select(text.utc_stamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))).first()[0]
            members = flows.generate_books(books, asked.where(F.col("error").isNull()), decoder, generator, stamp, policy, log_path=args.log, codec=codec or codecs.Marked())
            archives_of(members).write.mode("overwrite").parquet(args.output)
        return int(asked.where(F.col("error").isNotNull()).count() > 0)
    log.info("done")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
