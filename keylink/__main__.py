"""Command line: ``spark-submit -m keylink`` or ``python -m keylink``."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keylink.functions.frames import metadata_frame
from keylink.params import Params, resolve_params
from keylink.plans.lifecycle import run_model
from keylink.sources.catalog import files_source
from keylink.sources.jdbc import Connection, database_source, policies
from keylink.sources.store import ResultStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keylink", description=__doc__)
    p.add_argument("--model-id", required=True, help="name of the run series")
    p.add_argument("--store", required=True, help="folder for results and status")
    p.add_argument("--algorithm-name", default="")
    p.add_argument("--execute-obj", default="")
    p.add_argument("--config", help="parquet table with parameters per model")
    p.add_argument("--config-key", help="how the model is spelled in the config table")
    p.add_argument("--source-type", default="files", help="files, hive, mysql, oracle, ...")
    p.add_argument("--path", help="folder of the tables when the source is files")
    p.add_argument("--format", default="parquet")
    for name in ("db", "host", "port", "user", "url"):
        p.add_argument(f"--{name}", default="")
    p.add_argument(
        "--password-variable", default="KEYLINK_PASSWORD",
        help="environment variable that holds the password",
    )
    p.add_argument("--partitions", type=int, default=1, help="connections per table read")
    p.add_argument("--class-policy", help="any, unique_only or ascii")
    p.add_argument("--type-policy", help="all, mysql or oracle")
    p.add_argument("--tolerance", type=float, default=0.0, help="highest accepted miss ratio")
    p.add_argument("--sample-rows", type=int, help="test a sample instead of all rows")
    p.add_argument("--max-rows", type=int, help="leave out longer tables")
    return p


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("keylink").getOrCreate()
    params = configured_params(spark, args)
    names = list(params.tables) or None
    if args.source_type == "files":
        source = files_source(spark, args.path, names, args.format, db=args.db or "files")
    else:
        connection = Connection(
            args.source_type, args.db, args.host, args.port, args.user,
            os.environ.get(args.password_variable, ""), args.url,
        )
        source = database_source(spark, connection, names, args.partitions)
        types, classes = policies(args.source_type)
        params = replace(params, type_policy=types, class_policy=classes)
    chosen = {
        "type_policy": args.type_policy,
        "class_policy": args.class_policy,
        "sample_rows": args.sample_rows,
        "max_rows": args.max_rows,
        "sup_out_foreign_key": args.tolerance,
    }
    params = replace(params, **{k: v for k, v in chosen.items() if v is not None})
    store = ResultStore(spark, args.store)
    run_model(spark, source, store, params, args.algorithm_name, args.execute_obj)
    store.statuses().filter(F.col("id") == args.model_id).show(truncate=False)


def configured_params(spark: SparkSession, args: argparse.Namespace) -> Params:
    if not args.config:
        return Params(model_id=args.model_id)
    models = metadata_frame(spark, [(args.model_id,)], "model string")
    key = F.lit(args.config_key or args.model_id)
    row = resolve_params(models, spark.read.parquet(args.config), key).first()
    return Params.from_row(row)


if __name__ == "__main__":
    main()
