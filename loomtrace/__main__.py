"""A shell over a store: python -m loomtrace STORE query|import|export|vacuum|delete-all ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomtrace.store import Store


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomtrace", description=__doc__)
    parser.add_argument("store", help="folder of the store")
    actions = parser.add_subparsers(dest="action", required=True)
    actions.add_parser("query", help="run a query or a delete; prints JSON").add_argument("text")
    actions.add_parser("import", help="add the logs of a file or folder; prints their ids").add_argument("path")
    export = actions.add_parser("export", help="write a log as XES")
    export.add_argument("log_id")
    export.add_argument("target")
    actions.add_parser("vacuum", help="delete files that the last version doesn't use; prints how many").add_argument("--hours", type=float, default=24, help="only files older than that")
    actions.add_parser("delete-all", help="delete the store")
    args = parser.parse_args(argv)
    store = Store(SparkSession.builder.appName("loomtrace").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args.store)
    if args.action == "query":
        print(store.execute(args.text))
    elif args.action == "import":
        print("\n".join(store.import_log(args.path)))
    elif args.action == "export":
        store.export_log(args.log_id, args.target)
    elif args.action == "vacuum":
        print(store.vacuum(args.hours))
    else:
        store.delete_all()


if __name__ == "__main__":
    main()
