"""``python -m treeloom [expression] [--json] [--sexp]``; asks for an
expression on standard input where none is given."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from treeloom.operators import encode


def main() -> None:
    parser = argparse.ArgumentParser(prog="treeloom")
    parser.add_argument("expression", nargs="?")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--sexp", action="store_true")
    args = parser.parse_args()
    text = args.expression if args.expression is not None else input("expression: ")
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.createDataFrame([(0, text if "$" in text or "\\(" in text else f"${text}$")], "doc_id bigint, text string")
    run = encode.encode(docs)
    if args.json:
        print(encode.to_json(run).first()["json"])
    elif args.sexp:
        print(run.sexps().first()["sexp"])
    else:
        row = encode.summary(run).first()
        print(f"tokens: {row['n_tokens']}\nids: {row['first_ids']}\nsexp: {row['sexp_head']}")


if __name__ == "__main__":
    main()
