"""Command line: products, features and comparison of Matrix Market files.

    python -m tripleloom product A.mtx [att] [--method auto] [--out FOLDER]
    python -m tripleloom multiply A.mtx B.mtx [--method auto] [--out FOLDER]
    python -m tripleloom features A.mtx
    python -m tripleloom compare EXPECTED.mtx ACTUAL.mtx [--tolerance 1e-9]

The session comes from ``spark-submit`` where it is used, else from defaults.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from tripleloom.matrix import Matrix
from tripleloom.operators import diff
from tripleloom.operators.multiply import METHODS, outer_gram, spgemm, square_product
from tripleloom.operators.rowstats import sparsity
from tripleloom.plans import dispatch
from tripleloom.sources.matrix_market import DIALECTS, read_matrix_market, write_matrix_market


def described(name: str, m: Matrix) -> str:
    row = sparsity(m).first()
    return f"{name}: {row['rows']} x {row['cols']}, nnz = {row['nnz']}, sparsity = {row['sparsity_pct']:.4f}%"


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tripleloom")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("product")
    one.add_argument("file")
    one.add_argument("form", nargs="?", choices=("aa", "att"), default="aa")
    two = commands.add_parser("multiply")
    two.add_argument("file")
    two.add_argument("other")
    for p in (one, two):
        p.add_argument("--method", default="auto", type=str.lower, choices=METHODS)
        p.add_argument("--out")
    commands.add_parser("features").add_argument("file")
    compare = commands.add_parser("compare")
    compare.add_argument("file")
    compare.add_argument("other")
    compare.add_argument("--tolerance", type=float, default=1e-9)
    for p in commands.choices.values():
        p.add_argument("--dialect", default="standard", choices=DIALECTS)
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("tripleloom").getOrCreate()
    a = read_matrix_market(spark, options.file, options.dialect)
    if options.command == "features":
        row = dispatch.features(a).select("*", dispatch.score().alias("score"), dispatch.choice().alias("choice")).first()
        print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
        return 0
    if options.command == "compare":
        b = read_matrix_market(spark, options.other, options.dialect)
        row = diff.difference(a.combined(), b.combined(), options.tolerance).first()
        print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
        return 0 if row["passed"] and (a.rows, a.cols) == (b.rows, b.cols) else 1

    print(described("Input A", a))
    start = time.perf_counter()
    if options.command == "multiply":
        c = spgemm(a, read_matrix_market(spark, options.other, options.dialect), method=options.method)
    elif options.form == "att":
        c = outer_gram(a, method=options.method)
    else:
        c = square_product(a, method=options.method)
    c = c.materialized()
    print(described("Result C", c))
    print(f"Time: {(time.perf_counter() - start) * 1000:.3f} ms")
    if options.out:
        write_matrix_market(c, options.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
