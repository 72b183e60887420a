"""Result tables: CSV with a declared schema, resuming by key, refreshing a column, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions.scalar import number_or_null

# Columns of the comparison table. Times are text: they may be blank, DNF, timeout or fail.
COMPARISON_COLUMNS = (
    "matrix", "n", "sym", "density_pct", "cu", "Auto", "Auto_choice",
    "Ocean", "opSparse", "HSMU", "dense", "cublas", "cnnz",
)
METADATA_SCHEMA = (
    "id int, name string, `group` string, rows long, cols long, nnz long, kind string, date string, "
    "year int, num_entries long, density double, sparsity_pct double, nnz_per_row double, "
    "is_square boolean, detail_url string, url_mm string"
)
# Timing fields that make up the compute-only time of a run document.
RUN_TIMING = {
    "analysis": ("product_calc", "reduce", "mem_cpy"),
    "estimation": ("hll_construct", "hll_merge", "malloc", "sampling"),
    "epilogue": ("sort", "copy", "scan"),
}
#: The phase of which every field counts, whatever its name.
OPEN_PHASE = "numeric"
#: Phases that are read but are no part of the compute-only time.
OTHER_PHASES = ("symbolic", "sampling")


class StaleSchema(ValueError):
    """The stored table has other columns than the ones to be added."""


def comparison_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in COMPARISON_COLUMNS])


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV table with a heading line and a declared schema, never an inferred one."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def stored_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names in the heading of a stored table."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a stored table; columns that differ stop it before anything is written."""
    from pyspark.errors import AnalysisException

    try:
        stored = stored_columns(df.sparkSession, path)
    except AnalysisException:
        stored = []
    if stored and stored != df.columns:
        raise StaleSchema(f"{path} has columns {stored}, the new rows {df.columns}")
    write_table(df, path, "append")


def pending(wanted: DataFrame, done: DataFrame, key: str = "matrix") -> DataFrame:
    """Rows whose key has no result yet."""
    return wanted.join(done.select(key), key, "left_anti")


def refreshed(table: DataFrame, column: str, fresh: DataFrame, key: str = "matrix") -> DataFrame:
    """The table with new values in one column; keys without a new value keep the old one.

    A key with several new values stops the job: each row takes one.
    """
    if column not in table.columns:
        raise ValueError(f"unknown column {column!r}, choose one of {', '.join(table.columns)}")
    complaint = F.concat(F.lit("several new values for "), F.col(key).cast("string"))
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.max(complaint))).otherwise(F.max(column))
    new = fresh.groupBy(key).agg(one.alias("__fresh"))
    return table.join(new, key, "left").select(
        *[F.coalesce("__fresh", c).alias(c) if c == column else F.col(c) for c in table.columns]
    )


def with_baseline(table: DataFrame, baseline: DataFrame, column: str, key: str = "name") -> DataFrame:
    """The table with one measured column of another table; NULL where it has none."""
    return table.join(baseline.select(key, column), key, "left")


def timed(table: DataFrame, columns: list[str]) -> DataFrame:
    """Time columns as numbers, with marks of failed runs as NULL."""
    return table.select(*[number_or_null(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


# --- run documents ----------------------------------------------------------------


def run_schema() -> T.StructType:
    def doubles(names) -> T.StructType:
        return T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def longs(names) -> T.StructType:
        return T.StructType([T.StructField(n, T.LongType()) for n in names])

    size = longs(("rows", "cols", "nnz"))
    timing = T.StructType(
        [T.StructField(phase, doubles(names)) for phase, names in RUN_TIMING.items()]
        + [T.StructField(phase, T.MapType(T.StringType(), T.DoubleType())) for phase in (OPEN_PHASE, *OTHER_PHASES)]
        + [T.StructField("prologue", T.DoubleType())]
    )
    stats = doubles(
        ("input_expansion", "intermediate_product", "intermediate_product_avg",
         "intermediate_product_max", "output_compression")
    )
    return T.StructType(
        [T.StructField(n, size) for n in "ABC"]
        + [
            T.StructField("decision", T.MapType(T.StringType(), T.StringType())),
            T.StructField("ultra_sparse", T.StringType()),
            T.StructField("gflops", T.DoubleType()),
            T.StructField("stats", stats),
            T.StructField("timing", timing),
            T.StructField("total_time", T.DoubleType()),
        ]
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents, one JSON object per file."""
    return spark.read.schema(run_schema()).option("multiLine", True).json(path)


def compute_ms(timing: str = "timing") -> Column:
    """Compute-only time: the listed phases, all numeric fields and the prologue, a missing field counting as 0."""
    fields = [f"{timing}.{phase}.{name}" for phase, names in RUN_TIMING.items() for name in names]
    total = F.lit(0.0)
    for field in [*fields, f"{timing}.prologue"]:
        total = total + F.coalesce(F.col(field), F.lit(0.0))
    every = F.map_values(f"{timing}.{OPEN_PHASE}")
    return total + F.coalesce(F.aggregate(every, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))), F.lit(0.0))
