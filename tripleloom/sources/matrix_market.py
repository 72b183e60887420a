"""Matrix Market coordinate files, read and written as partitioned text.

A path may be one file or a folder of part files whose concatenation in name
order is the file; the writer makes the latter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.matrix import Matrix
from tripleloom.operators.reshape import mirrored

DIALECTS = ("standard", "strict", "core", "lenient")

# Banner vocabulary.
BANNER = "%%MatrixMarket"
STRICT_BANNER = "%%MatrixMarket matrix coordinate"
FIELDS = ("real", "double", "integer", "pattern", "complex")
STRICT_SYMMETRIES = ("general", "symmetric", "Hermitian")
SYMMETRY_SIGN = {"general": 0, "symmetric": 1, "hermitian": 1, "skew-symmetric": -1}


class FormatError(ValueError):
    """The file is not a coordinate matrix in the chosen dialect."""


@dataclass(frozen=True)
class Layout:
    """What the banner says: has values or not, and the sign of mirrored entries (0: none)."""

    pattern: bool
    mirror: int
    optional_value: bool = False


def parse_banner(line: str, dialect: str = "standard") -> Layout:
    """``standard`` follows the format's definition.

    ``core`` looks for words anywhere in the lower-cased line, so it mirrors
    ``skew-symmetric`` without changing the sign and leaves ``hermitian``
    alone.  ``lenient`` mirrors whatever is not ``general`` and lets values be
    absent.  ``strict`` accepts only the exact spellings.
    """
    low = line.lower()
    words = line.split()
    if dialect == "core":
        return Layout("pattern" in low, 1 if "symmetric" in low else 0)
    if dialect == "lenient":
        return Layout(False, 0 if "general" in low else 1, optional_value=True)
    if dialect == "strict":
        if not line.startswith(STRICT_BANNER):
            raise FormatError("only coordinate files with a MatrixMarket banner can be read")
        if len(words) < 5 or words[3] not in FIELDS:
            raise FormatError(f"unknown value type in {line!r}")
        if words[4] not in STRICT_SYMMETRIES:
            raise FormatError(f"unknown symmetry in {line!r}")
        return Layout(words[3] == "pattern", 0 if words[4] == "general" else 1)
    if dialect != "standard":
        raise ValueError(f"unknown dialect {dialect!r}, choose one of {', '.join(DIALECTS)}")
    parts = low.split()
    if len(parts) < 5 or parts[:3] != [BANNER.lower(), "matrix", "coordinate"]:
        raise FormatError(f"not a coordinate banner: {line!r}")
    if parts[3] not in FIELDS or parts[4] not in SYMMETRY_SIGN:
        raise FormatError(f"unknown value type or symmetry: {line!r}")
    return Layout(parts[3] == "pattern", SYMMETRY_SIGN[parts[4]])


def parse_size(line: str) -> tuple[int, int, int]:
    try:
        rows, cols, nnz = (int(t) for t in line.split()[:3])
    except ValueError as error:
        raise FormatError(f"not a size line: {line!r}") from error
    return rows, cols, nnz


def _is_data() -> Column:
    return ~F.col("value").startswith("%") & (F.trim("value") != "")


def parse_entries(lines: DataFrame, rows: int, cols: int, layout: Layout) -> Matrix:
    """Entries from data lines ``(value)``; a line that does not fit stops the job and is named."""
    token = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")

    def at(n: int, type_: str) -> Column:
        return F.try_element_at(token, F.lit(n)).try_cast(type_)

    one = F.lit(1.0)
    value = one if layout.pattern else at(3, "double")
    if layout.optional_value:
        value = F.when(F.size(token) < 3, one).otherwise(value)
    parsed = lines.where(_is_data()).select("value", at(1, "long").alias("r"), at(2, "long").alias("c"), value.alias("v"))
    fits = F.col("r").between(1, rows) & F.col("c").between(1, cols) & F.col("v").isNotNull()
    complaint = F.concat(F.lit("bad Matrix Market line: "), F.col("value"))
    # A filter, so that no choice of columns can leave the check out.
    checked = parsed.where(F.when(F.coalesce(fits, F.lit(False)), F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean")))
    stored = Matrix(
        checked.select((F.col("r") - 1).alias("i"), (F.col("c") - 1).alias("j"), "v"), rows, cols
    )
    return mirrored(stored, float(layout.mirror)) if layout.mirror else stored


def read_matrix_market(
    spark: SparkSession, path: str, dialect: str = "standard", combine: bool = False
) -> Matrix:
    """A matrix with 0-based positions; ``combine`` adds repeated positions, else they are kept.

    Values of pattern files are 1.0, of complex files the real part.  A file with
    another number of data lines than it declares is refused.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise FormatError(f"no file at {path}")
    # Line numbers rise within a partition and over the partitions of one file.
    head = spark.read.text(files[0]).select("value", F.monotonically_increasing_id().alias("at"))
    banner = head.first()
    size = head.where(_is_data()).first()
    if banner is None or size is None:
        raise FormatError(f"no banner or size line in {files[0]}")
    layout = parse_banner(banner["value"], dialect)
    rows, cols, declared = parse_size(size["value"])
    lines = head.where((F.col("at") != size["at"]) | (F.col("value") != size["value"])).select("value")
    if files[1:]:
        lines = lines.unionByName(spark.read.text(files[1:]))
    held = lines.where(_is_data()).count()
    if held != declared:
        raise FormatError(f"{path} declares {declared} entries and holds {held}")
    matrix = parse_entries(lines, rows, cols, layout)
    return matrix.combined() if combine else matrix


def formatted_lines(m: Matrix) -> DataFrame:
    """``(i, j, value)``: the data line of every entry, 1-based."""
    text = F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("string"))
    return m.entries.select("i", "j", text.alias("value"))


def write_matrix_market(m: Matrix, path: str, symmetry: str = "general") -> None:
    """Write ``coordinate real`` text in row-major order, as part files in one folder.

    With another ``symmetry`` the entries are taken for the stored triangle.  The heading sorts before every entry, so it opens the first part.
    """
    spark = m.entries.sparkSession
    heading = spark.createDataFrame(
        [
            (-1, 0, f"{STRICT_BANNER} real {symmetry}"),
            (-1, 1, f"{m.rows} {m.cols} {m.nnz()}"),
        ],
        "i long, j long, value string",
    )
    formatted_lines(m).unionByName(heading).orderBy("i", "j").select("value").write.text(path)
