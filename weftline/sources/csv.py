"""CSV trees: one file a project, directories for tool, strategy and detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators.relational import ORD, union_all
from weftline.sources import schemas


def with_ordinal(df: DataFrame) -> DataFrame:
    """``_ord``: ascends in file order, file by file; gaps are allowed."""
    return df.withColumn(ORD, F.monotonically_increasing_id())


def read_csv(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, required: Sequence[str] = (),
    sep: str = ",", blanks: str = "blank",
) -> DataFrame:
    """Text columns with ``_ord``; quoted cells may hold line ends; blanks stay empty text (or null).

    Without ``columns`` the header names them. Missing required columns are an error.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if columns is not None:
        reader = reader.schema(schemas.ddl(tuple(columns))).option("enforceSchema", False)
    df = reader.csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    df = with_ordinal(df)
    return df.na.fill("") if blanks == "blank" else df


def read_relation(spark: SparkSession, root: str, relation: str, columns: Sequence[str], projects: Sequence[str] | None = None) -> DataFrame:
    """A relation over all project files, integers cast, pruned to ``projects`` by the file's name."""
    df = read_csv(spark, f"{root}/{relation}", columns, blanks=schemas.BLANKS.get(relation, "blank"))
    stem = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"\.csv$", "")
    if projects is not None:
        df = df.where(F.url_decode(stem).isin(*projects))
    return df.withColumns({c: text.whole(F.col(c)) for c in df.columns if c in schemas.INTEGERS})


def detect_separator(spark: SparkSession, path: str) -> str:
    """Comma or semicolon, by the first line (a driver-side look at one line)."""
    first = spark.read.text(path).head(1)
    line = first[0][0] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def union_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files under one set of columns; a column that a file lacks is null. Files may differ in separator."""
    frames = [read_csv(spark, p, sep=detect_separator(spark, p)).drop(ORD) for p in paths]
    if not frames:
        raise ValueError("no file to read")
    return union_all(frames)


def read_raw_smells(spark: SparkSession, path: str) -> DataFrame:
    needed = ("pathFile", "testSmellName", "testSmellMethod", "testSmellLineBegin", "testSmellLineEnd")
    return read_csv(spark, path, required=needed, sep=";")


def write_csv(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Text as it is, quotes doubled; integers without fraction. Committed as a whole."""
    plain = df.drop(ORD)
    plain = plain.withColumns({c: F.col(c).cast("string") for c, t in plain.dtypes if not t.startswith("string")})
    writer = plain.na.fill("").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(*partition) if partition else writer).csv(path)


def write_relation(df: DataFrame, path: str, partition: Sequence[str] = ("project",)) -> None:
    """Parquet by project; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def normal_integers(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Float-shaped integers rewritten in ``columns``; and one row of changed rows and cells."""
    new = {c: text.normal_integer(F.col(c)) for c in columns if c in df.columns}
    changed = [(~n.eqNullSafe(text.blank(F.col(c)))).cast("int") for c, n in new.items()]
    cells = sum(changed[1:], changed[0]) if changed else F.lit(0)
    counts = df.select(cells.alias("n")).agg(F.count_if(F.col("n") > 0).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells"))
    return df.withColumns(new), counts
