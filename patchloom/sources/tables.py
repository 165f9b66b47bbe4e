"""Reading pair tables and writing results."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the columns of a pair table.
PAIR_COLUMNS = ("cve_id", "vulnerability_type", "language", "file", "method", "vulnerable_code", "fixed_code", "commit_hash", "repo", "commit_msg")
PAIR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in PAIR_COLUMNS])


def is_url(value: str) -> bool:
    return re.match(r"https?://", str(value)) is not None


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header, quoted multi-line fields, all columns text; empty fields are null.

    Without a schema, the names are the header's. A web address is fetched into the shared folder
    first. A path that doesn't exist raises FileNotFoundError.
    """
    if is_url(path):
        path = fetched(spark, path)
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    try:
        return (reader.schema(schema) if schema else reader).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def fetched(spark: SparkSession, address: str) -> str:
    """Where in the shared folder the file of a web address is, after it was copied there as a stream."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    named = f"{shared_dir(spark)}/fetched-{uuid.uuid4().hex}.csv"
    _made.append(named)
    where = jvm.org.apache.hadoop.fs.Path(named)
    out = where.getFileSystem(conf).create(where)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URL(address).openStream(), out, conf, True)
    return named


#: What stored() and fetched() have made in this process.
_made: list[str] = []


def discard(spark: SparkSession) -> None:
    """Delete the tables that stored() kept so far: for when no plan that starts at them is needed any more."""
    for path in _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, unset on a local master, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return (named or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: later plans start there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A pair table from CSV or, by its ending, Parquet; with row_index, in the file's order for CSV."""
    if str(path).rstrip("/").endswith(".parquet"):
        return with_row_index(spark.read.parquet(path))
    found = read_csv(spark, path)
    return with_row_index(found)


def with_row_index(df: DataFrame, order: str | None = None) -> DataFrame:
    """df with row_index from 0 without gaps, in order of a column or else of the input; kept if there.

    No task gets all rows: rows are numbered inside their partition, and partitions are counted.
    """
    if "row_index" in df.columns:
        return df
    if order is not None:
        df = df.sort(order)
    # kept, so that counts and rows see the same partitions
    marked = stored(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    per = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(starts), "_part").withColumn("row_index", place.cast("long")).drop("_id", "_part", "_start")


def write_csv(df: DataFrame, path: str, single: bool = False, marked: bool = False) -> None:
    """A folder of CSV files with headers; single for one file of a small table, marked for a byte order mark before each header, by which spreadsheets know UTF-8."""
    if marked:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def run_folder(base: str, now: datetime | None = None) -> str:
    return f"{base.rstrip('/')}/run_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", text).strip("_")


#: Rows of a sheet below its header.
SHEET_ROWS = 1_048_575
#: Tables with a row for each of the input's; the others have one for each key.
PER_ROW = {"predictions"}


def write_report(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("csv",)) -> list[str]:
    """Each non-empty table in each format: csv (a folder each), parquet, xlsx (one workbook of small tables, if a writer is installed).

    Tables of PER_ROW are folders of CSV parts, in place of a sheet too. ValueError if a sheet would be cut.
    """
    made = []
    filled = {name: df for name, df in tables.items() if not df.isEmpty()}
    for name, df in filled.items():
        if "csv" in formats or "xlsx" in formats and name in PER_ROW:
            write_csv(df, path := f"{folder}/{safe_name(name)}.csv", single=name not in PER_ROW, marked=True)
            made.append(path)
        if "parquet" in formats:
            df.write.mode("overwrite").parquet(path := f"{folder}/{safe_name(name)}.parquet")
            made.append(path)
    if "xlsx" in formats:
        try:
            import openpyxl  # noqa: F401
            import pandas as pd
        except ImportError:
            return made
        sheets = {name: df for name, df in filled.items() if name not in PER_ROW}
        for name, df in sheets.items():
            if df.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
                raise ValueError(f"{name}: more than {SHEET_ROWS} rows don't fit a sheet")
        if not sheets:
            return made
        Path(folder).mkdir(parents=True, exist_ok=True)
        with pd.ExcelWriter(path := f"{folder}/report.xlsx") as book:
            for name, df in sheets.items():
                df.toPandas().to_excel(book, sheet_name=name[:31], index=False, freeze_panes=(1, 0))
        made.append(path)
    return made
