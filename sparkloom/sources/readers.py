"""Line- and file-oriented readers with row ordinals, format dispatch and a registry of named datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# File suffixes and the readers they mean.
FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files, gzip by suffix; blank lines have numbers but no rows.

    A file is one record here, so that its lines can be numbered without a
    pass over all files; use ``read_rows`` with ``ordinals=False`` for files too
    large for that.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    return lines.where(F.trim("line") != "").select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def read_rows(spark: SparkSession, paths: str | list[str], schema: StructType, *, ordinals: bool = True) -> DataFrame:
    """JSON lines (or gzip) with the columns of ``schema``, path and line_no; a line that is no object fails the job."""
    if not ordinals:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    lines = read_lines(spark, paths)
    is_object = F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    checked = lines.withColumn("line", F.when(is_object, F.col("line")).otherwise(F.raise_error(F.concat_ws("", F.col("path"), F.lit(":"), F.col("line_no"), F.lit(" is not an object")))))
    return checked.select("path", "line_no", F.from_json("line", schema).alias("r")).select("path", "line_no", "r.*")


def read_rows_or_rejects(spark: SparkSession, paths: str | list[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines that parse as objects, and the others with a reason."""
    lines = read_lines(spark, paths)
    good = F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    rows = lines.where(good).select("path", "line_no", F.from_json("line", schema).alias("r")).select("path", "line_no", "r.*")
    return rows, lines.where(~F.coalesce(good, F.lit(False))).withColumn("reason", F.lit("invalid_json"))


def read_payloads(spark: SparkSession, paths: str | list[str], item: StructType) -> DataFrame:
    """Items of JSON files that hold an array, or an object with the array under 'data'."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v"))
    body = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.data"))
    items = files.select("path", F.posexplode(F.from_json(body, f"array<{item.simpleString()}>")).alias("at", "r"))
    return items.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "r.*")


def format_of(paths: list[str]) -> str:
    """The one reader that all suffixes mean, a trailing .gz aside."""
    found = {FORMATS.get(p.removesuffix(".gz").rsplit(".", 1)[-1].lower()) for p in paths}
    if len(found) != 1 or None in found:
        raise ValueError(f"files must agree in a known format: {sorted(map(str, found))}")
    return found.pop()


def read_any(spark: SparkSession, paths: list[str], schema: StructType | None = None, **options: str) -> DataFrame:
    """By suffix; CSV has a header."""
    kind = format_of(paths)
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).format(kind).load(paths)


def read_metadata_csv(spark: SparkSession, path: str, where: str, order: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """A CSV table filtered, ordered by an expression (columns are text), and cut to a range of rows."""
    rows = spark.read.option("header", "true").csv(path).where(where).orderBy(F.expr(order)).offset(skip)
    return rows if limit is None else rows.limit(limit)


def read_trajectory(spark: SparkSession, paths: str | list[str], names: tuple[str, ...] = ("t", "rx", "ry", "rz", "x", "y", "z")) -> DataFrame:
    """White-space separated numbers, one column each; lines with other counts or other words are dropped."""
    lines = read_lines(spark, paths)
    cells = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    good = lines.withColumn("c", cells).where((F.size("c") == len(names)) & F.forall("c", lambda x: x.isNotNull()))
    return good.select("path", "line_no", *(F.col("c")[i].alias(n) for i, n in enumerate(names)))


def read_intrinsics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """width, height, fx, fy, cx, cy from the first six numbers of each file."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("c"))
    names = ("width", "height", "fx", "fy", "cx", "cy")
    return files.where(F.size("c") >= 6).select("path", *(F.col("c")[i].try_cast("double").alias(n) for i, n in enumerate(names)))


def read_matrices(spark: SparkSession, paths: str | list[str], n: int = 4) -> DataFrame:
    """(path, m array<array<double>>) of n x n numbers as text; files of other counts are dropped."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.transform(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), lambda x: x.try_cast("double")).alias("c"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("c", i * n + 1, F.lit(n)))
    return files.where((F.size("c") == n * n) & F.forall("c", lambda x: x.isNotNull())).select("path", rows.alias("m"))


def read_shards(spark: SparkSession, pattern: str, n: int, schema: StructType) -> DataFrame:
    """JSON shards {shard}of{n} of a name pattern such as 'run_{shard:02d}of{n:02d}.jsonl'; all must exist."""
    paths = [pattern.format(shard=i, n=n) for i in range(n)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if missing:
        raise FileNotFoundError(f"missing shards: {missing}")
    return spark.read.schema(schema).json(paths)


@dataclass
class Dataset:
    """Where a named dataset is and what its columns are called here."""

    paths: list[str]
    columns: dict[str, str] = field(default_factory=dict)
    split: str | None = None
    streaming: bool = False
    max_samples: int | None = None
    weight: float = 1.0


class Registry:
    """Named datasets; reading renames columns, picks the split and cuts to max_samples."""

    def __init__(self, datasets: dict[str, Dataset] | None = None):
        self.datasets = dict(datasets or {})
        if len({d.streaming for d in self.datasets.values()}) > 1:
            raise ValueError("datasets must be all streaming or all not")

    @classmethod
    def from_dict(cls, config: dict[str, dict]) -> Registry:
        return cls({name: Dataset(**entry) for name, entry in config.items()})

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        entry = self.datasets[name]
        df = read_any(spark, entry.paths).withColumnsRenamed(entry.columns)
        if entry.split:
            df = df.where(F.col("split") == entry.split)
        return df if entry.max_samples is None else df.limit(entry.max_samples)

    def register_views(self, spark: SparkSession) -> None:
        for name in self.datasets:
            self.read(spark, name).createOrReplaceTempView(name)
