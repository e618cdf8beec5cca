"""Text matrices, subject catalogues, atlases and resumable stores. Only Spark's readers touch the paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contrasts of the recordings, how their file names end and their sampling rates (Hz); frequency bands of the workflows.
CONTRASTS = [
    ("CBF_ASL", "kwCBF4D.ts.1D", 1 / 5.5),
    ("CBV_VASO", "kwfcurN_Vaso.ts.1D", 1 / 1.353),
    ("BOLD", "kwfurN_Bold.ts.1D", 1 / 1.353),
    ("BOLD_RS", "kwoptcomMIRDenoised_bold.ts.1D", 1 / 0.98),
]
BANDS = [
    ("comparison", "slow5", 0.01, 0.073), ("comparison", "slow4", 0.073, 0.18), ("comparison", "test", 0.01, 0.18),
    ("matrix", "slow5", 0.01, 0.027), ("matrix", "slow4", 0.027, 0.073), ("matrix", "test", 0.073, 0.18),
    ("slow", "slow5", 0.01, 0.027), ("slow", "slow4", 0.027, 0.073),
]


def bands(spark: SparkSession, workflow: str) -> DataFrame:
    """(band, lo, hi) of a workflow."""
    return spark.createDataFrame(BANDS, "workflow string, band string, lo double, hi double").where(F.col("workflow") == workflow).drop("workflow")


def contrasts(spark: SparkSession, without: Sequence[str] = ()) -> DataFrame:
    """(contrast, file_suffix, fs_hz) of the contrasts, some left out."""
    rows = [row for row in CONTRASTS if row[0] not in without]
    return spark.createDataFrame(rows, "contrast string, file_suffix string, fs_hz double")


def text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, series_id, t, value) of white-space separated matrices (time by series). A file is one row, so its lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.rtrim(F.regexp_replace("value", r"\r", "")), "\n").alias("lines"))
    lines = files.select("path", F.posexplode(F.filter("lines", lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).alias("t", "line"))
    cells = lines.select("path", "t", F.posexplode(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")).alias("series_id", "v"))
    return cells.select("path", "series_id", "t", F.col("v").cast("double").alias("value"))


def subjects(matrices: DataFrame, catalogue: DataFrame, prefix: str = "sub-") -> DataFrame:
    """(subject, contrast, fs_hz, series_id, t, value) by each path's folder that begins with the prefix and its file's suffix."""
    own = matrices.withColumn("subject", F.regexp_extract("path", rf"/({prefix}[^/]*)/", 1)).where("subject <> ''")
    return own.join(F.broadcast(catalogue), F.expr("endswith(path, file_suffix)")).select("subject", "contrast", "fs_hz", "series_id", "t", "value")


def missing(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(subject, contrast) that are expected of subjects seen, but weren't found."""
    expected = found.select("subject").distinct().crossJoin(F.broadcast(catalogue.select("contrast")))
    return expected.join(found.select("subject", "contrast").distinct(), ["subject", "contrast"], "left_anti")


def atlas(spark: SparkSession, path: str) -> DataFrame:
    """(atlas, idx, x, y, z, label) of atlas XML files."""
    schema = "_index int, _x int, _y int, _z int, _VALUE string"
    rows = spark.read.format("xml").option("rowTag", "label").schema(schema).load(path)
    name = F.regexp_extract("_metadata.file_path", r"([^/]*)\.xml$", 1)
    return rows.select(name.alias("atlas"), F.col("_index").alias("idx"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"), F.col("_VALUE").alias("label"))


def codes(spark: SparkSession, path: str) -> DataFrame:
    """(position, code) of a list of label codes, one a line or apart by white space."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("position", "code")).withColumn("code", F.col("code").cast("int"))


def recode(voxels: DataFrame, table: DataFrame, column: str = "region") -> DataFrame:
    """A voxel's position in the list becomes its code; positions outside stay."""
    held = voxels.join(F.broadcast(table.withColumnRenamed("position", column)), column, "left")
    return held.withColumn(column, F.coalesce("code", column)).drop("code").select(*voxels.columns)


def save(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Append as Parquet, partitioned."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def not_done(wanted: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows of `wanted` whose keys a store doesn't have yet; all of them if there is no store."""
    spark = wanted.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return wanted
    return wanted.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored graph or matrix: a table that save() wrote. Pickles aren't read, as they may run code."""
    return spark.read.parquet(path)
