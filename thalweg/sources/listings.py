"""File listings and the tables a survey's files make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".lrv")
IMAGE = (".jpg", ".jpeg", ".png", ".tif", ".tiff")


def find_files(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = True, hidden: bool = False, outside: str | None = None) -> DataFrame:
    """path, length, modified, parent, name, stem, ext of files by extension (any case), by path.

    Files that start with ._ are left out unless hidden, and those under `outside`. Contents aren't read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return matching(listed.select("path", "length", F.col("modificationTime").alias("modified")), extensions, hidden, outside).orderBy("path")


def matching(files: DataFrame, extensions: tuple[str, ...], hidden: bool = False, outside: str | None = None) -> DataFrame:
    """files(path, ...) with the extensions, and their parent, name, stem and ext."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = files.withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", name)
    rows = rows.withColumn("stem", F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")).withColumn("ext", F.lower(F.regexp_extract("name", r".(\.[^.]*)$", 1)))
    rows = rows.where(F.col("ext").isin(*extensions))
    if not hidden:
        rows = rows.where(~F.col("name").startswith("._"))
    if outside:
        rows = rows.where(~F.col("path").contains(outside.rstrip("/") + "/"))
    return rows


def by_folder(images: DataFrame, root: str) -> DataFrame:
    """images with split and class from <split>/<class>/<file> below root."""
    relative = F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "")
    parts = F.split(relative, "/")
    return images.withColumn("split", F.get(parts, 0)).withColumn("class", F.element_at(parts, -2))


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All rows of a frame table written as CSV, and the geotagged ones."""
    rows = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    for c in ("latitude", "longitude", "depth_m"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.col(c).try_cast("double"))
    return rows, rows.where("status = 'ok'")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A training log: CSV with padded column names."""
    rows = spark.read.option("header", "true").option("inferSchema", "true").option("ignoreLeadingWhiteSpace", "true").csv(path)
    return rows.toDF(*(c.strip() for c in rows.columns))


def worth_chunking(relative: Column, length: Column, documents: bool = True) -> Column:
    """Whether a file of a repository is of a known kind, outside tool folders, and not too long."""
    from .chunks import MAX_BYTES, PLAIN, SECTIONED, SKIPPED_DIRS

    kinds = (".py", ".ipynb", *SECTIONED, *PLAIN) + ((".pdf", ".pptx") if documents else ())
    ext = F.lower(F.regexp_extract(relative, r"(\.[^./]*)$", 1))
    skipped = F.exists(F.split(relative, "/"), lambda d: d.isin(*SKIPPED_DIRS))
    return ext.isin(*kinds) & ~skipped & ((length <= MAX_BYTES) | (ext == ".ipynb"))


def repository_files(spark: SparkSession, root: str, documents: bool = True) -> DataFrame:
    """repo, path, content of the files worth chunking: known extensions, no tool folders, 5 MB at most but for notebooks."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", f"^.*?{base}/", "")
    rows = files.where(worth_chunking(relative, F.col("length"), documents))
    return rows.select(F.lit(base.rsplit("/", 1)[-1]).alias("repo"), relative.alias("path"), "content")
