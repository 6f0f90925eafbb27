"""Files as tables: listings, JSON of unknown shape, TSV manifests, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.profile import file_kind, source_format

SAFE_ID = "^[A-Za-z0-9_.-]+$"
#: Metadata of a source that could not be read: nothing is approved.
UNKNOWN_SOURCE = {"license": "Unknown", "publication_approved": False, "source": "Unknown"}


def walk(spark: SparkSession, path: str) -> DataFrame:
    """path, length and kind of all files below ``path``, sorted, but for hidden
    ones and those of node_modules and .git; names of ``path`` itself do not count."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    depth = len(root.toUri().getPath().rstrip("/").split("/"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    # names after the scheme and the root's own
    names = F.split(F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), "/")
    hidden = F.exists(F.slice(names, depth + 1, F.size(names)), lambda n: n.startswith(".") | (n == "node_modules"))
    return found.where(~hidden).withColumn("kind", file_kind(F.col("path"))).orderBy("path")


def json_documents(spark: SparkSession, path: str, lines: bool = False, glob: str | None = None) -> DataFrame:
    """file, value (text) and document (VARIANT) of JSON files, one each, or one a line;
    text that is no JSON has a null document and is kept."""
    rows = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = rows.where(F.trim("value") != "")
    return rows.select("file", "value", F.try_parse_json("value").alias("document"))


def records(documents: DataFrame) -> DataFrame:
    """One row for each record of the documents: of an array, or of an object's
    records, items or data, or the object itself; with the document's format."""
    v = F.col("document")
    list_of = lambda p: F.try_variant_get(v, p, "array<variant>")
    many = F.coalesce(list_of("$"), list_of("$.records"), list_of("$.items"), list_of("$.data"), F.array(v))
    return documents.where(v.isNotNull()).select("file", source_format(v).alias("format"), F.posexplode(many).alias("index", "record"))


def annotation_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of ``*.json`` but manifests, with file and ``problem`` where the
    sample_id is unsafe."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).where(~F.col("file").rlike(r"(^|/)(conversion-)?manifest\.json$"))
    return rows.withColumn("problem", F.when(~F.coalesce(F.col("sample_id").rlike(SAFE_ID), F.lit(False)), F.lit("unsafe sample_id")))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a map that is overwritten keeps it."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def tsv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """image and text of lines cut at the first tab."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.col("value").contains("\t")).select(parts[0].alias("image"), parts[1].alias("text"))


def png_dimensions(content: Column) -> Column:
    """struct(width, height) from a PNG's first 24 bytes, null for others."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("long")
    good = (F.substring(head, 1, 16) == "89504E470D0A1A0A") & (F.length(head) == 48)
    return F.when(good, F.struct(number(33).alias("width"), number(41).alias("height")))


def images(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(path)
    return found.withColumn("dimensions", png_dimensions(F.col("content")))


def source_metadata(spark: SparkSession, path: str) -> dict:
    """A small JSON file over safe defaults; only a true ``publication_approved``
    approves, and a file that is missing or broken leaves the defaults."""
    try:
        row = spark.read.text(path, wholetext=True).select(F.from_json("value", "license string, publication_approved boolean, source string").alias("m")).first()
    except Exception as problem:  # noqa: BLE001 - any unreadable file leaves the defaults
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        row = None
    given = row["m"].asDict() if row and row["m"] else {}
    return UNKNOWN_SOURCE | {k: v for k, v in given.items() if v is not None}


def infer(images_: DataFrame, infer_batch, schema: str) -> DataFrame:
    """Runs ``infer_batch`` (pandas frame to pandas frame) over batches of images;
    a batch that fails gives its paths with an ``error``."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            try:
                yield infer_batch(frame)
            except Exception as problem:  # noqa: BLE001 - the error is the row's result
                yield pd.DataFrame({"path": frame["path"], "error": str(problem)}).reindex(columns=[c.split()[0] for c in schema.split(", ")])

    return images_.mapInPandas(run, schema)
