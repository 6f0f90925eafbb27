"""Files by name: a manifest says which to open, and a column holds what to write.

Executors open the files of their own rows, so the manifest is dealt like any
other table and nothing else in a folder is touched. Any file system that pyarrow knows by
its URI will do (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.conversion import number
from docloom.operators.inspection import is_object, items, let
from docloom.operators.profile import image_ref
from docloom.sources.files import json_documents, png_dimensions, walk

#: Bytes of contents that one batch holds, but for a larger single file.
BATCH_BYTES = 16 << 20
#: Bytes of a PNG up to and with its size.
PNG_HEAD = 24
#: Raw labels that a baseline reads (fixed values).
TARGET_LABELS = ("drugname", "usage")


def _opened(uri: str, known: dict):
    """The file system and path of a URI; file systems are made once in a task."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if not sep:
        return known.setdefault("", fs.LocalFileSystem()), uri.removeprefix("file:")
    place = f"{scheme}://{rest.partition('/')[0]}"
    if scheme == "file":
        return known.setdefault("", fs.LocalFileSystem()), "/" + rest.partition("/")[2]
    if place not in known:
        known[place] = fs.FileSystem.from_uri(f"{place}/")[0]
    return known[place], rest if scheme != "hdfs" else "/" + rest.partition("/")[2]


def open_named(manifest: DataFrame, path: str = "path", head: int | None = None) -> DataFrame:
    """``manifest`` with content and error: the bytes of each row's file, or its first
    ``head`` ones, of which no others are read. A file that cannot be opened has null content and
    the error; a null path has both null. Contents are sent on in bounded batches."""
    at = manifest.columns.index(path)

    def run(arrow_batches):
        known: dict = {}

        def out(batch, rows):
            take = pa.array([i for i, _, _ in rows], pa.int64())
            columns = [c.take(take) for c in batch.columns]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([c for _, c, _ in rows], pa.binary()), pa.array([e for _, _, e in rows], pa.string())],
                [*batch.schema.names, "content", "error"],
            )

        for batch in arrow_batches:
            rows, held = [], 0
            for i, uri in enumerate(batch.column(at).to_pylist()):
                content = error = None
                if uri is not None:
                    try:
                        system, name = _opened(uri, known)
                        with system.open_input_file(name) as f:
                            content = f.read() if head is None else f.read(head)
                    except FileNotFoundError:
                        error = "missing"
                    except (OSError, ValueError, pa.ArrowException) as problem:
                        error = type(problem).__name__
                if rows and held + len(content or b"") > BATCH_BYTES:
                    yield out(batch, rows)
                    rows, held = [], 0
                rows.append((i, content, error))
                held += len(content or b"")
            if rows:
                yield out(batch, rows)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)
    return manifest.mapInArrow(run, f"{fields}, content binary, error string")


def write_named(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, length and sha256 of a file written for each row, when the result is
    computed. A file appears whole under its name or not at all; a task that runs again writes
    the same one anew."""

    def run(arrow_batches):
        known: dict = {}
        for batch in arrow_batches:
            done = []
            for uri, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = _opened(uri, known)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                part = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(data)
                system.move(part, name)
                done.append((uri, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "length", "sha256"])

    chosen = rows.select(F.col(path).cast("string"), F.col(content).cast("binary"))
    return chosen.mapInArrow(run, "path string, length long, sha256 string")


def scan_manifest(manifest: DataFrame, path: str = "path") -> DataFrame:
    """``manifest`` with document (VARIANT) and error: only the named files are opened;
    one that is missing or no JSON gives a null document and says so."""
    found = open_named(manifest, path).withColumn("document", F.try_parse_json(F.decode("content", "UTF-8")))
    unread = F.when(F.col("content").isNotNull() & F.col("document").isNull(), "not JSON")
    return found.withColumn("error", F.coalesce("error", unread)).drop("content")


def _inside(box: Column, size: Column) -> Column:
    """Whether all of at least four numbers are finite and, where a size is known, the first four are a box in it."""
    corner = lambda i: box[i]
    held = (corner(0) >= 0) & (corner(1) >= 0) & (corner(2) >= corner(0)) & (corner(3) >= corner(1)) & (corner(2) <= size["width"]) & (corner(3) <= size["height"])
    return F.when((F.size(box) >= 4) & F.forall(box, lambda v: v.isNotNull()), F.when(size.isNull(), True).otherwise(held)).otherwise(F.lit(False))


def word_box_samples(documents: DataFrame, sizes: DataFrame, targets: tuple = TARGET_LABELS) -> DataFrame:
    """One row for each of the ``documents`` (file, document) whose elements are all
    objects with a label and a box: file, sample_id, source_split, word_box_count, label_counts (map), target_box_count,
    valid_box_count, image_width and image_height. ``sizes`` (file, size) has the
    images' width and height, null where unknown; then any four numbers are a valid box."""
    words = F.try_variant_get("document", "$", "array<variant>")
    has = lambda w, p: F.try_variant_get(w, p, "variant").isNotNull()
    rows = documents.where(F.forall(words, lambda w: is_object(w) & has(w, "$.label") & has(w, "$.box"))).select("file", words.alias("words"))
    rows = rows.join(sizes.select("file", "size"), "file", "left")
    label = lambda w: F.coalesce(F.try_variant_get(w, "$.label", "string"), F.lit("unknown"))
    box = lambda w: F.transform(items(w, "$.box"), lambda x: number(x, "$"))
    rows = rows.select("file", "size", F.transform("words", label).alias("labels"), F.transform("words", lambda w: let(box(w), lambda b: _inside(b, F.col("size")))).alias("valid"))
    names = F.array_sort(F.array_distinct("labels"))
    counts = F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter("labels", lambda x: x == n)).cast("long")))
    count = lambda c, f: F.size(F.filter(c, f)).cast("long")
    test = F.contains(F.replace("file", F.lit("\\"), F.lit("/")), F.lit("/public_test/"))
    return rows.select(
        "file", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("sample_id"), F.when(test, "test").otherwise("train").alias("source_split"),
        F.size("labels").cast("long").alias("word_box_count"), counts.alias("label_counts"), count("labels", lambda x: x.isin(*targets)).alias("target_box_count"),
        count("valid", lambda v: v).alias("valid_box_count"), F.col("size.width").alias("image_width"), F.col("size.height").alias("image_height"),
    )


def scan_word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``word_box_samples`` of the JSON files below a folder; of each one's image
    (label/ as image/, .png), the first 24 bytes are read."""
    files = walk(spark, path).where(F.col("path").rlike(r"(?i)\.json$")).select(F.col("path").alias("file"))
    heads = open_named(files.withColumn("image", image_ref(F.col("file"))), "image", PNG_HEAD)
    sizes = heads.select("file", png_dimensions(F.col("content")).alias("size"))
    return word_box_samples(json_documents(spark, path, glob="*.json"), sizes)
