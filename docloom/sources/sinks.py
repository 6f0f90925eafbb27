"""Tables as files: documents, splits, manifests and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.annotations import validate


def write_documents(rows: DataFrame, path: str, key: str = "sample_id") -> None:
    """One folder of JSON for each key."""
    rows.withColumn("__key", F.col(key)).repartition("__key").write.partitionBy("__key").json(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    rows.write.partitionBy(split).json(path)


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(F.col(text).cast("string")).write.text(path)


def recognition_manifest(rows: DataFrame) -> DataFrame:
    """Lines ``image \\t text`` of crops (split, image, text): white space collapsed,
    empty texts left out, / in paths."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.where(text != "").select("split", F.concat_ws("\t", F.replace("image", F.lit("\\"), F.lit("/")), text).alias("value"))


def write_recognition_manifest(rows: DataFrame, path: str) -> None:
    recognition_manifest(rows).write.partitionBy("split").text(path)


def bundle(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records with the SHA-256 of their JSON, and the invalid ones."""
    rows = validate(records)
    body = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    good = rows.where("valid").select("sample_id", body.alias("body")).withColumn("sha256", F.sha2("body", 256))
    return good, rows.where("NOT valid").select("sample_id", "errors")


def export_bundle(records: DataFrame, path: str) -> DataFrame:
    """Writes the records and returns the manifest; refuses without records or with
    an invalid one."""
    good, bad = bundle(records)
    problem = bad.first()
    if problem or good.isEmpty():
        raise ValueError(f"invalid record {problem['sample_id']}: {problem['errors']}" if problem else "no records")
    good.select(F.col("body").alias("value")).write.text(path)
    return good.select("sample_id", "sha256")


def markdown(title: str, summary: dict) -> str:
    return "\n".join([f"# {title}", "", *[f"- {k}: {v}" for k, v in summary.items()], ""])
