"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.jaccard import jaccard_classes
from docloom.llm.linededup import dedup_lines
from docloom.llm.mixing import WORD, mix
from docloom.llm.packing import pack
from docloom.llm.quality import quality
from docloom.session import Scratch, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with non-null key columns that are equal where the named ones are,
    nulls included: joins and windows over them need the same partitioning."""
    kinds = dict(df.dtypes)
    out, keys = df, []
    for c in names:
        filler = F.lit("") if kinds[c] == "string" else F.lit(0)
        out = out.withColumn(f"__{c}", F.coalesce(F.col(c), filler)).withColumn(f"__no_{c}", F.col(c).isNull())
        keys += [f"__{c}", f"__no_{c}"]
    return out, keys


def _join(docs: DataFrame, found: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """Documents with the rows of ``found`` of the same doc_id, h (the hash of the
    text) and further columns."""
    left, keys = _keyed(docs.select(*COLUMNS).withColumn("h", F.xxhash64("text")), *names)
    right, _ = _keyed(found, *names)
    return left.join(right.drop(*names), keys), keys


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words
    and go; repeated rows and rows with null ids are judged each, very long texts
    whole. An empty table gives no rows; other columns are left out."""
    kept = quality(docs).where("kept").select("doc_id", "h", "lang").distinct()
    return _join(docs, kept, "doc_id", "h", "lang")[0].select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates, but for a template's first.
    Those that have no word left were copies line by line, and go. Null and empty
    texts stay as they are, and so does every row in which nothing is dropped,
    repeated ones too. An empty table gives no rows; other columns are left out."""
    found = dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_dropped") == 0) | (F.regexp_count("text", F.lit(WORD)) > 0)
    return found.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id, once.
    Documents without words are copies of nothing and stay, repeated ones too; of
    equal rows one stays, the first by lang and source; a null id is the largest.
    An empty table gives no rows; other columns are left out."""
    found = Scratch(spark, "pipeline").keep(jaccard_classes(docs), "classes")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("h"))).alias("one")
    kept = found.where("n_shingles > 0").groupBy("group_id").agg(one).select("one.doc_id", "one.h", F.lit(False).alias("empty"))
    kept = kept.unionByName(found.where("n_shingles = 0").select("doc_id", "h", F.lit(True).alias("empty")).distinct())
    rows, keys = _join(docs, kept, "doc_id", "h")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("lang", "source")))
    return rows.where("nth = 1 OR empty").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. The one document of a source
    that it takes in part ends in its last copy after so many words, with all that
    stands between and before them, so that a source misses its target by
    a word at most. Texts without words are never taken; equal rows are taken
    together, as often as all of them. An empty table gives no rows; other columns
    are left out."""
    taken = mix(docs).groupBy("doc_id", "h", "source").agg(
        F.sum("copies").alias("copies"), F.sum(F.col("taken") - F.col("size") * F.col("copies")).cast("int").alias("words")
    )
    rows, keys = _join(docs, taken.where("copies > 0 OR words > 0"), "doc_id", "h", "source")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("lang"))).where("nth = 1")
    # each word with what stands before it; the split has one entry more
    pieces = F.zip_with(F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), lambda a, b: F.concat(a, b))
    part = F.array_join(F.slice(pieces, 1, F.greatest(F.col("words"), F.lit(1))), "")
    last = F.when(F.col("words") > 0, F.array(part)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat("text", F.col("copies").cast("int")), last)
    out = rows.withColumn("text", F.explode(texts)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences. Each row is packed, repeated ones
    too; a null or empty text is its end token alone, a very long one as many
    pieces as it needs. An empty table gives no rows; other columns are left out."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenisers and random rounding are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again."""
    prepare(spark)
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
