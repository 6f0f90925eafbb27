"""A corpus of samples, and substrings found through an index of three-letter pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.files import last_by_key

PIECE = 3
#: Folders of an index, by a text's first letters.
HEADS = 64
#: Postings of one task of a search.
TASK_POSTINGS = 50_000


def load_corpus(labels: DataFrame, candidates: DataFrame, drafts: DataFrame, order: str) -> DataFrame:
    """One row for each labelled sample (sample_id, source_file, raw_words): the sizes of its words and of its last
    candidate (sample_id, ``order``, candidate_entities, candidate_relations), and the
    draft's status (sample_id, annotation_status), unreviewed where there is none."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    known = last_by_key(candidates, "sample_id", order).drop(order)
    rows = labels.join(known, "sample_id", "left").join(drafts.select("sample_id", "annotation_status"), "sample_id", "left")
    return rows.select(
        "sample_id", "source_file", F.lit("train").alias("split"), size("raw_words").alias("raw_word_count"), size("candidate_entities").alias("candidate_entity_count"),
        size("candidate_relations").alias("candidate_relation_count"), F.coalesce("annotation_status", F.lit("unreviewed")).alias("draft_status"),
    )


def find_samples(corpus: DataFrame, search: str = "", status: str | None = None) -> DataFrame:
    """Samples whose id contains ``search``, whatever the case, with one status; an
    empty search or no status lets all through."""
    kept = corpus.where(F.contains(F.lower("sample_id"), F.lit(search.lower()))) if search else corpus
    return kept.where(F.col("draft_status") == status) if status else kept


def _head(piece: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(piece, 1, 1)), F.lit(HEADS)).cast("int")


def pieces(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key (as text), at, piece and head: of every place of a text in lower case, the letters
    from there on, three or what is left, and the folder they are in."""
    low = rows.select(F.col(key).cast("string").alias("key"), F.lower(F.col(text).cast("string")).alias("text")).where("length(text) > 0")
    each = low.select("key", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    each = each.select("key", "at", F.col("text").substr(F.col("at"), F.lit(PIECE)).alias("piece"))
    return each.withColumn("head", _head(F.col("piece")))


def write_index(rows: DataFrame, key: str, text: str, path: str) -> None:
    """The postings of ``rows``, in a folder for each head and sorted by piece, so that a
    search opens the folders it needs and skips row groups inside them."""
    found = pieces(rows, key, text)
    dealt = found.repartition("head", F.pmod(F.xxhash64("piece"), F.lit(8))).sortWithinPartitions("head", "piece")
    dealt.write.mode("overwrite").partitionBy("head").parquet(path)


def needles(patterns: DataFrame) -> DataFrame:
    """pattern_id, piece, size, offset and need: what an index must have for each of
    the ``patterns`` (pattern_id, pattern): pieces side by side, the last one flush with
    the end, and how many. A shorter pattern is one piece's beginning."""
    low = patterns.select("pattern_id", F.lower("pattern").alias("p")).where("length(p) > 0")
    n = F.length("p")
    last = F.greatest(n - PIECE, F.lit(0))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PIECE)), F.array(last)))
    rows = low.select("pattern_id", "p", F.size(offsets).alias("need"), F.explode(offsets).alias("offset"))
    piece = F.col("p").substr(F.col("offset") + 1, F.lit(PIECE))
    rows = rows.select("pattern_id", piece.alias("piece"), "offset", "need").withColumn("size", F.length("piece"))
    return rows.withColumn("head", _head(F.col("piece")))


def search_index(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """pattern_id and key of every text that contains a pattern, whatever the case.
    Postings of a pattern's pieces meet where they begin the pattern, so what all of them agree on
    is an occurrence, and no text is read. An empty pattern finds nothing."""
    wanted = needles(patterns)
    heads = [r[0] for r in wanted.select("head").distinct().collect()]  # at most HEADS
    index = spark.read.schema("key STRING, at INT, piece STRING, head INT").parquet(path).where(F.col("head").isin(heads))
    # a text's postings are in one task, which has so many that its matches fit in memory
    dealt = index.repartition(max(1, -(-index.count() // TASK_POSTINGS)), "key")
    starts = F.transform(F.sequence(F.lit(1), F.length("piece")), lambda n: F.substring("piece", F.lit(1), n))
    each = dealt.select("key", "at", "head", F.explode(starts).alias("start"))
    some = wanted.select("pattern_id", "head", F.col("piece").alias("start"), "offset", "need")
    met = each.join(some, ["head", "start"]).select("pattern_id", "key", (F.col("at") - F.col("offset")).alias("from"), "need")
    whole = met.groupBy("pattern_id", "key", "from").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    return whole.select("pattern_id", "key").distinct()
