"""Line deduplication by a fixed-depth tree of line templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import Scratch, prepare

#: Leading tokens of a leaf, least tokens of a line, documents in which a
#: template recurs, and the least share of a template's tokens that is constant.
DEPTH, MIN_TOKENS, MIN_DOCS, MIN_CONSTANT = 3, 1, 3, 0.5
ANY = "<*>"
_BLANKS = " \t\n\v\f\r"
_SPACE, _TOKEN = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: A whole token with a digit, between single blanks.
_NUMBERED = r"(?<![^\x20])[^\x20 0-9]*+[0-9][^\x20]*+"


def lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, h (a hash of the text), line_no, n (tokens), leaf and masked of every
    line with a token. ``masked`` has the tokens, one blank between two and each
    with a digit left open; a leaf is a hash of their number and the first
    ``depth`` of them (all of a shorter line). Each step is a projection of its own, or an
    expression used twice would be evaluated twice."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(F.col("line").rlike(_TOKEN))
    rows = rows.select("doc_id", "h", "line_no", F.btrim("line", F.lit(_BLANKS)).alias("line"))
    odd = F.col("line").contains("  ") | F.col("line").rlike(r"[\x09-\x0D]")
    plain = F.when(odd, F.regexp_replace("line", _SPACE, " ")).otherwise(F.col("line"))
    rows = rows.select("doc_id", "h", "line_no", plain.alias("line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _NUMBERED, ANY)).otherwise(F.col("line"))
    rows = rows.select("doc_id", "h", "line_no", masked.alias("masked"))
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    rows = rows.select("doc_id", "h", "line_no", n.alias("n"), "masked")
    return rows.withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", depth)))


def dropped_lines(docs: DataFrame, depth: int, min_tokens: int, min_docs: int, min_constant: float, scratch: Scratch) -> DataFrame:
    """doc_id, h and line_no of the lines to drop."""
    # texts are split into tokens once; the count of leaves reads two columns of it
    every = scratch.keep(lines(docs, depth), "every")
    long = every.where(F.col("n") >= min_tokens) if min_tokens > 1 else every
    leaves = scratch.keep(
        long.select("leaf", "doc_id").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves"
    )
    found = scratch.keep(long.join(leaves, "leaf", "left_semi").select("leaf", "doc_id", "h", "line_no", "masked"), "found")
    scratch.drop(every)
    # each distinct masked line once, with the documents it is in
    once = found.select("leaf", "masked", "doc_id").distinct().groupBy("leaf", "masked").agg(F.count("*").alias("docs"))
    once = scratch.keep(once.withColumn("line_id", F.xxhash64("masked")), "once")
    places = once.select("leaf", "line_id", "docs", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    common = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs"))
    common = scratch.keep(common.where((F.col("docs") >= min_docs) & (F.col("token") != ANY)).drop("docs"), "common")
    constant = places.join(common.withColumn("constant", F.lit(True)), ["leaf", "place", "token"], "left")
    token = F.when(F.col("constant"), F.col("token")).otherwise(F.lit(ANY))
    templates = constant.groupBy("leaf", "line_id").agg(
        F.sort_array(F.collect_list(F.struct("place", token.alias("token")))).alias("tokens"),
        F.count("constant").alias("constants"),
    )
    templates = templates.where(F.col("constants") >= min_constant * F.size("tokens")).select(
        "leaf", "line_id", F.array_join("tokens.token", " ").alias("template")
    )
    template_id = F.sha2(F.concat_ws(" ", F.col("leaf").cast("string"), F.col("template")), 256)
    templates = scratch.keep(templates.select("leaf", "line_id", template_id.alias("template")), "templates")
    of = scratch.keep(
        found.withColumn("line_id", F.xxhash64("masked"))
        .join(templates, ["leaf", "line_id"])
        .select("template", "doc_id", "h", "line_no"),
        "of",
    )
    in_docs = of.groupBy("template", "doc_id").agg(F.min(F.struct("h", "line_no")).alias("first"))
    recurring = in_docs.groupBy("template").agg(
        F.count("*").alias("docs"), F.min(F.struct("doc_id", "first.h", "first.line_no")).alias("first")
    )
    recurring = scratch.keep(recurring.where(F.col("docs") >= min_docs).select("template", "first"), "recurring")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("line_no") == F.col("first.line_no"))
    return of.join(recurring, "template").where(~kept).select("doc_id", "h", "line_no")


def dedup_lines(
    docs: DataFrame,
    depth: int = DEPTH,
    min_tokens: int = MIN_TOKENS,
    min_docs: int = MIN_DOCS,
    min_constant: float = MIN_CONSTANT,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_lines and n_dropped, and with each line
    dropped whose template recurs in at least ``min_docs`` documents, but for the
    template's first line by document and place.

    The tree has the number of tokens (runs outside ``\\x20\\x09-\\x0D``) at its
    first level and leading tokens below. In a leaf, a token is constant where at
    least ``min_docs`` documents have it in its place and it has no digit; others
    are variable fields. Lines of one leaf with the same constants share a
    template if at least ``min_constant`` of its tokens are constant. Lines
    without tokens, or of fewer than ``min_tokens``, stay. Null and empty texts
    stay as they are, with 0 and 1 lines; rows with one doc_id are one document,
    and so are null ids, which come first in order (rows of one doc_id by a hash
    of the text). A text of any length is one row of lines; an empty table gives
    no rows, and other columns are passed on whatever their names. All of it is DataFrame
    operations; hot templates and leaves are counted by partial sums, and joins
    have tables on both sides, so that Spark can split them.
    """
    prepare(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    gone = dropped_lines(docs.select("doc_id", "text"), depth, min_tokens, min_docs, min_constant, scratch)
    gone = scratch.keep(gone.groupBy("doc_id", "h").agg(F.collect_set("line_no").alias("gone")), "gone")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("gone").alias("__gone"))
    rows = docs.withColumn("__key", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["__key"] == gone["__h"]), "left")
    rows = rows.withColumn("__lines", F.split("text", "\n"))
    # places are subtracted by a hash set, so work is linear in lines however many go
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    left = F.transform(stay, lambda i: F.get("__lines", i))
    return (
        rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
        .drop("__id", "__h", "__gone", "__key", "__lines")
    )


SQL = """
WITH every AS (
  SELECT d.doc_id, md5(d.text) AS h, i - 1 AS line_no,
    list_transform(regexp_extract_all(string_split(d.text, chr(10))[i], '[^\\x20\\x09-\\x0D]+'),
      lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM documents d, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(i)
), leaf AS (
  SELECT doc_id, h, line_no, array_to_string(tokens, ' ') AS masked,
    len(tokens) || ' ' || array_to_string(list_slice(tokens, 1, 3), ' ') AS leaf
  FROM every WHERE len(tokens) >= 1
), found AS (
  SELECT * FROM leaf WHERE leaf IN (SELECT leaf FROM leaf GROUP BY leaf HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 3)
), once AS (
  SELECT leaf, masked, count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) AS docs FROM found GROUP BY leaf, masked
), places AS (
  SELECT o.leaf, o.masked, o.docs, i AS place, string_split(o.masked, ' ')[i] AS token
  FROM once o, unnest(range(1, len(string_split(o.masked, ' ')) + 1)) AS u(i)
), common AS (
  SELECT leaf, place, token FROM places WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(docs) >= 3
), templates AS (
  SELECT p.leaf, p.masked, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY p.place) AS template
  FROM places p LEFT JOIN common c ON p.leaf = c.leaf AND p.place = c.place AND p.token = c.token
  GROUP BY p.leaf, p.masked HAVING count(c.token) >= 0.5 * count(*)
), of AS (
  SELECT t.leaf, t.template, f.doc_id, f.h, f.line_no FROM found f JOIN templates t ON f.leaf = t.leaf AND f.masked = t.masked
), recurring AS (
  SELECT leaf, template FROM of GROUP BY leaf, template HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 3
), numbered AS (
  SELECT o.doc_id, o.h, o.line_no, rank() OVER (PARTITION BY o.leaf, o.template ORDER BY o.doc_id NULLS FIRST, o.h, o.line_no) AS nth
  FROM of o JOIN recurring r ON o.leaf = r.leaf AND o.template = r.template
), gone AS (
  SELECT doc_id, h, list(DISTINCT line_no) AS gone FROM numbered WHERE nth > 1 GROUP BY doc_id, h
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_dropped,
  CASE WHEN g.gone IS NULL THEN d.text ELSE array_to_string(list_transform(
    list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(g.gone, i - 1)),
    lambda i: string_split(d.text, chr(10))[i]), chr(10)) END AS text
FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND md5(d.text) = g.h
"""
