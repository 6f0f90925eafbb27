"""All queries of the document operators over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import dates as D
from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators import annotations, contract, convert, evaluation, extract, inspection, layout, linking, medication, metrics, ner, plan, profile, splits
from docloom.plans import views
from docloom.session import table

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


# Linking: M06-M08, J10, O01, T03, T15, T16

_NORM = "trim(regexp_replace(regexp_replace({}, '(\\d)\\s*(mg|mcg|ug|g|ml)\\b', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_LINK = f"""
WITH q AS (
  SELECT p_partkey AS query_id, p_size AS size, p_partkey % 3 <> 0 AS has_mg,
    CASE WHEN p_partkey % 3 <> 0 THEN replace(p_name, 'm', 'rn')
      ELSE regexp_replace({_NORM.format("replace(p_name, 'm', 'rn') || ' ' || p_size || 'mg'")}, ' +', ' ', 'g') END AS name
  FROM part
), names AS (SELECT DISTINCT name FROM q), aliases AS (SELECT DISTINCT p_name FROM part),
sims AS (
  SELECT name, p_name, CASE WHEN name = p_name THEN 1.0::DOUBLE
    ELSE greatest(0.0::DOUBLE, 1 - levenshtein(name, p_name)::DOUBLE / greatest(length(name), length(p_name))) END AS s
  FROM names, aliases
), kinds AS (SELECT DISTINCT name, size FROM q), entries AS (
  SELECT k.name, k.size, c.p_partkey AS id, c.p_name AS brand,
    round(s.s * 0.8 + (CASE WHEN c.p_size = k.size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.2, 6) AS score
  FROM kinds k JOIN sims s ON s.name = k.name JOIN part c ON c.p_name = s.p_name WHERE s.s >= {{least}}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY score DESC, id) AS rank FROM entries
)"""


def _link_queries(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("line", views.noisy_line()).withColumn("d", T.split_drug_name("line"))
    return part.select(F.col("p_partkey").alias("query_id"), F.col("line").alias("raw_text"), "d.drug_name", F.get("d.strengths", F.lit(0)).alias("strength"))


_DECIDE = (
    _LINK.format(least="0.67")
    + """, two AS (
  SELECT name, size, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b,
    max(CASE WHEN rank = 1 THEN id END) AS id FROM ranked WHERE rank <= 2 GROUP BY name, size
), d AS (
  SELECT q.query_id, t.a, t.id, CASE WHEN t.a IS NULL OR t.a < 0.78 THEN 'not_found' WHEN t.a - t.b < 0.04 THEN 'needs_review' ELSE 'linked' END AS status
  FROM q LEFT JOIN two t ON t.name = q.name AND t.size = q.size
)
SELECT query_id, status, CASE WHEN status = 'linked' THEN CAST(id AS VARCHAR) END AS drug_database_id,
  CASE WHEN status = 'linked' THEN a END AS confidence FROM d"""
)


@query(_DECIDE)
def link_drugs(spark, sf_dir):
    found = linking.link_drugs(_link_queries(spark, sf_dir), views.catalog(spark, sf_dir), linking.BATCH_THRESHOLD, linking.BATCH_MARGIN)
    return found.select("query_id", "status", "drug_database_id", "confidence")


@query(_DECIDE)
def link_drugs_exact(spark, sf_dir):
    found = linking.link_drugs(
        _link_queries(spark, sf_dir), views.catalog(spark, sf_dir), linking.BATCH_THRESHOLD, linking.BATCH_MARGIN, pruned=False
    )
    return found.select("query_id", "status", "drug_database_id", "confidence")


@query(
    _LINK.format(least="0")
    + """
SELECT q.query_id, r.rank, CAST(r.id AS VARCHAR) AS drug_database_id, r.score
FROM q JOIN ranked r ON r.name = q.name AND r.size = q.size WHERE r.rank <= 5"""
)
def link_topk(spark, sf_dir):
    top = linking.top_candidates(_link_queries(spark, sf_dir), views.catalog(spark, sf_dir), 5)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "drug_database_id", "score")


@query(
    """
SELECT p_name AS normalized_name, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT p_brand) AS BIGINT) AS sample_count,
  min_by(p_name, p_partkey) AS brand_name, 'local-' || substr(sha1(p_name), 1, 12) AS drug_database_id,
  CAST(count(DISTINCT p_size) AS BIGINT) AS n_strengths
FROM part GROUP BY p_name"""
)
def candidate_dictionary(spark, sf_dir):
    text = F.concat(F.lit("2) "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg"))
    words = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sample_id"), F.col("p_partkey").alias("ord"), text.alias("text"))
    rows = linking.candidate_dictionary(words)
    return rows.select("normalized_name", "occurrences", "sample_count", "brand_name", "drug_database_id", F.size("strengths").cast("long").alias("n_strengths"))


@query(
    """
WITH gold AS (
  SELECT p_brand AS s, p_name AS n, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part
), lines AS (
  SELECT p_brand AS s, p_type AS n0, p_name AS n, p_size, p_partkey, p_size % 3 AS kind FROM part
), linked AS (
  SELECT s, n, row_number() OVER (PARTITION BY s, n ORDER BY p_partkey) AS k FROM
  (SELECT s, CASE WHEN p_size % 5 = 0 THEN 'other' ELSE n END AS n, p_partkey FROM lines WHERE kind = 0)
), c AS (SELECT count(*) AS correct FROM linked l JOIN gold g USING (s, n, k)),
t AS (SELECT count(*) AS gold, sum((p_size % 3 = 0)::INT) AS linked, sum((p_size % 3 = 1)::INT) AS needs_review, sum((p_size % 3 = 2)::INT) AS not_found FROM part)
SELECT CAST(linked AS BIGINT) AS linked, CAST(needs_review AS BIGINT) AS needs_review, CAST(not_found AS BIGINT) AS not_found, correct, gold,
  round(correct / linked, 6) AS precision, round(correct / gold, 6) AS recall,
  round(2 * (correct / linked) * (correct / gold) / (correct / linked + correct / gold), 6) AS f1
FROM c, t"""
)
def linking_evaluation(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    gold = part.select(F.col("p_brand").alias("sample_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    status = F.element_at(F.array(F.lit("linked"), F.lit("needs_review"), F.lit("not_found")), (F.col("p_size") % 3 + 1).cast("int"))
    name = F.when(F.col("p_size") % 5 == 0, "other").otherwise(F.col("p_name"))
    lines = part.select(F.col("p_brand").alias("sample_id"), F.col("p_partkey").alias("ord"), name.alias("name"), status.alias("status"))
    out = linking.linking_evaluation(gold, lines)
    return out.select("linked", "needs_review", "not_found", "correct", "gold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# Text: T01-T08, T15-T25


@query(
    """
SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[\\s_\\-./]+', '', 'g')) AS key,
  md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS ocr,
  md5(replace(strip_accents(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 'đ', 'd')) AS comparable,
  md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS eval
FROM documents"""
)
def normalize_texts(spark, sf_dir):
    text = F.col("text")
    forms = {"key": T.normalize_key(text), "ocr": T.normalize_ocr_text(text), "comparable": T.normalize_comparable_text(text), "eval": T.normalize_eval_text(text)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(c).alias(k) for k, c in forms.items()])


@query(
    f"""
WITH t AS (SELECT p_partkey, {views.NOISY_SQL} AS line, p_size, p_name FROM part)
SELECT p_partkey, line AS raw_text, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'm', 'rn') || ' ' || p_size || 'rng' ELSE replace(p_name, 'm', 'rn') END AS drug_name,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || 'mg' END AS strengths,
  {_NORM.format("regexp_replace(lower(line), '(?:rng|mng)' || chr(92) || 'b', 'mg', 'g')")} AS normalized
FROM t"""
)
def extract_strengths(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("line", views.noisy_line()).withColumn("d", T.split_drug_name("line"))
    return part.select("p_partkey", "d.raw_text", "d.drug_name", F.array_join("d.strengths", "|").alias("strengths"), T.normalize_drug_text("line").alias("normalized"))


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS value, CASE WHEN l_returnflag = 'A' THEN 'g' WHEN l_returnflag = 'R' THEN 'mcg' ELSE 'ml' END AS unit,
  round(CASE WHEN l_returnflag = 'A' THEN l_quantity * 1000 WHEN l_returnflag = 'R' THEN l_quantity * 0.001::DOUBLE END, 6) AS mg
FROM lineitem"""
)
def parse_strengths(spark, sf_dir):
    unit = F.when(F.col("l_returnflag") == "A", "g").when(F.col("l_returnflag") == "R", "mcg").otherwise("ml")
    text = F.concat(F.lit("x "), F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")), F.lit("  "), unit)
    rows = table(spark, sf_dir, "lineitem").withColumn("s", T.parse_strength(text))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.value", "s.unit", F.round("s.comparable_mg", 6).alias("mg"))


@query("SELECT doc_id, replace(array_to_string(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?'), '|'), ',', '.') AS numbers FROM documents")
def numeric_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numeric_signature("text"), "|").alias("numbers"))


@query(
    """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) % 9 AS k, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
f AS (SELECT *, CASE k WHEN 0 THEN 'AS_NEEDED' WHEN 1 THEN 'EVERY_OTHER_DAY' WHEN 2 THEN 'WEEKLY' WHEN 3 THEN
    CASE WHEN n % 10 = 3 THEN 'THREE_TIMES_DAILY' WHEN n % 10 = 2 THEN 'TWICE_DAILY' WHEN n % 10 = 1 THEN 'ONCE_DAILY' ELSE 'DAILY' END
    WHEN 4 THEN 'TWICE_DAILY' WHEN 5 THEN 'DAILY' WHEN 6 THEN 'WEEKLY' WHEN 7 THEN 'ONCE_DAILY' END AS frequency FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, frequency, frequency IS NOT NULL AS recognized,
  CAST(CASE frequency WHEN 'ONCE_DAILY' THEN 1 WHEN 'TWICE_DAILY' THEN 2 WHEN 'THREE_TIMES_DAILY' THEN 3 WHEN 'DAILY' THEN 1 END AS BIGINT) AS times
FROM f"""
)
def frequency_rules(spark, sf_dir):
    n = F.col("l_quantity").cast("long")
    said = ["Khi cần", "cách ngày", "mỗi tuần", None, "Sáng và tối", "hằng ngày, hang ngay", "WEEKLY", "một lần mỗi ngày", "không rõ"]
    text = F.concat(F.lit("Uống "), n.cast("string"), F.lit(" lần/ngày, mỗi ngày"))
    for k, s in enumerate(said):
        if s:
            text = F.when(n % 9 == k, F.lit(s)).otherwise(text)
    rows = table(spark, sf_dir, "lineitem").withColumn("f", T.normalize_frequency(text, F.lit(None)))
    times = T.default_times_per_day(F.col("f.frequency")).cast("long")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "f.frequency", "f.recognized", times.alias("times"))


@query("SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents WHERE text <> '' EXCEPT SELECT unnest(['', chr(9), chr(10), chr(13)])")
def char_dictionary(spark, sf_dir):
    return profile.char_dictionary(table(spark, sf_dir, "documents"))


# Splits and identifiers: W01, W02, M09, C07


@query(
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.70::DOUBLE + 0.5) THEN 'train' WHEN k <= floor(n * 0.70::DOUBLE + 0.5) + floor(n * 0.15::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split
FROM r"""
)
def split_rank(spark, sf_dir):
    return splits.rank_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query(
    """
WITH h AS (SELECT o_orderkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('rx-' || o_orderkey, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM orders)
SELECT o_orderkey, h AS hash, CASE WHEN h % 1000 < 700 THEN 'train' WHEN h % 1000 < 850 THEN 'validation' ELSE 'test' END AS split FROM h"""
)
def split_fnv(spark, sf_dir):
    name = F.concat(F.lit("rx-"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", splits.fnv1a(name).alias("hash"), splits.hash_split(name).alias("split"))


@query(
    """
WITH r AS (SELECT event_id, event_type || '-' || user_id AS id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY 'events', event_id) AS n FROM events)
SELECT event_id, CASE WHEN n > 1 THEN id || '_' || substr(sha1('events:' || event_id), 1, 12) ELSE id END AS sample_id FROM r"""
)
def suffixed_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("sample_id"), F.lit("events").alias("file"))
    return splits.suffixed_ids(rows, "sample_id", "file", "event_id").select("event_id", "sample_id")


# Boxes and matching: M01-M05, J06-J09, A12, A13, W08, K09


@query(f"WITH {views.BOXES_SQL} SELECT sample_id, CAST(g AS BIGINT) AS gold_idx, CAST(p AS BIGINT) AS pred_idx, round(iou, 6) AS iou FROM pairs")
def iou_pairs(spark, sf_dir):
    pairs = metrics.box_pairs(views.boxes(spark, sf_dir, False), views.boxes(spark, sf_dir, True), 0.5, ["sample_id"])
    return pairs.select("sample_id", "gold_idx", "pred_idx", F.round("iou", 6).alias("iou"))


def _greedy_sql(key: str, rounds: int = 8) -> str:
    """Takes pairs that are best for both sides, round by round."""
    out, left = [], f"p0 AS (SELECT *, {key} AS k FROM pairs" + (" WHERE label = p_label)" if key != "sample_id" else ")")
    out.append(left)
    for i in range(rounds):
        out.append(
            f"t{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY iou DESC, g, p) AS a, "
            f"row_number() OVER (PARTITION BY k, p ORDER BY iou DESC, g, p) AS b FROM p{i}) WHERE a = 1 AND b = 1)"
        )
        out.append(
            f"p{i + 1} AS (SELECT x.* FROM p{i} x WHERE NOT EXISTS (SELECT 1 FROM t{i} t WHERE t.k = x.k AND t.g = x.g) "
            f"AND NOT EXISTS (SELECT 1 FROM t{i} t WHERE t.k = x.k AND t.p = x.p))"
        )
    taken = " UNION ALL ".join(f"SELECT sample_id, label, k, g, p, gt, pt, iou FROM t{i}" for i in range(rounds))
    return ", ".join(out) + f", taken AS ({taken})"


@query(f"WITH {views.BOXES_SQL}, {_greedy_sql('sample_id')} SELECT sample_id, CAST(g AS BIGINT) AS gold_idx, CAST(p AS BIGINT) AS pred_idx, round(iou, 6) AS iou FROM taken")
def greedy_match(spark, sf_dir):
    pairs = metrics.box_pairs(views.boxes(spark, sf_dir, False), views.boxes(spark, sf_dir, True), 0.5, ["sample_id"])
    return metrics.greedy_match(pairs, ["sample_id"]).select("sample_id", "gold_idx", "pred_idx", F.round("iou", 6).alias("iou"))


_EVAL = """, m AS (
  SELECT {k}, count(*) AS matched_count, avg(CASE WHEN lower(gt) = lower(pt) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc,
    avg(levenshtein(lower(gt), lower(pt))::DOUBLE / length(gt)) AS cer, avg(levenshtein(lower(gt), lower(pt))::DOUBLE / 2) AS wer
  FROM taken GROUP BY {k}
), g AS (SELECT {k}, count(*) AS n FROM gold GROUP BY {k}), q AS (SELECT {k}, count(*) AS n FROM predicted GROUP BY {k}),
s AS (SELECT {g}, g.n AS gold_count, coalesce(q.n, 0) AS predicted_count, coalesce(m.matched_count, 0) AS matched_count,
  coalesce(acc, 0) AS acc, coalesce(cer, 0) AS cer, coalesce(wer, 0) AS wer
  FROM g LEFT JOIN q USING ({k}) LEFT JOIN m USING ({k})),
r AS (SELECT *, CASE WHEN predicted_count = 0 THEN 0.0::DOUBLE ELSE matched_count / predicted_count END AS precision, matched_count / gold_count AS recall FROM s)
SELECT {k}, gold_count, predicted_count, matched_count, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1,
  round(acc, 6) AS text_exact_accuracy, round(cer, 6) AS mean_cer, round(wer, 6) AS mean_wer FROM r"""
_SCORES = ("precision", "recall", "f1", "text_exact_accuracy", "mean_cer", "mean_wer")


@query(f"WITH {views.BOXES_SQL}, {_greedy_sql('sample_id')}" + _EVAL.format(k="sample_id", g="g.sample_id"))
def ocr_eval(spark, sf_dir):
    rows = metrics.evaluate_ocr_words(views.boxes(spark, sf_dir, False), views.boxes(spark, sf_dir, True))
    return rows.select("sample_id", "gold_count", "predicted_count", "matched_count", *[F.round(c, 6).alias(c) for c in _SCORES])


_BY_LABEL = _greedy_sql("sample_id || label")


@query(f"WITH {views.BOXES_SQL}, {_BY_LABEL}" + _EVAL.format(k="sample_id, label", g="g.sample_id, g.label"))
def entity_eval(spark, sf_dir):
    rows = metrics.evaluate_entities(views.boxes(spark, sf_dir, False), views.boxes(spark, sf_dir, True)).where("label IS NOT NULL")
    return rows.select("sample_id", "label", "gold_count", "predicted_count", "matched_count", *[F.round(c, 6).alias(c) for c in _SCORES])


@query(
    f"WITH {views.BOXES_SQL}, {_greedy_sql('sample_id')}"
    + """, t AS (SELECT (SELECT count(*) FROM gold) AS gold_count, (SELECT count(*) FROM predicted) AS predicted_count, (SELECT count(*) FROM taken) AS matched_count)
SELECT *, round(matched_count / predicted_count, 6) AS precision, round(matched_count / gold_count, 6) AS recall,
  round(2.0::DOUBLE * matched_count / (predicted_count + gold_count), 6) AS f1 FROM t"""
)
def ocr_micro(spark, sf_dir):
    rows = metrics.evaluate_ocr_words(views.boxes(spark, sf_dir, False), views.boxes(spark, sf_dir, True))
    return metrics.micro_scores(rows).select("gold_count", "predicted_count", "matched_count", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"WITH {views.BOXES_SQL}, {_greedy_sql('sample_id')}" + _EVAL.format(k="sample_id", g="g.sample_id").rpartition("SELECT sample_id, gold_count")[0]
    + """SELECT count(*) AS samples, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
  round(avg(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END), 6) AS f1,
  round(avg(acc), 6) AS text_exact_accuracy, round(avg(cer), 6) AS mean_cer, round(avg(wer), 6) AS mean_wer FROM r"""
)
def ocr_macro(spark, sf_dir):
    rows = metrics.evaluate_ocr_words(views.boxes(spark, sf_dir, False), views.boxes(spark, sf_dir, True))
    return metrics.macro_scores(rows).select("samples", *[F.round(c, 6).alias(c) for c in _SCORES])


# Evaluation joins: J01-J03, A02, A16, A20, O08, P01


_SIDES = (
    f"WITH {views.BOXES_SQL}, {_greedy_sql('sample_id')}"
    + _EVAL.format(k="sample_id", g="g.sample_id").rpartition("SELECT sample_id, gold_count")[0].rstrip()
    + """, o AS (SELECT sample_id, gold_count, predicted_count, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r WHERE sample_id % 7 <> 0),
k AS (SELECT sample_id, count(*) FILTER (idx % 4 > 0) AS gold_drugs, count(*) FILTER (idx % 4 = 1) AS correct FROM gold WHERE sample_id % 5 <> 0 GROUP BY sample_id),
x AS (SELECT g.sample_id, count(*) AS every, count(t.g) AS matched, count(CASE WHEN t.gt = replace(t.pt, 'x', '') THEN 1 END) AS exact
  FROM gold g LEFT JOIN taken t ON t.sample_id = g.sample_id AND t.g = g.idx GROUP BY g.sample_id),
c AS (SELECT sample_id, count(*) AS n FROM predicted GROUP BY sample_id),
b AS (SELECT sample_id, count(*) AS n FROM gold WHERE sample_id % 7 <> 3 GROUP BY sample_id),
a AS (SELECT o_orderkey AS sample_id, coalesce(o.gold_count, b.n, 0) AS gold_word_boxes, coalesce(o.predicted_count, c.n, 0) AS predicted_word_boxes, o.f1 AS ocr_f1,
  coalesce(k.gold_drugs, o_orderkey % 4) AS link_gold_drugs, coalesce(k.correct, 0) AS correct_links, CASE WHEN k.gold_drugs > 0 THEN round(k.correct / k.gold_drugs, 6) END AS link_recall,
  coalesce(every, 0) AS every, coalesce(matched, 0) AS matched, coalesce(exact, 0) AS exact
  FROM orders LEFT JOIN o ON o.sample_id = o_orderkey LEFT JOIN k ON k.sample_id = o_orderkey LEFT JOIN x ON x.sample_id = o_orderkey LEFT JOIN c ON c.sample_id = o_orderkey
  LEFT JOIN b ON b.sample_id = o_orderkey)
"""
)


def _error_samples(spark, sf_dir):
    """Orders as the manifest, with scores of the boxes of most of them, and links of
    most of those; what one side lacks another may have."""
    gold, predicted = (views.boxes(spark, sf_dir, x) for x in (False, True))
    s, n = F.col("sample_id"), F.col("idx")
    boxes = gold.where(s % 7 != 3).groupBy("sample_id").agg(F.count("*").alias("word_box_count"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 4).alias("drug_count"))
    ocr = metrics.evaluate_ocr_words(gold, predicted).where(s % 7 != 0).select("sample_id", "gold_count", "predicted_count", "f1")
    links = gold.where(s % 5 != 0).groupBy("sample_id").agg(F.count_if(n % 4 > 0).alias("gold_drug_count"), F.count_if(n % 4 == 1).alias("correct_links"))
    return evaluation.error_analysis(orders.join(boxes, "sample_id", "left"), gold, predicted, ocr, links)


@query(
    _SIDES
    + """SELECT sample_id, gold_word_boxes, predicted_word_boxes, ocr_f1, link_gold_drugs, correct_links, link_recall, every AS numeric_gold_boxes,
  matched AS numeric_matched_boxes, exact AS numeric_exact_matches, matched - exact AS numeric_disagreements, every - matched AS numeric_unmatched_gold_boxes FROM a"""
)
def error_samples(spark, sf_dir):
    return _error_samples(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("ocr_f1", "link_recall")})


@query(
    _SIDES
    + """SELECT count(*) AS samples, count(CASE WHEN predicted_word_boxes > gold_word_boxes THEN 1 END) AS over_detection_samples,
  count(CASE WHEN predicted_word_boxes < gold_word_boxes THEN 1 END) AS under_detection_samples,
  CAST(sum(every) AS BIGINT) AS numeric_gold_boxes, CAST(sum(matched) AS BIGINT) AS numeric_matched_boxes,
  CAST(sum(exact) AS BIGINT) AS numeric_exact_matches, CAST(sum(matched - exact) AS BIGINT) AS numeric_disagreements,
  CAST(sum(every - matched) AS BIGINT) AS numeric_unmatched_gold_boxes, round(sum(exact) / sum(matched), 6) AS numeric_exact_rate FROM a"""
)
def error_totals(spark, sf_dir):
    rows = evaluation.error_totals(_error_samples(spark, sf_dir))
    return rows.withColumn("numeric_exact_rate", F.round("numeric_exact_rate", 6))


@query(
    """
WITH last AS (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS prediction FROM orders GROUP BY o_custkey)
SELECT c_custkey AS sample_id, prediction FROM customer LEFT JOIN last ON o_custkey = c_custkey"""
)
def manifest_predictions(spark, sf_dir):
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("prediction"), F.col("o_orderkey").alias("ord"))
    return evaluation.manifest_predictions(manifest, said, "ord")


@query(
    """
SELECT p.p_partkey, p.p_name AS reference, coalesce(CASE WHEN p.p_partkey % 4 <> 0 THEN p.p_type END, '') AS hypothesis FROM part p"""
)
def reference_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    said = part.where("p_partkey % 4 <> 0").select("p_partkey", F.col("p_type").alias("hypothesis"))
    return evaluation.reference_pairs(part.select("p_partkey", F.col("p_name").alias("reference")), said, ["p_partkey"])


@query(
    """
WITH s AS (SELECT l_returnflag AS split, CAST(l_quantity AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS t, CAST(l_quantity AS BIGINT) // 2 AS v FROM lineitem)
SELECT split, count(*) AS samples, CAST(sum(w) AS BIGINT) AS word_box_count, CAST(sum(t) AS BIGINT) AS target_box_count,
  CAST(sum(v) AS BIGINT) AS valid_box_count, CAST(sum(w) - sum(v) AS BIGINT) AS invalid_box_count FROM s GROUP BY ROLLUP (split)"""
)
def split_summary(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("split"), q.alias("word_box_count"), F.col("l_linenumber").cast("long").alias("target_box_count"),
        F.floor(q / 2).alias("valid_box_count"),
    )
    return evaluation.split_summary(rows)


@query(
    """
WITH e AS (SELECT l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1
  UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1)
SELECT key, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY key"""
)
def merged_counts(spark, sf_dir):
    count = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return evaluation.merged_counts(count("lineitem", "l_returnflag"), count("lineitem", "l_linestatus"), count("orders", "o_orderstatus"))


@query(
    f"""WITH {views.BOXES_SQL} SELECT sample_id, CAST(idx AS BIGINT) AS idx, CASE label WHEN 'A' THEN 'DRUG' ELSE 'INSTRUCTION' END AS label, text, x1
FROM gold WHERE label <> 'N'"""
)
def word_entities(spark, sf_dir):
    words = views.boxes(spark, sf_dir, False)
    raw = F.when(F.col("label") == "A", "drugname").when(F.col("label") == "R", "usage").otherwise("other")
    rows = evaluation.word_entities(words.withColumn("label", raw))
    return rows.select("sample_id", "idx", "label", "text", F.col("bbox")[0].alias("x1"))


@query(
    """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS total_samples, count(CASE WHEN s THEN 1 END) AS saved, count(CASE WHEN s AND o_orderkey % 3 = 0 THEN 1 END) AS complete,
  count(CASE WHEN s AND o_orderkey % 3 = 1 THEN 1 END) AS needs_review, CAST(coalesce(sum(CASE WHEN s THEN n.n - 1 END), 0) AS BIGINT) AS relations
FROM (SELECT *, o_orderkey % 5 <> 0 AS s FROM orders) o JOIN n ON n.l_orderkey = o.o_orderkey"""
)
def annotator_stats(spark, sf_dir):
    docs = views.records(spark, sf_dir)
    key = F.col("sample_id").cast("long")
    status = F.when(key % 3 == 0, "complete").when(key % 3 == 1, "needs_review").otherwise("open")
    drafts = docs.where(key % 5 != 0).select("sample_id", status.alias("annotation_status"), "relations")
    return evaluation.annotator_stats(docs, drafts)


@query(
    _DECIDE.rpartition("SELECT query_id, status")[0]
    + """, m AS (SELECT query_id, query_id // 10 AS prescription_id, status, id, row_number() OVER (PARTITION BY query_id // 10 ORDER BY query_id) AS number
  FROM d WHERE status <> 'not_found')
SELECT m.query_id AS ord, prescription_id || '-med-' || number AS medication_id, CASE WHEN status = 'linked' THEN CAST(id AS VARCHAR) END AS drug_database_id,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size || 'mg' END AS strength,
  CASE WHEN p_partkey % 3 <> 0 AND status = 'linked' THEN 'drug' ELSE 'drug|strength' END AS fields
FROM m JOIN part ON p_partkey = m.query_id"""
)
def medication_lines(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(F.floor(F.col("p_partkey") / 10).alias("prescription_id"), F.col("p_partkey").alias("ord"), views.noisy_line().alias("text"))
    rows = medication.medication_lines(lines, views.catalog(spark, sf_dir), True, linking.BATCH_THRESHOLD, linking.BATCH_MARGIN)
    return rows.select("ord", "medication_id", "drug_database_id", "strength", F.array_join("fields_to_verify", "|").alias("fields"))


def _entities(spark, sf_dir):
    rows = views.boxes(spark, sf_dir, True)
    label = F.when(F.col("label") == "N", "DRUG").when(F.col("label") == "A", "STRENGTH").otherwise("DOSE")
    return rows.select("sample_id", F.col("idx").alias("ord"), F.concat(F.lit("e"), F.col("idx")).alias("id"), label.alias("label"), "bbox")


def _away(entities):
    """Every fifth entity stands where no word is."""
    away = F.when(F.col("ord") % 5 == 0, F.transform("bbox", lambda x: x + 10_000)).otherwise(F.col("bbox"))
    return entities.withColumn("bbox", away)


_BIO = f"""WITH {views.BOXES_SQL}, w AS (
  SELECT sample_id, g, p, p_label, greatest(i / (600.0::DOUBLE - i), i / 300.0::DOUBLE) AS s FROM meets WHERE greatest(i / (600.0::DOUBLE - i), i / 300.0::DOUBLE) >= 0.5
), b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, g ORDER BY s DESC, p) AS n FROM w),
t AS (SELECT gold.sample_id, gold.idx, 'e' || b.p AS entity_id, CASE b.p_label WHEN 'N' THEN 'DRUG' WHEN 'A' THEN 'STRENGTH' WHEN 'R' THEN 'DOSE' END AS label
  FROM gold LEFT JOIN b ON b.sample_id = gold.sample_id AND b.g = gold.idx AND b.n = 1)
"""


@query(
    _BIO
    + """SELECT sample_id, CAST(idx AS BIGINT) AS idx, entity_id, CASE WHEN entity_id IS NULL THEN 'O'
  WHEN lag(entity_id) OVER (PARTITION BY sample_id ORDER BY idx) = entity_id THEN 'I-' || label ELSE 'B-' || label END AS tag FROM t"""
)
def bio_tags(spark, sf_dir):
    words = views.boxes(spark, sf_dir, False).drop("label").withColumn("pos", F.col("idx"))
    return ner.bio_tags(words, _entities(spark, sf_dir)).select("sample_id", "idx", "entity_id", "tag")


@query(_BIO.replace("FROM meets WHERE", "FROM meets WHERE p % 5 <> 0 AND") + "SELECT p.sample_id, 'e' || p.idx AS entity_id FROM predicted p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.sample_id = p.sample_id AND t.entity_id = 'e' || p.idx)")
def unmatched_entities(spark, sf_dir):
    words = views.boxes(spark, sf_dir, False).drop("label").withColumn("pos", F.col("idx"))
    entities = _away(_entities(spark, sf_dir))
    return ner.unmatched_entities(ner.bio_tags(words, entities), entities)


@query(
    _BIO.replace("FROM meets WHERE", "FROM meets WHERE p % 5 <> 0 AND")
    + """, u AS (SELECT p.sample_id, string_agg('e' || p.idx, '|' ORDER BY 'e' || p.idx) AS unmatched FROM predicted p
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.sample_id = p.sample_id AND t.entity_id = 'e' || p.idx) GROUP BY p.sample_id),
k AS (SELECT sample_id, count(*) AS tokens FROM gold GROUP BY sample_id)
SELECT k.sample_id, tokens, coalesce(unmatched, '') AS unmatched, unmatched IS NULL AS ready_for_training FROM k LEFT JOIN u USING (sample_id)"""
)
def bio_examples(spark, sf_dir):
    words = views.boxes(spark, sf_dir, False).drop("label").withColumn("pos", F.col("idx"))
    rows = ner.bio_examples(words, _away(_entities(spark, sf_dir)))
    return rows.select("sample_id", F.size("tokens").cast("long").alias("tokens"), F.array_join("unmatched_entity_ids", "|").alias("unmatched"), "ready_for_training")


@query(
    f"""WITH {views.BOXES_SQL} SELECT sample_id, CAST(idx AS BIGINT) AS idx, CAST(greatest(0, x1 - 4) AS BIGINT) AS x1, CAST(greatest(0, y1 - 4) AS BIGINT) AS y1,
  CAST(least(120, x2 + 4) AS BIGINT) AS x2, CAST(least(40, y2 + 4) AS BIGINT) AS y2 FROM predicted WHERE least(120, x2 + 4) > greatest(0, x1 - 4)"""
)
def crop_boxes(spark, sf_dir):
    rows = views.boxes(spark, sf_dir, True).withColumn("c", G.crop(F.col("bbox"), 4, F.lit(120), F.lit(40))).where("c IS NOT NULL")
    return rows.select("sample_id", "idx", *[F.col("c")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


# Layout: W03-W07, A25, A26


def _layout(how):
    def run(spark, sf_dir):
        words = views.boxes(spark, sf_dir, True).withColumn("confidence", (F.col("idx") % 10) / 10.0).withColumn("sample_id", F.col("sample_id").cast("string"))
        rows = layout.group_lines(words, how)
        return rows.select("sample_id", "line_no", "text", F.array_join(F.transform("bbox", lambda v: v.cast("string")), ",").alias("bbox"), F.round("confidence", 6).alias("confidence"))

    run.__name__ = f"lines_{how}"
    return run


# words of a page stand in three rows, far enough apart for either rule
_ROWS = f"""WITH {views.BOXES_SQL}, w AS (
  SELECT *, idx % 3 AS line, row_number() OVER (PARTITION BY sample_id ORDER BY (y1 + y2) / 2, x1, idx) AS n FROM predicted
), l AS (
  SELECT sample_id, min(n) AS first, string_agg(text, ' ' ORDER BY x1, n) AS text, min(x1) || ',' || min(y1) || ',' || max(x2) || ',' || max(y2) AS bbox,
    round(avg((idx % 10) / 10), 6) AS confidence FROM w GROUP BY sample_id, line
)
SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY first) - 1 AS BIGINT) AS line_no, text, bbox, confidence FROM l"""
query(_ROWS)(_layout("first_fit"))
query(_ROWS)(_layout("best_overlap"))
query(
    f"""WITH RECURSIVE {views.BOXES_SQL}, w AS (
  SELECT sample_id, idx, text, x1, y1, x2, y2, (y1 + y2) / 2 AS c, row_number() OVER (PARTITION BY sample_id ORDER BY (y1 + y2) / 2, x1, idx) AS n FROM predicted
), f AS (
  SELECT sample_id, n, idx, 0 AS line, c AS total, 1 AS k FROM w WHERE n = 1
  UNION ALL
  SELECT w.sample_id, w.n, w.idx, CASE WHEN abs(w.c - f.total / f.k) > 10 THEN f.line + 1 ELSE f.line END,
    CASE WHEN abs(w.c - f.total / f.k) > 10 THEN w.c ELSE f.total + w.c END, CASE WHEN abs(w.c - f.total / f.k) > 10 THEN 1 ELSE f.k + 1 END
  FROM f JOIN w ON w.sample_id = f.sample_id AND w.n = f.n + 1
)
SELECT CAST(f.sample_id AS VARCHAR) AS sample_id, CAST(f.line AS BIGINT) AS line_no, string_agg(w.text, ' ' ORDER BY w.x1, w.n) AS text,
  min(w.x1) || ',' || min(w.y1) || ',' || max(w.x2) || ',' || max(w.y2) AS bbox, round(avg((f.idx % 10) / 10), 6) AS confidence
FROM f JOIN w ON w.sample_id = f.sample_id AND w.n = f.n GROUP BY f.sample_id, f.line"""
)(_layout("last_line"))


# parts as pages, whose words stand anywhere: centres drift, and lines tie and cross
_PAGES = """WITH RECURSIVE w AS (
  SELECT l_partkey AS page, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS idx,
    l_suppkey * 7 % 300::DOUBLE AS x1, l_orderkey * 11 % 97::DOUBLE AS y1, l_orderkey * 11 % 97 + 6 + l_quantity % 9 AS y2 FROM lineitem
), o AS (SELECT *, (y1 + y2) / 2 AS c, greatest(1, y2 - y1) AS h, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, x1, idx) AS n FROM w),
"""


def _free_lines(how):
    def run(spark, sf_dir):
        order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
        rows = table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(order).cast("long"))
        x, y = (F.col("l_suppkey") * 7 % 300).cast("double"), (F.col("l_orderkey") * 11 % 97).cast("double")
        words = rows.select(
            F.col("l_partkey").cast("string").alias("sample_id"), "idx", F.concat(F.lit("w"), F.col("idx").cast("string")).alias("text"),
            F.array(x, y, x + 20, y + 6 + F.col("l_quantity") % 9).alias("bbox"), F.lit(None).cast("double").alias("confidence"),
        )
        return layout.group_lines(words, how).select("sample_id", "line_no", "text")

    run.__name__ = f"free_lines_{how}"
    return run


query(
    _PAGES
    + """f AS (
  SELECT page, n, 1::BIGINT AS line, [{'s': c, 'n': 1, 'h': h}] AS lines FROM o WHERE n = 1
  UNION ALL
  SELECT page, n, pos, CASE WHEN pos > len(lines) THEN list_append(lines, {'s': c, 'n': 1, 'h': h})
    ELSE list_transform(lines, lambda l, i: CASE WHEN i = pos THEN {'s': l.s + c, 'n': l.n + 1, 'h': greatest(l.h, h)} ELSE l END) END
  FROM (SELECT o.*, f.lines, coalesce(nullif(list_position(list_transform(f.lines, lambda l: abs(o.c - l.s / l.n) <= greatest(o.h, l.h) * 0.55::DOUBLE), true), 0), len(f.lines) + 1) AS pos
    FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1)
) SELECT CAST(page AS VARCHAR) AS sample_id, f.line - 1 AS line_no, string_agg('w' || o.idx, ' ' ORDER BY o.x1, o.n) AS text FROM f JOIN o USING (page, n) GROUP BY ALL"""
)(_free_lines("first_fit"))
query(
    _PAGES
    + """f AS (
  SELECT page, n, 1::BIGINT AS line, [{'a': y1, 'b': y2}] AS lines FROM o WHERE n = 1
  UNION ALL
  SELECT page, n, pos, CASE WHEN pos > len(lines) THEN list_append(lines, {'a': y1, 'b': y2})
    ELSE list_transform(lines, lambda l, i: CASE WHEN i = pos THEN {'a': least(l.a, y1), 'b': greatest(l.b, y2)} ELSE l END) END
  FROM (SELECT *, CASE WHEN list_max(scores) > -1 THEN list_position(scores, list_max(scores)) ELSE len(lines) + 1 END AS pos FROM (
    SELECT *, list_transform(parts, lambda p: CASE WHEN p.away <= p.near OR (p.shared >= 0.55::DOUBLE AND p.away <= greatest(p.near, p.tall * 0.45::DOUBLE))
      THEN p.shared - p.away / p.tall * 0.1::DOUBLE ELSE -1.0::DOUBLE END) AS scores FROM (
      SELECT o.*, f.lines, list_transform(f.lines, lambda l: {'tall': greatest(1, l.b - l.a), 'away': abs(o.c - (l.a + l.b) / 2),
        'shared': greatest(0, least(o.y2, l.b) - greatest(o.y1, l.a)) / greatest(1, least(o.h, greatest(1, l.b - l.a))),
        'near': least(28, greatest(8, least(o.h, greatest(1, l.b - l.a)) * 0.55::DOUBLE))}) AS parts
      FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1)))
), l AS (SELECT page, line, string_agg('w' || o.idx, ' ' ORDER BY o.x1, o.n) AS text, min(y1) AS y, min(x1) AS x FROM f JOIN o USING (page, n) GROUP BY ALL)
SELECT CAST(page AS VARCHAR) AS sample_id, row_number() OVER (PARTITION BY page ORDER BY y, x, line) - 1 AS line_no, text FROM l"""
)(_free_lines("best_overlap"))


@query(
    f"""WITH {views.BOXES_SQL} SELECT sample_id, CAST(idx AS BIGINT) AS idx,
  CAST(row_number() OVER (PARTITION BY sample_id ORDER BY idx % 3, x1, (y1 + y2) / 2, idx) - 1 AS BIGINT) AS pos FROM predicted"""
)
def sort_spatial(spark, sf_dir):
    return layout.sort_spatial(views.boxes(spark, sf_dir, True).select("sample_id", "idx", "bbox")).select("sample_id", "idx", "pos")


@query(
    f"""WITH {views.BOXES_SQL} SELECT sample_id, string_agg(text, chr(10) ORDER BY y1, x1, text) AS text FROM predicted GROUP BY sample_id"""
)
def reading_order(spark, sf_dir):
    words = views.boxes(spark, sf_dir, True).groupBy("sample_id").agg(F.collect_list(F.struct("bbox", "text")).alias("w"))
    return words.select("sample_id", layout.reading_order_text(F.col("w")).alias("text"))


# Scores of texts and relations: T10-T14, A10, A11, A14, A17, A18, O02

_ASCII = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
_TURNS = f"""WITH c AS (SELECT conv_id, turn, {_ASCII.format("text")} AS a, {_ASCII.format("coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS b FROM conversations)"""


def _turns(spark, sf_dir):
    after = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_ocr_text("text").alias("a"), T.normalize_ocr_text(after).alias("b"))


@query(_TURNS + " SELECT conv_id, turn, round(CASE WHEN a = '' THEN CASE WHEN b = '' THEN 0 ELSE 1 END ELSE levenshtein(a, b)::DOUBLE / length(a) END, 6) AS cer FROM c")
def cer_by_turn(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(T.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query(_TURNS + " SELECT count(*) AS samples, round(sum(levenshtein(a, b))::DOUBLE / greatest(sum(length(a)), 1), 6) AS cer, round(avg((a = b)::INT), 6) AS exact FROM c")
def cer_micro(spark, sf_dir):
    pairs = _turns(spark, sf_dir).select(F.col("a").alias("reference"), F.col("b").alias("hypothesis"))
    rates = metrics.corpus_error_rates(pairs)
    return rates.select("samples", F.round("cer", 6).alias("cer"), F.round("exact", 6).alias("exact"))


# words as letters: one for each that both texts of a pair have, and one a side for all
# others, so that edits of letters are those of words
_WORDS = (
    _TURNS
    + """, s AS (SELECT list_filter(string_split(a, ' '), lambda x: x <> '') AS a, list_filter(string_split(b, ' '), lambda x: x <> '') AS b FROM c),
d AS (SELECT a, b, list_sort(list_distinct(list_intersect(a, b))) AS shared FROM s),
e AS (SELECT len(a) AS n, array_to_string(list_transform(a, lambda x: chr(2 + coalesce(nullif(list_position(shared, x), 0), -1)::INT)), '') AS a,
  array_to_string(list_transform(b, lambda x: chr(2 + coalesce(list_position(shared, x), 0)::INT)), '') AS b FROM d)
"""
)


@query(_WORDS + "SELECT count(*) AS samples, sum(levenshtein(a, b)) / sum(n) AS wer, sum(levenshtein(a, b)) / sum(n) AS wer_plain FROM e")
def wer_micro(spark, sf_dir):
    pairs = _turns(spark, sf_dir).select(F.col("a").alias("reference"), F.col("b").alias("hypothesis"))
    return metrics.corpus_error_rates(pairs).select("samples", "wer", "wer_plain")


@query(
    _TURNS
    + """, e AS (SELECT conv_id * 1000 + turn AS ord, round(CASE WHEN a = '' THEN CASE WHEN b = '' THEN 0 ELSE 1 END ELSE levenshtein(a, b)::DOUBLE / length(a) END, 6) AS cer FROM c)
SELECT ord, cer FROM e ORDER BY cer DESC, ord LIMIT 20"""
)
def worst_turns(spark, sf_dir):
    rows = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.round(T.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))
    return metrics.worst(rows, "cer", "ord")


@query(
    """SELECT CASE WHEN coalesce(value, 0) < 5 THEN 'lt_5' WHEN coalesce(value, 0) < 20 THEN '5_to_20' WHEN coalesce(value, 0) < 50 THEN '20_to_50' ELSE 'gte_50' END AS bucket,
  count(*) AS n FROM events GROUP BY 1"""
)
def bucket_hist(spark, sf_dir):
    bucket = metrics.histogram(F.col("value"), [5, 20, 50], F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT DISTINCT l_orderkey AS s, l_returnflag AS t, l_linenumber AS x FROM lineitem WHERE l_discount > 0.01),
p AS (SELECT DISTINCT l_orderkey AS s, l_returnflag AS t, l_linenumber AS x FROM lineitem WHERE l_tax < 0.07),
b AS (SELECT coalesce(g.t, p.t) AS type, g.s IS NOT NULL AS g, p.s IS NOT NULL AS p FROM g FULL JOIN p ON g.s = p.s AND g.t = p.t AND g.x = p.x),
c AS (SELECT type, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM b GROUP BY GROUPING SETS ((type), ()))
SELECT type, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def relation_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    cols = [F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("type"), F.lit("d").alias("source_entity_id"), F.col("l_linenumber").alias("target_entity_id")]
    out = metrics.evaluate_relations(rows.where("l_discount > 0.01").select(*cols), rows.where("l_tax < 0.07").select(*cols))
    return out.select("type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH e AS (SELECT event_type AS field, (event_id % 100) / 100.0::DOUBLE AS c, CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM events),
b AS (SELECT field, least(floor(c * 10), 9) AS b, count(*) AS n, sum(c) AS c, sum(y) AS y, sum((c - y) * (c - y)) AS q,
  sum(-ln(CASE WHEN y = 1 THEN greatest(c, 1e-12) ELSE 1 - least(c, 1 - 1e-12) END)) AS l FROM e GROUP BY ALL)
SELECT field, CAST(sum(n) AS BIGINT) AS samples, round(sum(abs(c - y)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier,
  round(sum(l) / sum(n), 6) AS nll FROM b GROUP BY field"""
)
def calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), (F.col("user_id") % 2 == 0).alias("correct"))
    return metrics.calibration(rows, ["field"]).select("field", "samples", *[F.round(c, 6).alias(c) for c in ("ece", "brier", "nll")])


@query(
    """WITH a AS (SELECT (event_id % 100) / 100.0::DOUBLE AS confidence, count(*) AS n, sum((user_id % 2 <> 0)::INT) AS w FROM events GROUP BY 1)
SELECT confidence, round(sum(n) OVER (ORDER BY confidence DESC) / sum(n) OVER (), 6) AS coverage,
  round(sum(w) OVER (ORDER BY confidence DESC) / sum(n) OVER (ORDER BY confidence DESC), 6) AS risk FROM a"""
)
def risk_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(((F.col("event_id") % 100) / 100.0).alias("confidence"), (F.col("user_id") % 2 == 0).alias("correct"))
    return metrics.risk_coverage(rows).select("confidence", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(
    """SELECT event_type, count(*) AS requests, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
  round(avg((event_type = 'error')::INT), 6) AS error_rate FROM events GROUP BY event_type"""
)
def latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("latency_ms", F.col("value")).withColumn("error", F.when(F.col("event_type") == "error", "e"))
    out = metrics.latency(rows, ["event_type"])
    return out.select("event_type", "requests", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "error_rate")])


# Joins and windows by order: J11, W09, A01, A03


@query(
    """WITH t AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'), r AS (
  SELECT e.event_id, t.event_id AS target, row_number() OVER (PARTITION BY e.event_id ORDER BY coalesce(abs(e.value - t.value), 0), t.event_id) AS n
  FROM events e LEFT JOIN t ON t.user_id = e.user_id WHERE e.event_type <> 'purchase')
SELECT event_id, target FROM r WHERE n = 1"""
)
def nearest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("idx"), F.col("value").alias("y"), "event_type")
    found = extract.nearest(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"))
    return found.select(F.col("idx").alias("event_id"), F.col("target_idx").alias("target"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations")
def carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    out = extract.carry_forward(rows, F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], ["turn"])
    return out.select("conv_id", "turn", "carried")


@query("SELECT coalesce(l_returnflag, 'unknown') AS label, count(*) AS n FROM lineitem GROUP BY 1")
def count_labels(spark, sf_dir):
    return profile.count_labels(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT path, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS path FROM events) GROUP BY path")
def inspect_json(spark, sf_dir):
    documents = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file"), F.try_parse_json("props").alias("document"))
    return inspection.json_nodes(documents).where("key IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"))


# Profiles: S02, A03, P06, P07, P12


@query(
    """SELECT kind, extension, count(*) AS files FROM part JOIN (VALUES (0, 'image', '.jpg'), (1, 'annotation_candidate', '.json'), (2, 'archive', '.tar'),
  (3, 'annotation_candidate', '.csv'), (4, 'other', ''), (5, 'other', '.md')) AS e(k, kind, extension) ON p_partkey % 6 = k GROUP BY ALL"""
)
def inspect_files(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".JPG", ".json", ".tar", ".csv", "", ".Md")])
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_partkey", F.element_at(ends, (F.col("p_partkey") % 6 + 1).cast("int")))
    return profile.inspect(table(spark, sf_dir, "part").select(path.alias("path")))


@query(
    """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'DRUG' WHEN 1 THEN 'STRENGTH' WHEN 2 THEN 'ACTIVE_INGREDIENT' WHEN 5 THEN 'INSTRUCTION' WHEN 6 THEN 'FREQUENCY' END AS label,
  CASE p_size % 7 WHEN 0 THEN 'DRUG' WHEN 1 THEN 'STRENGTH' WHEN 5 THEN 'INSTRUCTION' END AS field FROM part"""
)
def label_names(spark, sf_dir):
    said = F.array(*[F.lit(x) for x in ("DrugName", " strength ", "Active ingredient", "", "zzz", "USAGE", "số-lần")])
    said = F.element_at(said, (F.col("p_size") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", profile.normalize_label(said).alias("label"), profile.field_label(said).alias("field"))


@query(
    """SELECT p_partkey, regexp_replace(regexp_replace('  ' || p_name || ' #' || p_partkey || '.scan', '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS sample_id,
  'a/image/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/label/x.png' ELSE '.txt' END AS image FROM part"""
)
def clean_names(spark, sf_dir):
    name = F.concat(F.lit("  "), "p_name", F.lit(" #"), "p_partkey", F.lit(".scan.png"))
    path = F.concat(F.lit("a/label/"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "/label/x.json").otherwise(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", profile.clean_sample_id(name).alias("sample_id"), profile.image_ref(path).alias("image"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'Patient Name|visit.Phone-No|visit.note[1].e_mail' ELSE '' END AS paths FROM orders"""
)
def sensitive_paths(spark, sf_dir):
    long_ = '{"Patient Name": "x", "visit": {"Phone-No": 1, "note": [{"value": 3}, {"e_mail": 2}]}, "total": '
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(long_), "o_custkey", F.lit("}"))).otherwise('{"total": 1}')
    text = F.when(F.col("o_orderkey") % 5 == 0, "no json").otherwise(text)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("file"), F.try_parse_json(text).alias("document"))
    found = inspection.sensitive_members(inspection.json_nodes(orders)).groupBy("file").agg(F.array_sort(F.collect_set("path")).alias("found"))
    return orders.join(found, "file", "left").select("o_orderkey", F.coalesce(F.array_join("found", "|"), F.lit("")).alias("paths"))


# Documents: V01, V05, A07, A08, V10, T27, P14, P15


def _dupes(field: str) -> str:
    return f"count(*) - count(DISTINCT {field})"


_RECORDS = """WITH lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS idx FROM lineitem
), e AS (
  SELECT l_orderkey AS o, idx, l_linenumber AS id, CASE WHEN idx = 1 THEN CASE WHEN l_returnflag = 'N' THEN 'DRUG' ELSE 'FORM' END
    WHEN l_returnflag = 'A' THEN 'STRENGTH' WHEN l_returnflag = 'R' THEN 'DOSE' ELSE 'TIMING' END AS label,
    (l_discount = 0)::INT AS no_text, (l_tax = 0)::INT AS no_box FROM lines
), l AS (SELECT o, id, max_by(label, idx) AS label FROM e GROUP BY o, id),
r AS (
  SELECT e.o, (s.label <> 'DRUG')::INT AS bad_source, (t.label <> e.label)::INT AS bad_target
  FROM e JOIN e f ON f.o = e.o AND f.idx = 1 JOIN l s ON s.o = e.o AND s.id = f.id JOIN l t ON t.o = e.o AND t.id = e.id WHERE e.idx > 1
), d AS (
  SELECT o, count(*) AS entities, count(*) - count(DISTINCT id) AS dup, sum(no_text) AS no_text, sum(no_box) AS no_box, sum((label = 'DRUG')::INT) AS drugs,
    sum((label = 'FORM')::INT) AS forms, sum((label = 'STRENGTH')::INT) AS strengths FROM e GROUP BY o
), q AS (SELECT o, count(*) AS relations, sum(bad_source) AS bad_source, sum(bad_target) AS bad_target FROM r GROUP BY o),
v AS (
  SELECT d.o, entities, coalesce(relations, 0) AS relations, drugs, forms, strengths, CASE d.o % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'open' END AS status,
    CAST(dup + no_text + no_box + coalesce(bad_source, 0) + coalesce(bad_target, 0) + (d.o % 3 = 2)::INT + (d.o % 3 = 0 AND relations IS NULL)::INT AS BIGINT) AS errors,
    CAST((relations IS NULL)::INT + (drugs = 0)::INT AS BIGINT) AS warnings
  FROM d LEFT JOIN q ON q.o = d.o
)
"""


@query(_RECORDS + "SELECT CAST(o AS VARCHAR) AS sample_id, errors, warnings, errors = 0 AS valid FROM v")
def validate_docs(spark, sf_dir):
    rows = annotations.validate(views.records(spark, sf_dir))
    return rows.select("sample_id", F.size("errors").cast("long").alias("errors"), F.size("warnings").cast("long").alias("warnings"), "valid")


@query(
    _RECORDS
    + """SELECT count(*) AS samples, CAST(sum((errors = 0)::INT) AS BIGINT) AS valid_samples, CAST(sum((status = 'complete')::INT) AS BIGINT) AS complete_samples,
  CAST(sum((status = 'needs_review')::INT) AS BIGINT) AS needs_review_samples, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relations) AS BIGINT) AS relations,
  CAST(sum(drugs) AS BIGINT) AS entities_DRUG, CAST(0 AS BIGINT) AS "entities_ROUTE", CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings FROM v"""
)
def summarize_docs(spark, sf_dir):
    return annotations.summarize(views.records(spark, sf_dir)).select(
        "samples", "valid_samples", "complete_samples", "needs_review_samples", "entities", "relations", "entities_DRUG", "entities_ROUTE", "errors", "warnings"
    )


@query(
    _RECORDS
    + """SELECT CAST(o AS VARCHAR) AS sample_id, errors = 0 AND status = 'complete' AND relations > 0 AND o % 2 = 0 AS gold FROM v"""
)
def gold_gate(spark, sf_dir):
    rows = annotations.validate(views.records(spark, sf_dir))
    return rows.select("sample_id", annotations.gold_eligible().alias("gold"))


@query(
    _RECORDS
    + """SELECT CAST(o AS VARCHAR) AS sample_id, CAST(drugs AS BIGINT) AS drugs, relations AS existing_relation_count,
  CAST(4 + (relations > 0)::INT AS BIGINT) AS actions FROM v"""
)
def annotation_queue(spark, sf_dir):
    rows = annotations.queue(views.records(spark, sf_dir))
    return rows.select("sample_id", F.col("entity_counts.DRUG").alias("drugs"), "existing_relation_count", F.size("actions").cast("long").alias("actions"))


_ROLES = """WITH r AS (SELECT user_id, event_id % 3 AS role, event_type AS fp, event_id FROM events),
l AS (SELECT user_id, role, max_by(fp, event_id) AS fp FROM r GROUP BY user_id, role),
w AS (SELECT user_id, max(CASE WHEN role = 0 THEN fp END) AS a, max(CASE WHEN role = 1 THEN fp END) AS b, max(CASE WHEN role = 2 THEN fp END) AS c FROM l GROUP BY user_id)
"""


@query(
    _ROLES
    + """SELECT CAST(user_id AS VARCHAR) AS sample_id, CASE WHEN a IS NULL OR b IS NULL THEN 'not_comparable' WHEN a = b THEN 'agree' ELSE 'conflict' END AS agreement, c IS NOT NULL AS reviewed FROM w"""
)
def merge_roles(spark, sf_dir):
    return annotations.merge_roles(_role_records(spark, sf_dir)).select("sample_id", "agreement", "reviewed")


def _role_records(spark, sf_dir):
    """Each user's last event in each role as a record of one entity."""
    e = table(spark, sf_dir, "events").withColumn("role", F.element_at(F.array(*[F.lit(r) for r in ("annotator-a", "annotator-b", "reviewer")]), (F.col("event_id") % 3 + 1).cast("int")))
    last = e.groupBy("user_id", "role").agg(F.max_by("event_type", "event_id").alias("text"))
    entity = F.struct(F.concat(F.lit("id-"), F.col("role")).alias("id"), F.lit("DRUG").alias("label"), "text", F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]).alias("bbox"), F.lit(False).alias("needs_review"))
    none = F.array().cast("array<struct<id:string,type:string,source_entity_id:string,target_entity_id:string,needs_review:boolean>>")
    privacy = F.struct(*[F.lit(True).alias(x) for x in ("de_identified", "reviewed", "approved_for_research")])
    return last.select(F.col("user_id").cast("string").alias("sample_id"), "role", F.array(entity).alias("entities"), none.alias("relations"), F.lit("partial").alias("annotation_status"), privacy.alias("privacy"))


@query(
    _ROLES
    + """SELECT count(*) AS samples, count(*) FILTER (a = b) AS agreements, count(*) FILTER (a <> b) AS conflicts,
  count(*) FILTER (a IS NULL OR b IS NULL) AS not_comparable, CAST(0 AS BIGINT) AS gold FROM w"""
)
def merge_report(spark, sf_dir):
    return annotations.merge_report(annotations.merge_roles(_role_records(spark, sf_dir)))


@query(
    _ROLES
    + """SELECT 'DRUG' AS k, count(a) AS a, count(b) AS b, count(*) FILTER (a = b) AS both, round(2.0::DOUBLE * count(*) FILTER (a = b) / (count(a) + count(b)), 6) AS f1 FROM w"""
)
def role_agreement(spark, sf_dir):
    return annotations.agreement_items(_role_records(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@query(
    f"""WITH {views.BOXES_SQL}, f AS (
  SELECT l_orderkey AS o, l_linenumber AS id, idx, first_value(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY idx) AS head FROM lines
)
SELECT CAST(o AS VARCHAR) AS sample_id, count(*) FILTER (id <> 1) AS entities, count(*) FILTER (idx > 1 AND id <> 1 AND head <> 1) AS relations FROM f GROUP BY o"""
)
def kept_drafts(spark, sf_dir):
    kept = annotations.kept_draft(F.col("entities"), F.col("relations"), F.array(F.lit("e1")))
    rows = views.records(spark, sf_dir).withColumn("kept", kept)
    return rows.select("sample_id", *[F.size(f"kept.{c}").cast("long").alias(c) for c in ("entities", "relations")])


@query(
    """SELECT event_id, CASE WHEN confidence >= accept THEN 'ACCEPT' WHEN confidence >= review THEN 'REVIEW' ELSE 'ABSTAIN' END AS decision
FROM (SELECT event_id, event_type AS field, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events)
LEFT JOIN (VALUES ('click', 0.8::DOUBLE, 0.5::DOUBLE), ('view', 0.6::DOUBLE, 0.2::DOUBLE), ('purchase', 0.95::DOUBLE, 0.9::DOUBLE)) AS t(field, accept, review) USING (field)"""
)
def field_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("field"), ((F.col("event_id") % 100) / 100.0).alias("confidence"))
    thresholds = spark.createDataFrame([("click", 0.8, 0.5), ("view", 0.6, 0.2), ("purchase", 0.95, 0.9)], "field string, accept double, review double")
    return annotations.policy(rows, thresholds).select("event_id", "decision")


@query(
    """WITH g AS (SELECT p_partkey, p_brand AS field, p_name AS v FROM part WHERE p_partkey % 5 <> 0),
p AS (SELECT p_partkey, p_brand AS field, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_name END AS v FROM part WHERE p_partkey % 4 <> 0),
b AS (SELECT field, g.v AS g, p.v AS p FROM g FULL JOIN p USING (p_partkey, field))
SELECT field, count(*) AS fields, round(count(*) FILTER (g = p)::DOUBLE / count(*), 6) AS correct, round(count(*) FILTER (p IS NULL)::DOUBLE / count(*), 6) AS omission,
  round(count(*) FILTER (g IS NULL)::DOUBLE / count(*), 6) AS hallucination, round(count(*) FILTER (g <> p)::DOUBLE / count(*), 6) AS wrong FROM b GROUP BY field"""
)
def field_outcomes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("field"), F.col("p_name").alias("value"))
    said = part.where("p_partkey % 4 <> 0").withColumn("value", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("value")))
    rows = metrics.field_outcomes(part.where("p_partkey % 5 <> 0"), said, ["p_partkey", "field"])
    return rows.select("field", "fields", *[F.round(c, 6).alias(c) for c in ("correct", "omission", "hallucination", "wrong")])


# Converters: C01, C03, C05


@query(
    f"""WITH {views.BOXES_SQL} SELECT CAST(sample_id AS VARCHAR) AS sample_id, count(*) FILTER (label = 'R') AS unmapped, count(*) FILTER (label <> 'R') AS entities FROM gold GROUP BY sample_id"""
)
def convert_word_boxes(spark, sf_dir):
    label = F.when(F.col("label") == "N", "drugname").when(F.col("label") == "A", "Usage").otherwise("diagnose")
    words = views.boxes(spark, sf_dir, False).select(F.col("sample_id").cast("string").alias("sample_id"), "idx", label.alias("label"), "text", F.col("bbox").alias("box"))
    out = convert.word_boxes(words)
    return out.select("sample_id", "unmapped", F.greatest(F.coalesce(F.size("entities"), F.lit(0)), F.lit(0)).cast("long").alias("entities"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS sample_id, type, 'entity_1' AS source, target FROM part, (VALUES ('HAS_STRENGTH', 'entity_2'), ('HAS_FORM', 'entity_3')) AS r(type, target)")
def convert_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("Drug Name"), F.col("p_size").alias("ham_luong"), F.col("p_type").alias("dosage-form"), F.col("p_brand").alias("brand"))
    _, links = convert.fields(rows.withColumn("p_partkey", F.col("p_partkey").cast("string")), "p_partkey", ["Drug Name", "ham_luong", "dosage-form", "brand"])
    return links


@query(
    """SELECT l_orderkey AS image_id, o_orderpriority AS file_name, count(*) AS entities, CAST(sum(2 * l_linenumber) AS BIGINT) AS right_edges
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""
)
def convert_coco(spark, sf_dir):
    x = F.col("l_linenumber").cast("double")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("category_id"), F.array(x, x, x, x).alias("bbox"))
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file_name"))
    categories = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("drug").alias("name"))
    docs = convert.coco(images, a, categories)
    edges = F.aggregate("entities", F.lit(0.0), lambda s, e: s + e["bbox"][2])
    return docs.select("image_id", "file_name", F.size("entities").cast("long").alias("entities"), edges.cast("long").alias("right_edges"))


@query(
    f"""WITH {views.BOXES_SQL}, k AS (
  SELECT sample_id AS s, 'e' || (idx % 3) AS id, row_number() OVER (PARTITION BY sample_id ORDER BY idx) AS n FROM gold WHERE label <> 'R'
), l AS (SELECT s, id, max(n) AS n FROM k GROUP BY s, id)
SELECT g.sample_id, CAST(g.idx AS BIGINT) AS ord, 'T' AS type, 'entity_' || a.n AS source, 'entity_' || b.n AS target
FROM gold g JOIN l a ON a.s = g.sample_id AND a.id = 'e1' JOIN l b ON b.s = g.sample_id AND b.id = 'e' || (g.idx % 3) WHERE g.idx > 1"""
)
def convert_records(spark, sf_dir):
    words = views.boxes(spark, sf_dir, False).withColumn("id", F.concat(F.lit("e"), F.col("idx") % 3)).withColumnRenamed("idx", "ord")
    label = F.when(F.col("label") == "N", "drugname").when(F.col("label") == "A", "usage").otherwise("zzz")
    links = words.where("ord > 1").select("sample_id", "ord", F.lit("T").alias("type"), F.lit("e1").alias("source"), F.col("id").alias("target"))
    return convert.annotation_records(words.withColumn("label", label), links)[1].select("sample_id", "ord", "type", "source", "target")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, id, label, text, (o_orderkey % 50) * 2.0::DOUBLE AS x1, (o_orderkey % 50 + 10) * 2.0::DOUBLE AS x2, 20.0::DOUBLE AS y1, 25.0::DOUBLE AS y2, links
FROM orders, (VALUES ('entity_1', 'DRUG', 'a', 'HAS_STRENGTH>entity_2'), ('entity_2', 'STRENGTH', 'c', NULL)) AS e(id, label, text, links)"""
)
def convert_label_studio(spark, sf_dir):
    """A drug, an unknown label and a strength, a relation whole and one cut off."""
    def item(id_, kind, label, text, types, source, target):
        x = lambda v: F.lit(v).cast("double")
        value = F.struct(F.array(F.lit(label)).alias("labels"), (F.col("o_orderkey") % 50).cast("double").alias("x"), x(20).alias("y"), x(10).alias("width"), x(5).alias("height"), F.lit(text).alias("text"))
        s = lambda v: F.lit(v).cast("string")
        labels = F.array(*[F.lit(t) for t in types]).cast("array<string>")
        return F.struct(
            s(id_).alias("id"), F.lit(kind).alias("type"), value.alias("value"), labels.alias("labels"), s(source).alias("from_id"), s(target).alias("to_id"),
            x(200).alias("original_width"), x(100).alias("original_height"),
        )

    result = F.array(
        item("a", "labels", "Drug", "a", [], None, None), item("b", "labels", "zzz", "b", [], None, None), item("c", "labels", "strength", "c", [], None, None),
        item(None, "relation", "", "", ["HAS_STRENGTH"], "a", "c"), item(None, "relation", "", "", [], "a", "b"),
    )
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.array(F.struct(result.alias("result"))).alias("annotations"))
    entities, links = convert.label_studio(tasks)
    links = links.select("sample_id", F.col("source").alias("id"), F.concat_ws(">", "type", "target").alias("links"))
    box = [F.col("bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return entities.join(links, ["sample_id", "id"], "left").select("sample_id", "id", "label", "text", *box, "links")


# Contract and plans: V02, V03, D01-D05, V04, X01-X03


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 30 > 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 - 1 AS INTEGER) AS VARCHAR) END AS end_date FROM orders"""
)
def inclusive_end_date(spark, sf_dir):
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.inclusive_end_date(start, F.col("o_orderkey") % 30).cast("string").alias("end_date"))


_SLOTS = "lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':00', lpad(CAST(o_orderkey % 26 AS VARCHAR), 2, '0') || ':30', '08:00'"


@query(
    f"""WITH s AS (SELECT o_orderkey, [{_SLOTS}] AS s, o_orderkey % 26 < 24 AS ok FROM orders)
SELECT o_orderkey, CASE WHEN ok AND len(list_distinct(s)) = 3 THEN array_to_string(list_sort(s), ' ') END AS slots,
  CASE WHEN ok THEN array_to_string(list_sort(list_distinct(s)), ' ') END AS reminders FROM s"""
)
def time_slots(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    slots = F.array(F.concat(two(F.col("o_custkey") % 24), F.lit(":00")), F.concat(two(F.col("o_orderkey") % 26), F.lit(":30")), F.lit("08:00"))
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.array_join(D.time_slots(slots), " ").alias("slots"), F.array_join(D.reminder_schedule(slots), " ").alias("reminders"))


def _requests(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 11 == 0, " ").otherwise("A").alias("medicineName"),
        F.when(k % 4 == 0, "AS_NEEDED").when(k % 4 == 1, "TWICE_DAILY").when(k % 4 == 2, "ONCE_DAILY").otherwise("2 lần").alias("frequency"),
        F.lit(None).cast("string").alias("frequencySource"), F.lit("2024-05-01").alias("startDate"),
        F.when(k % 7 == 0, "2024-04-30").alias("endDate"), F.when(k % 5 > 0, k % 5).alias("timesPerDay"),
        F.when(k % 3 > 0, F.slice(F.array(F.lit("08:00"), F.lit("20:00")), 1, (k % 3).cast("int"))).alias("timeSlots"),
        F.lit(None).cast("double").alias("doseQuantity"), F.lit(None).cast("double").alias("durationDays"), F.lit(None).cast("boolean").alias("frequencyRequiresReview"),
    )


_REQUESTS = """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS t, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS n FROM orders)
"""


@query(
    _REQUESTS
    + """SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN 'medicineName is required' WHEN k % 4 = 3 THEN 'frequency is not valid' WHEN k % 7 = 0 THEN 'endDate is before startDate'
  WHEN k % 4 = 0 AND n IS NOT NULL AND t IS NOT NULL AND n <> t THEN 'timesPerDay must equal the number of timeSlots'
  WHEN k % 4 > 0 AND n IS NULL THEN 'timeSlots are required' WHEN k % 4 > 0 AND t IS NULL THEN 'timesPerDay is required'
  WHEN k % 4 > 0 AND n <> t THEN 'timesPerDay must equal the number of timeSlots' WHEN k % 4 = 1 AND n <> 2 THEN 'TWICE_DAILY needs 2 times' END AS error FROM r"""
)
def create_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("o_orderkey", contract.create_request_error().alias("error"))


@query(
    _REQUESTS
    + """, f AS (SELECT *, CASE k % 4 WHEN 0 THEN 'AS_NEEDED' WHEN 2 THEN 'ONCE_DAILY' ELSE 'TWICE_DAILY' END AS f FROM r),
g AS (SELECT *, coalesce(t, CASE f WHEN 'ONCE_DAILY' THEN 1 WHEN 'TWICE_DAILY' THEN 2 END) AS times FROM f)
SELECT k AS o_orderkey, f AS frequency, times AS "timesPerDay", f <> 'AS_NEEDED' AND (n IS NULL OR times IS NULL OR n <> times) AS review,
  CASE WHEN k % 11 = 0 THEN 'medicineName is required' END AS error FROM g"""
)
def parsed_medications(spark, sf_dir):
    rows = contract.parsed_medication(_requests(spark, sf_dir))
    return rows.select("o_orderkey", "frequency", "timesPerDay", F.col("frequencyRequiresReview").alias("review"), "error")


@query(
    """WITH e AS (SELECT *, o_orderkey AS k FROM orders), f AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'plan_id is required' WHEN k % 11 = 0 THEN 'prescription_id is required'
  WHEN k % 5 = 0 THEN 'medications must not be empty' WHEN k % 13 = 0 THEN 'medication_id is required' WHEN k % 17 = 0 THEN 'prescribed is required'
  WHEN k % 19 = 0 AND k % 3 <> 0 THEN 'fields_to_verify has an unknown field' END AS error FROM e)
SELECT k AS o_orderkey, error, CASE WHEN error IS NULL THEN CASE WHEN k % 2 <> 0 OR k % 3 = 0 THEN 'needs_verification' ELSE 'verified' END END AS status,
  CASE WHEN error IS NULL THEN CASE WHEN k % 3 = 0 THEN 'drug' ELSE '' END END AS fields, CASE WHEN error IS NULL THEN 'd' END AS raw_text FROM f"""
)
def create_plans(spark, sf_dir):
    k = F.col("o_orderkey")
    some = F.when(k % 3 == 0, F.array(F.lit("drug"), F.lit("drug"))).when(k % 19 == 0, F.array(F.lit("nope"))).otherwise(F.array().cast("array<string>"))
    med = F.struct(
        F.when(k % 13 == 0, "").otherwise("m").alias("medication_id"), F.lit("d").alias("drug_name"),
        F.when(k % 17 != 0, F.struct(F.lit(None).cast("string").alias("raw_text"))).alias("prescribed"),
        F.struct(F.when(k % 2 == 0, "verified").otherwise("x").alias("status"), some.alias("fields_to_verify")).alias("verification"),
    )
    plans = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("plan_id"), F.when(k % 11 != 0, "p").alias("prescription_id"),
        F.slice(F.array(med), 1, F.when(k % 5 == 0, 0).otherwise(1)).alias("medications"),
    )
    rows = plan.create_plans(plans).withColumn("m", F.get("medications", F.lit(0)))
    return rows.select("o_orderkey", "error", "status", F.array_join("m.verification.fields_to_verify", "|").alias("fields"), F.col("m.prescribed.raw_text").alias("raw_text"))


@query(
    """SELECT event_id % 3 AS role, user_id AS sample_id, max(event_id) AS version, max_by(event_type, event_id) AS text FROM events GROUP BY 1, 2"""
)
def latest_drafts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return plan.latest_drafts(e.select((F.col("event_id") % 3).alias("role"), F.col("user_id").alias("sample_id"), F.col("event_id").alias("version"), F.col("event_type").alias("text")))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS verify, sum((event_type = 'click')::INT) OVER w AS drug, sum((event_type = 'view')::INT) OVER w AS strength,
  lag(event_type IN ('click', 'view')) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, drug > 0 AND strength > 0 AS done, verify OR (drug > 0 AND strength > 0 AND before) AS applied FROM e)
SELECT CAST(user_id AS VARCHAR) AS plan_id,
  CASE WHEN NOT max_by(done, event_id) THEN 'needs_verification' WHEN max_by(verify, event_id) THEN 'verified' ELSE 'scheduled' END AS status,
  count(*) FILTER (applied) AS applied, count(*) FILTER (NOT coalesce(applied, false)) AS rejected,
  CASE WHEN count(*) FILTER (NOT coalesce(applied, false)) > 0 THEN 'plan is not verified' END AS last_error,
  'm1=' || concat_ws(',', CASE WHEN max(drug) = 0 THEN 'drug' END, CASE WHEN max(strength) = 0 THEN 'strength' END) || '@'
    || CASE WHEN count(*) FILTER (applied AND NOT verify) > 0 THEN '08:00,20:00' ELSE '' END AS medications
FROM c GROUP BY user_id"""
)
def plan_fold(spark, sf_dir):
    """Each user's events as commands: clicks verify a field, the rest schedule."""
    e = table(spark, sf_dir, "events").withColumn("plan_id", F.col("user_id").cast("string"))
    fields = F.array(F.lit("drug"), F.lit("strength"))
    med = F.array(F.struct(F.lit("m1").alias("medication_id"), F.lit(False).alias("verified"), fields.alias("fields")))
    plans = e.select("plan_id").distinct().withColumn("medications", med)
    verify = F.col("event_type").isin("click", "view")
    args = F.when(F.col("event_type") == "click", F.array(F.lit("drug"))).when(F.col("event_type") == "view", F.array(F.lit("strength")))
    commands = e.select(
        "plan_id", F.col("event_id").alias("seq"), F.when(verify, "verify").otherwise("schedule").alias("op"), F.lit("m1").alias("medication_id"),
        F.coalesce(args, F.array(F.lit("20:00"), F.lit("08:00"), F.lit("08:00"))).alias("args"),
    )
    return plan.fold_commands(plans, commands)
