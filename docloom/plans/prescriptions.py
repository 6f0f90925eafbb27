"""Queries over prescriptions and their annotations, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import annotations, evaluation, extract, linking, medication, metrics
from docloom.plans import registry, views
from docloom.plans.registry import query
from docloom.session import table


def _pick(k, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


# Rules of a line: T07, T17-T19, T21, T24

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    f"""WITH t AS (SELECT {_KEYS}, l_partkey % 4 AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT {_KEYS}, q + 0.5::DOUBLE AS amount, CASE k WHEN 1 THEN 'gói' WHEN 2 THEN 'hộp' ELSE 'viên' END AS unit, 'SL: ' || q || ',5 ' || CASE k WHEN 0 THEN 'vien' WHEN 1 THEN 'GOI' WHEN 2 THEN 'Hộp' ELSE 'v' END AS said,
  CASE k WHEN 0 THEN 'Sáng' WHEN 1 THEN 'trua' WHEN 2 THEN 'Chiều' END AS timing, CASE k WHEN 0 THEN q || ',5 viên' WHEN 1 THEN q || ' gói' WHEN 3 THEN q || ' ml' END AS dose,
  CASE WHEN q % 2 = 0 THEN 'Uống sau  khi ăn' END AS meal, CASE WHEN q % 3 = 0 THEN lpad(CAST(q % 28 + 1 AS VARCHAR), 2, '0') || '/1-24' END AS date, q % 3 = 1 AS diagnosis FROM t"""
)
def line_rules(spark, sf_dir):
    """Quantities, times, doses, meals, dates and diagnoses of made lines; the letter đ
    at a word's end is no word's end."""
    k, q = F.col("l_partkey") % 4, F.col("l_quantity").cast("long")
    s = q.cast("string")
    amount = F.concat(F.lit("đủ SL: "), s, F.lit(",5 "), _pick(k, "vien", "GOI", "Hộp", "v"), F.lit("; x"))
    dose = F.when(k == 0, F.concat(s, F.lit(",5 vien"))).when(k == 1, F.concat(s, F.lit(" goi, 2 ong"))).when(k == 2, F.concat(s, F.lit(" lọ"))).otherwise(F.concat(s, F.lit("ml")))
    use = F.concat(F.lit("Ngày "), _pick(k, "Sáng", "trua", "Chiều", "đêm"), F.lit(" dùng "), dose, F.when(q % 2 == 0, " Uống sau  khi ăn").otherwise(""))
    date = F.concat(F.lit("ngày "), F.lpad((q % 28 + 1).cast("string"), 2, "0"), F.lit("/1-24"))
    other = F.when(q % 3 == 0, date).when(q % 3 == 1, "CHẨN ĐOÁN: ho").otherwise("khác 1/2")
    rows = table(spark, sf_dir, "lineitem").withColumns({"amount": amount, "use": use, "other": other}).withColumn("q", T.parse_quantity("amount"))
    return rows.select(
        *_KEYS.split(", "), F.col("q.value").alias("amount"), "q.unit", F.col("q.text").alias("said"), T.timing("use").alias("timing"), T.dose("use").alias("dose"),
        T.meal_timing("use").alias("meal"), T.line_date("other").alias("date"), T.is_diagnosis("other").alias("diagnosis"),
    )


@query(
    """SELECT doc_id, md5(text) AS repaired, md5(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS plain FROM documents"""
)
def repaired_texts(spark, sf_dir):
    """Texts read as Latin-1 and put right again, and their form for scores without marks."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.repair_mojibake(broken, True).alias("t"), "text")
    return rows.select("doc_id", F.md5("t").alias("repaired"), F.md5(T.normalize_eval_text_plain("text", True)).alias("plain"))


# Whole prescriptions: V06, V07, V08, V11, T20

_LINES = f"WITH {views.BOXES_SQL.partition(', gold AS')[0]}, w AS (SELECT l_orderkey AS s, idx, l_partkey % 7 AS p, CAST(l_quantity AS BIGINT) AS q FROM lines)"


@query(
    _LINES
    + """, r AS (SELECT s, idx AS i, 0 AS stage, idx, 0 AS part, 'DRUG' AS label, 'Drug ' || p AS text, idx AS d FROM w WHERE idx % 4 = 1
  UNION ALL SELECT s, idx, 0, idx, 1, 'STRENGTH', '5 mg', idx FROM w WHERE idx % 4 = 1
  UNION ALL SELECT s, idx, 1, idx, 0, 'TIMING', 'sáng', idx - 1 FROM w WHERE idx % 4 = 2
  UNION ALL SELECT s, idx, 1, idx, 1, 'DOSE', '2 viên', idx - 1 FROM w WHERE idx % 4 = 2
  UNION ALL SELECT w.s, idx, 1, idx, 2, 'INSTRUCTION', 'Uống sau khi ăn', CASE WHEN n > idx THEN idx + 1 ELSE idx - 3 END FROM w JOIN (SELECT s, max(idx) AS n FROM w GROUP BY s) USING (s) WHERE idx % 4 = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY stage, idx, part) AS n FROM r)
SELECT e.s AS sample_id, 'candidate_entity_' || e.n AS id, e.label, e.text, CASE WHEN e.label <> 'DRUG' THEN 'HAS_' || e.label || ':candidate_entity_' || h.n END AS link
FROM e LEFT JOIN e h ON h.s = e.s AND h.label = 'DRUG' AND h.d = e.d AND e.label <> 'DRUG'
UNION ALL SELECT s, 'quantity_' || idx, 'gói', CAST(q AS VARCHAR), 'drug_' || CASE WHEN idx % 4 = 3 THEN idx - 2 END FROM w WHERE idx % 4 = 3"""
)
def annotation_candidates(spark, sf_dir):
    """Words of an order in turn: a drug, its use, a quantity (as far from the next
    drug as from this one) and a note, which is nearest to the next drug."""
    n, lines = F.col("idx"), views._lines(spark, sf_dir)
    drug = F.concat(n.cast("string"), F.lit(") Drug "), (F.col("l_partkey") % 7).cast("string"), F.lit(" 5 mg"))
    amount = F.concat(F.lit("SL: "), F.col("l_quantity").cast("long").cast("string"), F.lit(" goi"))
    text = F.when(n % 4 == 1, drug).when(n % 4 == 2, "Uống sáng 2 vien").when(n % 4 == 3, amount).otherwise("Ghi chú Uống sau khi ăn")
    y = n * 10.0
    words = lines.select(
        F.col("l_orderkey").alias("sample_id"), "idx", n.cast("string").alias("id"), _pick(n % 4, "other", "drugname", "usage", "quantity").alias("label"), text.alias("text"),
        F.array(F.lit(0.0), y, F.lit(50.0), y + 8).alias("box"),
    )
    entities, relations, quantities = extract.medication_candidates(words)
    links = relations.select("sample_id", F.col("target_entity_id").alias("id"), F.concat("type", F.lit(":"), "source_entity_id").alias("link"))
    amounts = quantities.select(
        "sample_id", F.concat(F.lit("quantity_"), "idx").alias("id"), F.col("unit").alias("label"), F.col("value").cast("long").cast("string").alias("text"),
        F.concat(F.lit("drug_"), "source_drug_idx").alias("link"),
    )
    return entities.join(links, ["sample_id", "id"], "left").select("sample_id", "id", "label", "text", "link").unionByName(amounts)


@query(
    _LINES
    + """, m AS (SELECT s, string_agg(idx || '/Drug ' || p || '/' || CASE q % 3 WHEN 0 THEN '5 mg' WHEN 1 THEN '2,5 g 10 %' ELSE '' END || '/' || CASE WHEN q % 2 = 0 THEN q || ' viên' ELSE '' END
  || '/' || CASE WHEN idx % 3 = 0 THEN 'sau ăn' ELSE '' END, ';' ORDER BY idx) AS medicines, count(*) + count(*) FILTER (idx % 3 = 0) + 3 AS lines FROM w GROUP BY s)
SELECT s AS sample_id, medicines, least(7, lines) AS header, 'Chẩn đoán: G12' AS diagnoses, '03/04/2024' AS dates FROM m"""
)
def structured_prescriptions(spark, sf_dir):
    """Lines of an order: a head, a diagnosis, each item as a numbered line with a note
    to some, and a date that comes twice."""
    n, q = F.col("idx"), F.col("l_quantity").cast("long")
    strength = F.when(q % 3 == 0, " 5 mg").when(q % 3 == 1, " 2,5 g 10%").otherwise("")
    amount = F.when(q % 2 == 0, F.concat(F.lit("  SL: "), q.cast("string"), F.lit(" viên"))).otherwise("")
    item = F.concat(n.cast("string"), F.lit(") Drug "), (F.col("l_partkey") % 7).cast("string"), strength, amount)
    item = F.regexp_replace(item, "10%", "10%x")
    rows = views._lines(spark, sf_dir).select(F.col("l_orderkey").alias("sample_id"), "idx", item.alias("item"))
    line = lambda no, text: F.struct(no.cast("long").alias("line_no"), text.alias("text"))
    head = [line(F.lit(0), F.lit("Bệnh viện")), line(F.lit(1), F.lit("Chẩn đoán: G12")), line(F.lit(5), F.lit(" \t")), line(F.lit(100000), F.lit("Ngày 03/04/2024 ngày 03/04/2024"))]
    # an order's first item brings the lines that come once
    own, note = line(n * 10, F.col("item")), line(n * 10 + 1, F.lit(" Ghi chú  sau ăn"))
    lines = rows.select("sample_id", F.inline(F.when(n == 1, F.array(*head, own)).when(n % 3 == 0, F.array(own, note)).otherwise(F.array(own))))
    out = extract.structure(lines)
    medicine = lambda x: F.concat_ws(
        "/", x["m"]["order"].cast("string"), F.regexp_replace(x["m"]["name"], " 2,5 g 10%x$", ""), F.coalesce(x["m"]["strength"], F.lit("")),
        F.coalesce(F.concat(x["m"]["quantity"], F.lit(" "), x["m"]["unit"]), F.lit("")), F.array_join(x["instructions"], ","),
    )
    return out.select(
        "sample_id", F.array_join(F.transform("medicines", medicine), ";").alias("medicines"), F.size("patient_and_header").cast("long").alias("header"),
        F.array_join("diagnoses", ";").alias("diagnoses"), F.array_join("dates", ";").alias("dates"),
    )


@query(
    registry._DECIDE.rpartition("SELECT query_id, status")[0]
    + f""", m AS (SELECT query_id // 10 AS s, status, row_number() OVER (PARTITION BY query_id // 10 ORDER BY query_id) AS number FROM d WHERE status <> 'not_found'),
n AS (SELECT s, count(*) AS medications, count(*) FILTER (status <> 'linked') AS confirm,
  string_agg(replace('{medication.CONFIRM}', '{{}}', CAST(number AS VARCHAR)), ' ' ORDER BY number) FILTER (status <> 'linked') AS notes FROM m GROUP BY s)
SELECT s || '-plan' AS plan_id, 'needs_verification' AS status, coalesce(medications, 0) AS medications, coalesce(notes, '{medication.NOTHING}') AS notes
FROM (SELECT DISTINCT p_partkey // 10 AS s FROM part) LEFT JOIN n USING (s)"""
)
def draft_plans(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(F.floor(F.col("p_partkey") / 10).alias("prescription_id"), F.col("p_partkey").alias("ord"), views.noisy_line().alias("text"))
    rows = medication.medication_drafts(lines, views.catalog(spark, sf_dir), True, linking.BATCH_THRESHOLD, linking.BATCH_MARGIN)
    return rows.select("plan_id", "status", F.size("medications").cast("long").alias("medications"), F.array_join("notes", " ").alias("notes"))


@query(
    """WITH e AS (SELECT p_partkey % 500 AS id, p_partkey AS ord, p_name FROM part)
SELECT CAST(id AS VARCHAR) AS drug_database_id, min(ord) AS ord, max_by(p_name, ord) AS brand_name FROM e GROUP BY id"""
)
def catalog_updates(spark, sf_dir):
    rows = views.catalog(spark, sf_dir).withColumn("drug_database_id", (F.col("ord") % 500).cast("string"))
    first = rows.where("ord < 500")
    return linking.upsert(first, rows.where("ord >= 500")).select("drug_database_id", "ord", "brand_name")


# Drafts and their lists: C08, P20, P15, J04, J17, A21, A22


@query(
    f"""WITH {views.BOXES_SQL.partition(', gold AS')[0]}, e AS (SELECT l_orderkey AS s, idx, l_linenumber AS id, l_returnflag AS f, l_linestatus AS t, l_discount = 0 AS bare FROM lines),
k AS (SELECT s, id, max(idx) AS n FROM e GROUP BY s, id)
SELECT CAST(s AS VARCHAR) AS sample_id, idx AS n, CASE WHEN idx = 1 THEN CASE WHEN f = 'N' THEN 'DRUG' ELSE 'INSTRUCTION' END WHEN f = 'A' THEN 'STRENGTH' WHEN f = 'R' THEN 'DOSE' ELSE 'TIMING' END AS label,
  CASE WHEN bare THEN '' ELSE t END AS text, CASE WHEN bare THEN 1.0::DOUBLE ELSE 8.0::DOUBLE END AS bottom,
  CASE WHEN idx > 1 THEN 'entity_' || a.n || '>entity_' || b.n END AS link
FROM e JOIN (SELECT s, id AS first_id FROM e WHERE idx = 1) USING (s) JOIN k a ON a.s = e.s AND a.id = first_id JOIN k b ON b.s = e.s AND b.id = e.id"""
)
def working_copies(spark, sf_dir):
    """Records as candidates: a label that is none, and words without text or box."""
    bare = lambda e: F.trim(e["text"]) == ""
    entity = lambda e: e.withField("label", F.when(e["label"] == "FORM", "FORMS").otherwise(e["label"])).withField("bbox", F.when(~bare(e), e["bbox"])).withField("text", F.when(~bare(e), e["text"]))
    rows = views.records(spark, sf_dir).withColumn("w", annotations.working_copy(F.transform("entities", entity), F.col("relations")))
    link = F.get("w.relations", F.col("i") - 1)
    rows = rows.select("sample_id", "w", F.posexplode("w.entities").alias("i", "e"))
    return rows.select(
        "sample_id", (F.col("i") + 1).cast("long").alias("n"), "e.label", "e.text", F.col("e.bbox")[3].alias("bottom"),
        F.when(F.col("i") > 0, F.concat(link["source_entity_id"], F.lit(">"), link["target_entity_id"])).alias("link"),
    )


@query(
    f"""WITH {views.BOXES_SQL.partition(', gold AS')[0]}, f AS (
  SELECT l_orderkey AS o, l_linenumber AS id, idx, first_value(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY idx) AS head FROM lines
)
SELECT CAST(o AS VARCHAR) AS sample_id, count(*) FILTER (id <> 1) AS entities, count(*) FILTER (idx > 1 AND id <> 1 AND head <> 1) AS relations,
  CASE WHEN o % 2 = 0 THEN 0 ELSE count(*) FILTER (id <> 1 AND idx % 2 = 0) END AS to_review, CASE WHEN o % 2 = 0 THEN 'complete' ELSE 'needs_review' END AS status FROM f GROUP BY o"""
)
def saved_drafts(spark, sf_dir):
    """Drafts without entity e1: half of the flags are missing and ask for review."""
    flags = F.transform("entities", lambda e: e.withField("needs_review", F.when(e["idx"] % 2 == 1, F.lit(False))))
    complete = F.col("sample_id").cast("long") % 2 == 0
    rows = views.records(spark, sf_dir).withColumn("d", annotations.saved_draft(flags, F.col("relations"), F.array(F.lit("e1")), complete))
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "sample_id", size("d.entities").alias("entities"), size("d.relations").alias("relations"), size(F.filter("d.entities", lambda e: e["needs_review"])).alias("to_review"),
        F.col("d.annotation_status").alias("status"),
    )


@query(registry._RECORDS + "SELECT CAST(o AS VARCHAR) AS sample_id, errors = 0 AND status = 'complete' AND relations > 0 AND o % 2 = 0 AS ready FROM v")
def experiment_gate(spark, sf_dir):
    rows = annotations.validate(views.records(spark, sf_dir))
    return rows.select("sample_id", annotations.experiment_ready().alias("ready"))


@query(
    """SELECT o_orderkey AS sample_id, c_name AS label FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 = 0"""
)
def labelled_orders(spark, sf_dir):
    names = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    labels = orders.join(names, "k").select(F.col("o_orderkey").alias("sample_id"), "label")
    return evaluation.labelled_manifest(orders.select(F.col("o_orderkey").alias("sample_id")), labels)


@query(
    f"""WITH {views.BOXES_SQL} SELECT g.sample_id, g.idx AS ord, coalesce(a.text, 'e0') AS source_text, coalesce(b.text, 'e' || g.idx * 2) AS target_text
FROM gold g LEFT JOIN gold a ON a.sample_id = g.sample_id AND a.idx = g.idx - 1 LEFT JOIN gold b ON b.sample_id = g.sample_id AND b.idx = g.idx * 2"""
)
def relation_texts(spark, sf_dir):
    words = views.boxes(spark, sf_dir, False)
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    links = words.select("sample_id", F.col("idx").alias("ord"), name(F.col("idx") - 1).alias("source_entity_id"), name(F.col("idx") * 2).alias("target_entity_id"))
    links = links.withColumn("source_entity_id", F.when(F.col("ord") == 1, "e0").otherwise(F.col("source_entity_id")))
    out = evaluation.relation_list(links, words.select("sample_id", name(F.col("idx")).alias("id"), "text"))
    return out.select("sample_id", "ord", "source_text", "target_text")


@query(
    f"""WITH {views.BOXES_SQL}, w AS (SELECT sample_id, idx % 3 AS line, CASE WHEN idx % 5 > 1 THEN idx % 10 / 10.0::DOUBLE END AS c FROM gold)
SELECT count(DISTINCT sample_id) AS images, count(DISTINCT sample_id * 3 + line) + count(DISTINCT sample_id) AS lines, count(*) AS words, round(avg(c), 6) AS mean_confidence FROM w"""
)
def viewer_stats(spark, sf_dir):
    """Orders as images of up to three lines and one without words."""
    n = F.col("idx")
    confidence = F.when(n % 5 == 0, float("nan")).when(n % 5 > 1, (n % 10) / 10.0)
    lines = views.boxes(spark, sf_dir, False).groupBy("sample_id", (n % 3).alias("line")).agg(F.collect_list(F.struct(confidence.alias("confidence"))).alias("words"))
    records = lines.groupBy("sample_id").agg(F.collect_list(F.struct("words")).alias("lines"))
    empty = F.array(F.struct(F.lit(None).cast("array<struct<confidence: double>>").alias("words")))
    return evaluation.viewer_stats(records.withColumn("lines", F.concat("lines", empty))).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(registry._RECORDS + "SELECT count(*) AS rows, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relations) AS BIGINT) AS relations FROM v")
def candidate_totals(spark, sf_dir):
    return evaluation.array_totals(views.records(spark, sf_dir), ["entities", "relations"])


@query(
    registry._TURNS
    + """, r AS (SELECT a, CASE WHEN turn % 3 > 0 THEN b END AS b FROM c)
SELECT count(*) AS samples, count(b) AS read, round(sum(levenshtein(a, b)) / sum(CASE WHEN b IS NOT NULL THEN length(a) END), 6) AS cer, round(count(*) FILTER (a = b) / count(*), 6) AS exact FROM r"""
)
def crop_errors(spark, sf_dir):
    """Turns read as the next one; every third could not be read."""
    turns = registry._turns(spark, sf_dir).select(F.col("a").alias("reference"), F.when(F.col("turn") % 3 > 0, F.col("b")).alias("hypothesis"))
    return metrics.crop_error_rates(turns).select("samples", "read", F.round("cer", 6).alias("cer"), F.round("exact", 6).alias("exact"))
