"""OCR, entity and relation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators.grouped import fold_groups
from docloom.operators.ordering import running_sums
from docloom.session import Scratch


def box_pairs(gold: DataFrame, predicted: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Pairs of boxes of one sample (and label, if among the keys) with an IoU of
    the threshold at least. Rows have the keys, idx, text and bbox."""
    g = gold.select(*keys, F.col("idx").alias("gold_idx"), F.col("text").alias("gold_text"), F.col("bbox").alias("g"))
    p = predicted.select(*keys, F.col("idx").alias("pred_idx"), F.col("text").alias("pred_text"), F.col("bbox").alias("p"))
    pairs = g.join(p, keys)
    if threshold > 0:
        pairs = pairs.where(G.overlaps(F.col("g"), F.col("p")))
    return pairs.withColumn("iou", G.iou(F.col("g"), F.col("p"))).where(F.col("iou") >= threshold).drop("g", "p")


def greedy_match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs taken one by one, best IoU first, ties by gold and then predicted
    index, each side once."""
    gold, predicted = (pairs.columns.index(c) for c in ("gold_idx", "pred_idx"))

    def run(rows: list[tuple]) -> list[tuple]:
        used, taken = (set(), set()), []
        for row in rows:
            if row[gold] not in used[0] and row[predicted] not in used[1]:
                used[0].add(row[gold])
                used[1].add(row[predicted])
                taken.append(row)
        return taken

    return fold_groups(pairs, keys, [F.desc("iou"), "gold_idx", "pred_idx"], run, pairs.schema)


def _scores(matched: DataFrame, gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    a, b = T.normalize_ocr_text("gold_text"), T.normalize_ocr_text("pred_text")
    texts = matched.withColumn("a", a).withColumn("b", b)
    m = texts.groupBy(*keys).agg(
        F.count("*").alias("matched_count"),
        F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("text_exact_accuracy"),
        F.avg(T.character_error_rate(F.col("a"), F.col("b"))).alias("mean_cer"),
        F.avg(T.wer_legacy(F.col("a"), F.col("b"))).alias("mean_wer"),
    )
    g = gold.groupBy(*keys).agg(F.count("*").alias("gold_count"))
    p = predicted.groupBy(*keys).agg(F.count("*").alias("predicted_count"))
    rows = g.join(p, keys, "full").join(m, keys, "left").na.fill(0)
    precision = G.ratio_or_empty(F.col("matched_count"), F.col("predicted_count"), F.col("gold_count"))
    recall = G.ratio_or_empty(F.col("matched_count"), F.col("gold_count"), F.col("predicted_count"))
    rows = rows.withColumn("precision", precision).withColumn("recall", recall)
    return rows.withColumn("f1", G.f1(F.col("precision"), F.col("recall")))


def evaluate_ocr_words(gold: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of scores for each sample of words (sample_id, idx, text, bbox)."""
    keys = ["sample_id"]
    return _scores(greedy_match(box_pairs(gold, predicted, threshold, keys), keys), gold, predicted, keys)


def evaluate_entities(gold: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each sample (label null) and each of its labels. Pairs need
    equal labels, so a sample's match is the union of its labels' matches."""
    keys = ["sample_id", "label"]
    matched = greedy_match(box_pairs(gold, predicted, threshold, keys), keys)
    whole = _scores(matched, gold, predicted, ["sample_id"]).withColumn("label", F.lit(None).cast("string"))
    return _scores(matched, gold, predicted, keys).unionByName(whole)


def micro_scores(rows: DataFrame) -> DataFrame:
    """Scores of the sums of gold, predicted and matched counts; 0 for 0 / 0."""
    s = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold_count", "predicted_count", "matched_count")])
    p = F.when(F.col("predicted_count") == 0, 0.0).otherwise(F.col("matched_count") / F.col("predicted_count"))
    r = F.when(F.col("gold_count") == 0, 0.0).otherwise(F.col("matched_count") / F.col("gold_count"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", G.f1(F.col("precision"), F.col("recall")))


def macro_scores(rows: DataFrame, columns=("precision", "recall", "f1", "text_exact_accuracy", "mean_cer", "mean_wer")) -> DataFrame:
    return rows.agg(F.count("*").alias("samples"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def corpus_error_rates(pairs: DataFrame, normalize=T.normalize_eval_text, by: list[str] | None = None) -> DataFrame:
    """CER and WER (true ones) and exact share of text pairs (reference,
    hypothesis), each the sum of errors for the sum of lengths, with and without
    diacritics. A missing hypothesis is empty."""
    out = pairs
    sums = [F.count("*").alias("samples")]
    for name, bare in (("", False), ("_plain", True)):
        a, b = f"__a{name}", f"__b{name}"
        out = out.withColumn(a, normalize("reference", bare)).withColumn(b, normalize("hypothesis", bare))
        ca, cb = F.col(a), F.col(b)
        sums += [
            (F.sum(F.levenshtein(ca, cb)) / F.greatest(F.sum(F.length(ca)), F.lit(1))).alias(f"cer{name}"),
            (F.sum(T.word_edits(ca, cb)) / F.greatest(F.sum(T.word_count(ca)), F.lit(1))).alias(f"wer{name}"),
            F.avg(F.when(ca == cb, 1.0).otherwise(0.0)).alias(f"exact{name}"),
        ]
    return out.groupBy(*(by or [])).agg(*sums)


def crop_error_rates(crops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Error rates of crops (reference, hypothesis: null where the image could not be
    read): errors and lengths of those that were read, exact ones for each of all."""
    every = crops.groupBy(*(by or [])).agg(F.count("*").alias("samples"), F.count("hypothesis").alias("read"))
    rates = corpus_error_rates(crops.where("hypothesis IS NOT NULL"), T.normalize_eval_text_plain, by).withColumnRenamed("samples", "__read")
    rows = every.join(rates, by, "left") if by else every.join(F.broadcast(rates))
    share = F.when(F.col("samples") > 0, F.col("read") / F.col("samples"))
    exact = {c: F.coalesce(c, F.lit(0.0)) * share for c in ("exact", "exact_plain")}
    return rows.withColumns(exact).drop("__read")


def histogram(col: Column, bounds: list[float], missing: Column | None = None) -> Column:
    """The name of the bucket of fixed bounds: lt_a, a_to_b, gte_z."""
    value = F.coalesce(col, missing) if missing is not None else col
    out = F.when(value < bounds[0], f"lt_{bounds[0]:g}")
    for a, b in zip(bounds, bounds[1:]):
        out = out.when(value < b, f"{a:g}_to_{b:g}")
    return out.when(value.isNotNull(), f"gte_{bounds[-1]:g}")


def worst(rows: DataFrame, metric: str, order: str, n: int = 20, descending: bool = True) -> DataFrame:
    return rows.orderBy(F.desc(metric) if descending else F.asc(metric), order).limit(n)


def numeric_agreement(pairs: DataFrame) -> DataFrame:
    """Whether the ordered numbers of matched texts agree, as counts."""
    a, b = T.numeric_signature("gold_text"), T.numeric_signature("pred_text")
    has = (F.size(a) > 0) | (F.size(b) > 0)
    return pairs.agg(
        F.count("*").alias("matched"), F.count(F.when(has, 1)).alias("with_numbers"),
        F.count(F.when(has & (a == b), 1)).alias("agree"), F.count(F.when(has & (a != b), 1)).alias("differ"),
    )


def relation_key(kind: Column, source: Column, target: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("undefined")) for c in (kind, source, target)])


def evaluate_relations(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn and scores of distinct relations (sample_id, type,
    source_entity_id, target_entity_id), overall (type null) and by type."""
    cols = ["sample_id", "type", "source_entity_id", "target_entity_id"]
    g = gold.select(*cols).distinct().withColumn("g", F.lit(1))
    p = predicted.select(*cols).distinct().withColumn("p", F.lit(1))
    same = F.lit(True)
    for c in cols:
        same = same & g[c].eqNullSafe(p[c])
    both = g.join(p, same, "full").select(F.coalesce(g["type"], p["type"]).alias("type"), "g", "p")
    counts = both.groupingSets([["type"], []], "type").agg(
        F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("g").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("p").isNull(), 1)).alias("fn"),
    )
    precision = F.when(F.col("tp") + F.col("fp") == 0, F.when(F.col("fn") == 0, 1.0).otherwise(0.0)).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") == 0, F.when(F.col("fp") == 0, 1.0).otherwise(0.0)).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    rows = counts.withColumn("precision", precision).withColumn("recall", recall)
    return rows.withColumn("f1", G.f1(F.col("precision"), F.col("recall")))


def calibration(rows: DataFrame, by: list[str], buckets: int = 10) -> DataFrame:
    """ECE, Brier score and log loss of (confidence, correct) by field."""
    c = F.least(F.greatest(F.col("confidence"), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col("correct").cast("double")
    b = F.least(F.floor(F.col("confidence") * buckets), F.lit(buckets - 1))
    parts = rows.withColumn("__b", b).groupBy(*by, "__b").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(y).alias("y"),
        F.sum((F.col("confidence") - y) ** 2).alias("q"), F.sum(-(y * F.log(c) + (1 - y) * F.log(1 - c))).alias("l"),
    )
    total = F.sum("n")
    return parts.groupBy(*by).agg(
        total.alias("samples"), (F.sum(F.abs(F.col("c") - F.col("y"))) / total).alias("ece"),
        (F.sum("q") / total).alias("brier"), (F.sum("l") / total).alias("nll"),
    )


def risk_coverage(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Coverage and risk at each distinct confidence of (confidence, correct): sums over
    ranges of the confidence, as there may be as many as rows."""
    at = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("wrong"))
    sums, totals = running_sums(at, [F.desc("confidence")], ["n", "wrong"], scratch)
    return sums.select("confidence", (F.col("n_upto") / F.lit(totals["n"])).alias("coverage"), (F.col("wrong_upto") / F.col("n_upto")).alias("risk"))


def field_outcomes(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of accuracy, omission, hallucination and wrong values over fields
    (keys, value) by ``field``."""
    both = gold.withColumnRenamed("value", "g").join(predicted.withColumnRenamed("value", "p"), keys, "full")
    kind = F.when(F.col("g").isNull(), "hallucination").when(F.col("p").isNull(), "omission").when(F.col("g") == F.col("p"), "correct").otherwise("wrong")
    n = F.count("*")
    return both.withColumn("kind", kind).groupBy("field").agg(
        n.alias("fields"), *[(F.count(F.when(F.col("kind") == k, 1)) / n).alias(k) for k in ("correct", "omission", "hallucination", "wrong")]
    )


def latency(rows: DataFrame, by: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """P50, P95, P99 of latency_ms (between neighbours in proportion) and the share with
    an error. Equal values are counted; running counts over ranges of group and value
    tell which values stand at a quantile's places, so no task holds a group's values."""
    by = by or []
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    summary = rows.groupBy(*by).agg(F.count("*").alias("requests"), F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"))
    at = rows.where("latency_ms IS NOT NULL").groupBy(*by, "latency_ms").agg(F.count("*").alias("n"))
    sums, _ = running_sums(at, [*by, "latency_ms"], ["n"], scratch)
    base = sums.groupBy(*by).agg(F.min(F.col("n_upto") - F.col("n")).alias("base"), F.sum("n").alias("every"))
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = sums.alias("s").join(base.alias("b"), keys) if by else sums.join(F.broadcast(base))
    low, high = F.col("n_upto") - F.col("n") - F.col("base"), F.col("n_upto") - F.col("base")
    held = lambda place: F.max(F.when((place >= low) & (place < high), F.col("latency_ms")))
    ends = []
    for name, share in shares.items():
        place = share * (F.col("every") - 1)
        ends += [held(F.floor(place)).alias(f"{name}_low"), held(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
    found = joined.groupBy(*[F.col(f"s.{c}").alias(c) for c in by]).agg(*ends)
    value = lambda name: (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")).alias(name)
    found = found.select(*by, *map(value, shares))
    whole = summary.alias("r").join(found.alias("f"), [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by], "left") if by else summary.join(F.broadcast(found))
    return whole.select(*[F.col(f"r.{c}").alias(c) if by else F.col(c) for c in by], "requests", *shares, "error_rate")
