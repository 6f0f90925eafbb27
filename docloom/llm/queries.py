"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.llm import infilling, jaccard, langid, linededup, paragraphs, toxicity, vectors, warc
from docloom.llm.fingerprint import fingerprints
from docloom.llm.mixing import mix
from docloom.llm.packing import pack
from docloom.llm.periodic import periodic_runs
from docloom.llm.quality import quality
from docloom.session import Scratch, table


def _crc(column, divisor):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(-1))


def op1_cross_parsing_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_crc("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (_crc("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_order_minhash(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op4_tokeniser_fertility(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).drop("h", "lang")


def op5_warc_revisits(spark, sf_dir):
    scratch = Scratch(spark, "warc")
    path = scratch.path("archive")
    warc.write(table(spark, sf_dir, "pages"), path, min_bytes=0, scratch=scratch)
    records = warc.read(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def op6_harmonic_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op7_paragraph_minhash(spark, sf_dir):
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op8_counterfactual_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(_crc("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs, model)
    return scored.select("doc_id", (_crc("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_pivotal_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("h")


def op10_line_templates(spark, sf_dir):
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op11_fill_in_middle(spark, sf_dir):
    rows = infilling.fill_in_middle(table(spark, sf_dir, "documents"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def tiled(docs):
    """Documents of which one in ten repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), chosen.alias("w"))
    n, g = F.size("w"), F.col("g")
    rows = rows.select("*", F.when(n > 0, g % n).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int").alias("p"))
    rest, period = n - F.col("a"), F.slice("w", F.col("a") + 1, F.col("p"))
    times = F.ceil(rest / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), rest)
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    rows = periodic_runs(tiled(table(spark, sf_dir, "documents")))
    # the greatest exponent: no two of different value are nearer than the decimals tell
    longer = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(longer(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("r"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_words", "n_runs", "r.start", "r.length", "r.period", F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quantised_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def queries():
    return {
        "op1_cross_parsing_language": op1_cross_parsing_language,
        "op5_warc_revisits": op5_warc_revisits,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_order_minhash": op3_order_minhash,
        "op4_tokeniser_fertility": op4_tokeniser_fertility,
        "op6_harmonic_packing": op6_harmonic_packing,
        "op7_paragraph_minhash": op7_paragraph_minhash,
        "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
        "op9_pivotal_mixing": op9_pivotal_mixing,
        "op10_line_templates": op10_line_templates,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_quantised_vectors": op13_quantised_vectors,
    }


def oracle_sql():
    return {"op2_ngram_jaccard": jaccard.SQL, "op10_line_templates": linededup.SQL, "op11_fill_in_middle": infilling.SQL}
