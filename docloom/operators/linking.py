"""Linking of drug names to a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import Scratch

THRESHOLD, MARGIN = 0.82, 0.05
BATCH_THRESHOLD, BATCH_MARGIN = 0.78, 0.04
#: Catalog entries up to which the catalog is sent to all executors.
BROADCAST_ENTRIES = 200_000


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    """drug_database_id, ord, brand_name, strengths (parsed) and one row for each
    alias (brand, generic and other names) with its normal form."""
    names = F.filter(
        F.concat(
            F.array("brand_name"),
            F.coalesce("generic_names", F.array().cast("array<string>")),
            F.coalesce("aliases", F.array().cast("array<string>")),
        ),
        lambda x: F.coalesce(x, F.lit("")) != "",
    )
    rows = catalog.select("drug_database_id", "ord", "brand_name", "strengths", F.posexplode(names).alias("alias_no", "alias"))
    return rows.withColumn("alias_norm", T.normalize_drug_text("alias"))


def prepare_queries(queries: DataFrame) -> DataFrame:
    """query_id with the name to compare, the given strength and whether any."""
    # in steps, so that no long expression stands in another several times
    rows = queries.withColumn("__whole", T.normalize_drug_text(F.coalesce("drug_name", "raw_text"))).where(F.length("__whole") >= 3)
    bare = F.trim(F.regexp_replace("__whole", rf"{T.B}\d+(?:[.,]\d+)?\s*(?:mcg|ug|µg|mg|g|ml){T.B}", ""))
    rows = rows.withColumn("__name", F.coalesce(F.col("drug_name"), bare)).withColumn("__given", F.coalesce("strength", "raw_text"))
    rows = rows.withColumn("name_norm", T.normalize_drug_text("__name")).withColumn("want", T.parse_strength("__given"))
    rows = rows.withColumn("__raw", T.parse_strength("raw_text"))
    given = F.coalesce(F.col("strength") != "", F.lit(False))
    signal = given | (F.col("strength").isNull() & F.col("__raw").isNotNull())
    has_given = (F.coalesce("__given", F.lit("")) != "").alias("has_given")
    return rows.select("query_id", "name_norm", has_given, "want", signal.alias("signal"))


def strength_score(has_given: Column, want: Column, strengths: Column) -> Column:
    """0.5 without one, 0 unreadable, 0.25 none in the catalog, 1 the same, else 0."""
    known = F.filter(
        F.transform(strengths, lambda s: F.struct(s["value"].cast("double").alias("value"), F.lower(s["unit"]).alias("unit"))),
        lambda s: s["value"].isNotNull() & s["unit"].isin("mcg", "ug", "mg", "g", "ml"),
    )
    mg = lambda s: s["value"] * F.coalesce(*[F.when(s["unit"] == u, F.lit(f)) for u, f in T.UNIT_MG.items()])
    same = F.exists(
        known,
        lambda s: F.when(want["comparable_mg"].isNotNull() & mg(s).isNotNull(), want["comparable_mg"] == mg(s)).otherwise(
            (want["value"] == s["value"]) & (want["unit"] == s["unit"])
        ),
    )
    return (
        F.when(~has_given, 0.5)
        .when(want.isNull(), 0.0)
        .when(F.coalesce(F.size(known), F.lit(0)) <= 0, 0.25)
        .when(same, 1.0)
        .otherwise(0.0)
    )


def _edits(least: float, longer: Column) -> Column:
    """The edits that a similarity of ``least`` allows, by the longer one's length."""
    return F.floor((1 - least + 1e-6) * longer).cast("int")


def _parts(least: float, length: Column) -> tuple[Column, Column]:
    """Into how many parts a text of some length is cut, one more than the edits that any partner
    of it may have, and how long the shorter ones are; the last ones have a letter more."""
    n = _edits(least, F.floor(length / least + 1e-6)) + 1
    return n, F.floor(length / n).cast("int")


#: Tasks that names are dealt to before they are compared.
NAME_TASKS = 64


def _dealt(names: DataFrame) -> DataFrame:
    """Names over a fixed number of tasks: they are few bytes but much work, and Spark
    would put small partitions of them together in one task."""
    return names.repartition(NAME_TASKS, "name_norm")


def blocked_pairs(names: DataFrame, aliases: DataFrame, least: float) -> DataFrame:
    """name_norm and alias_norm of all pairs that can be alike by ``least`` (0.5 at
    least), by equal pieces: fewer edits than an alias has parts leave one of them whole, and
    it stands in the name within so many letters of its place. So pairs meet on the
    alias's length, the part's number and its letters; none is left out."""
    if least < 0.5:
        raise ValueError("parts would be empty")
    m, i, shift = F.col("m"), F.col("i"), F.col("shift")
    n, size = _parts(least, m)
    long_from = n - (m - size * n)  # the first of the longer parts
    start, width = i * size + F.greatest(F.lit(0), i - long_from), size + F.when(i >= long_from, 1).otherwise(0)
    right = aliases.where("alias_norm <> ''").select("alias_norm", F.length("alias_norm").alias("m"))
    right = right.select("alias_norm", "m", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    right = right.select("alias_norm", "m", "i", F.col("alias_norm").substr(start + 1, width).alias("piece"))
    size_of = F.length("name_norm")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(size_of * least - 1e-6)).cast("int"), F.floor(size_of / least + 1e-6).cast("int"))
    left = _dealt(names.where("name_norm <> ''")).select("name_norm", F.explode(lengths).alias("m"))
    left = left.join(F.broadcast(right.select("m").distinct()), "m", "left_semi")
    left = left.select("name_norm", "m", _edits(least, F.greatest(size_of, m)).alias("k"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    left = left.select("name_norm", "m", "i", F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("shift"))
    inside = (start + shift >= 0) & (start + shift + width <= size_of)
    left = left.where(inside).select("name_norm", "m", "i", F.col("name_norm").substr(start + shift + 1, width).alias("piece")).distinct()
    return left.join(right, ["m", "i", "piece"]).select("name_norm", "alias_norm").distinct()


def _product(names: DataFrame, aliases: DataFrame, entries: int) -> DataFrame:
    """Every name with every alias, these sent to all executors up to a checked number
    of catalog entries and met in shuffled blocks beyond it."""
    if entries <= BROADCAST_ENTRIES:
        return _dealt(names).join(F.broadcast(aliases))
    blocks = 64
    return names.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(
        aliases.withColumn("block", F.pmod(F.xxhash64("alias_norm"), F.lit(blocks)).cast("int")), "block"
    )


def _scored(q: DataFrame, c: DataFrame, pairs: DataFrame, least: float | None, limit: int | None, columns: list[str]) -> DataFrame:
    """The ``pairs`` of names and aliases as pairs of queries ``q`` and entries of the prepared catalog ``c``."""
    pairs = pairs.withColumn("name_score", T.string_similarity(F.col("name_norm"), F.col("alias_norm")))
    if least is not None:
        pairs = pairs.where(F.col("name_score") >= least - 1e-6)
    if limit is not None:
        # of entries with one alias and strength the first ones in order are the best of each query
        alike = Window.partitionBy("alias_norm", F.to_json("strengths")).orderBy("ord", "drug_database_id")
        once = c.groupBy("alias_norm", "drug_database_id").agg(F.min_by(F.struct("alias_no", "alias", "ord", "brand_name", "strengths"), "alias_no").alias("e"))
        c = once.select("alias_norm", "drug_database_id", "e.*").withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= limit).drop("nth")
    best = pairs.join(c, "alias_norm").groupBy("name_norm", "drug_database_id").agg(
        F.max(F.struct("name_score", (-F.col("alias_no")).alias("o"), "alias", "ord", "brand_name", "strengths")).alias("best")
    )
    if limit is not None:
        alike = Window.partitionBy("name_norm", "best.name_score", F.to_json("best.strengths")).orderBy("best.ord")
        best = best.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= limit).drop("nth")
    rows = q.join(best, "name_norm")
    part = strength_score(F.col("has_given"), F.col("want"), F.col("best.strengths"))
    name = F.col("best.name_score")
    score = F.when(F.col("signal"), name * 0.8 + part * 0.2).otherwise(name)
    matched = F.filter(
        F.array(F.when(name > 0, F.lit("name")), F.when(F.col("has_given") & (part == 1.0), F.lit("strength"))), lambda x: x.isNotNull()
    )
    return rows.select(
        *columns, "drug_database_id", F.col("best.ord").alias("ord"), F.col("best.brand_name").alias("brand_name"),
        F.round(score, 6).alias("score"), F.col("best.alias").alias("matched_alias"), matched.alias("matched_on"),
    )


def score_candidates(queries: DataFrame, catalog: DataFrame, least_name: float | None = None, limit: int | None = None) -> DataFrame:
    """Every query (name_norm, has_given, want, signal and keys of its own) with
    every entry: adds drug_database_id, ord, brand_name, score (6 places),
    matched_alias and matched_on.

    Equal names and equal aliases are compared once. From a ``least_name`` of 0.5 on
    names meet only aliases that can be so similar (``blocked_pairs``); a smaller
    one, or none, compares all. With ``limit``, of entries with one alias (and then of one name score) and
    the same strengths only so many are scored, first ones in order: others cannot
    be among a query's best.
    """
    c = prepare_catalog(catalog)
    names, aliases = queries.select("name_norm").distinct(), c.select("alias_norm").distinct()
    if least_name is not None and least_name >= 0.5:
        pairs = blocked_pairs(names, aliases, least_name)
    else:
        pairs = _product(names, aliases, catalog.limit(BROADCAST_ENTRIES + 1).count())
    return _scored(queries, c, pairs, least_name, limit, queries.columns)


#: Name similarity of the pairs that are scored first where all entries count.
NEAR = 0.5


def top_candidates(queries: DataFrame, catalog: DataFrame, limit: int = 5, least_name: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The ``limit`` best entries of each query, ties in catalog order, with rank.
    Queries of the same name and strength are ranked once. Without ``least_name``,
    names meet near aliases first; an entry of another alias scores less than 0.8 * ``NEAR`` + 0.2, so
    only queries without ``limit`` entries above that are compared with all."""
    scratch = scratch or Scratch(queries.sparkSession, "linking")
    kind = F.to_json(F.struct("name_norm", "has_given", "want", "signal"))
    asked = scratch.keep(prepare_queries(queries).withColumn("kind", kind), "asked")
    kinds = asked.drop("query_id").dropDuplicates(["kind"])
    c = scratch.keep(prepare_catalog(catalog), "catalog")
    aliases = c.select("alias_norm").distinct()
    by = Window.partitionBy("kind").orderBy(F.desc("score"), "ord")

    def best(of: DataFrame, pairs: DataFrame, least: float | None) -> DataFrame:
        scored = _scored(of, c, pairs, least, limit, of.columns)
        return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)

    near = NEAR if least_name is None or least_name < NEAR else least_name
    top = best(kinds, blocked_pairs(kinds.select("name_norm").distinct(), aliases, near), near)
    if near != least_name:
        top = scratch.keep(top, "near")
        sure = top.where((F.col("rank") == limit) & (F.col("score") > 0.8 * NEAR + 0.2 + 1e-5)).select("kind")
        rest = scratch.keep(kinds.join(sure, "kind", "left_anti"), "rest")
        far = _product(rest.select("name_norm").distinct(), aliases, catalog.limit(BROADCAST_ENTRIES + 1).count())
        top = top.join(sure, "kind", "left_semi").unionByName(best(rest, far, least_name))
    top = top.drop("name_norm", "has_given", "want", "signal")
    return asked.select("query_id", "kind").join(top, "kind").drop("kind")


def least_name_similarity(threshold: float, margin: float) -> float:
    """The name similarity below which no entry can change a decision."""
    return max(0.0, min(threshold - margin, (threshold - margin - 0.2) / 0.8))


def link_drugs(
    queries: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, pruned: bool = True
) -> DataFrame:
    """query_id, status (linked, needs_review, not_found), drug_database_id,
    normalized_name, confidence and reason, one row for each query."""
    least = least_name_similarity(threshold, margin) if pruned else None
    top = top_candidates(queries, catalog, 2, least)
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    two = top.groupBy("query_id").agg(
        at(1, "score").alias("first"), at(2, "score").alias("second"), at(1, "drug_database_id").alias("id"), at(1, "brand_name").alias("name")
    )
    low = F.col("first").isNull() | (F.col("first") < threshold)
    near = F.coalesce(F.col("first") - F.col("second") < margin, F.lit(False))
    status = F.when(low, "not_found").when(near, "needs_review").otherwise("linked")
    linked = status == "linked"
    return (
        queries.select("query_id").distinct().join(two, "query_id", "left").select(
            "query_id",
            status.alias("status"),
            F.when(linked, F.col("id")).alias("drug_database_id"),
            F.when(linked, F.col("name")).alias("normalized_name"),
            F.when(linked, F.col("first")).alias("confidence"),
            F.when(status == "needs_review", F.lit("multiple_candidates")).alias("reason"),
        )
    )


def linking_evaluation(gold: DataFrame, lines: DataFrame) -> DataFrame:
    """Scores of linked lines (sample_id, ord, name, status) against gold drugs
    (sample_id, ord, name): the first unused equal name of a sample is the match,
    and only linked lines use one."""
    by = Window.partitionBy("sample_id", "name").orderBy("ord")
    g = gold.withColumn("n", F.row_number().over(by)).select("sample_id", "name", "n", F.lit(True).alias("hit"))
    linked = lines.where("status = 'linked'").withColumn("n", F.row_number().over(by))
    correct = linked.join(g, ["sample_id", "name", "n"], "left_semi").agg(F.count("*").alias("correct"))
    counts = lines.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("linked", "needs_review", "not_found")])
    total = gold.agg(F.count("*").alias("gold"))
    p = F.when(F.col("linked") == 0, 0.0).otherwise(F.col("correct") / F.col("linked"))
    r = F.when(F.col("gold") == 0, 0.0).otherwise(F.col("correct") / F.col("gold"))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.join(correct).join(total).select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def candidate_dictionary(words: DataFrame) -> DataFrame:
    """Drug names of words (sample_id, ord, text), normalised names of 3
    characters at least: id, normalized_name, brand_name (first), occurrences,
    sample_count, raw_texts and strengths in order of first sight."""
    split = words.withColumn("d", T.split_drug_name("text")).withColumn("normalized_name", T.normalize_drug_text("d.drug_name"))
    split = split.where(F.length("normalized_name") >= 3)
    once = lambda c: F.transform(F.array_sort(F.collect_set(c)), lambda x: x["v"])
    first_text = split.groupBy("normalized_name", "text").agg(F.min("ord").alias("o")).groupBy("normalized_name")
    texts = first_text.agg(once(F.struct(F.col("o"), F.col("text").alias("v"))).alias("raw_texts"))
    parsed = split.select("normalized_name", "ord", F.explode("d.strengths").alias("s")).withColumn("p", T.parse_strength("s")).where("p IS NOT NULL")
    parsed = parsed.groupBy("normalized_name", "p.value", "p.unit").agg(F.min("ord").alias("o"))
    strengths = parsed.groupBy("normalized_name").agg(once(F.struct("o", F.struct("value", "unit").alias("v"))).alias("strengths"))
    main = split.groupBy("normalized_name").agg(
        F.count("*").alias("occurrences"), F.countDistinct("sample_id").alias("sample_count"), F.min_by("d.drug_name", "ord").alias("brand_name")
    )
    identity = F.concat(F.lit("local-"), F.substring(F.sha1("normalized_name"), 1, 12))
    rows = main.join(texts, "normalized_name").join(strengths, "normalized_name", "left")
    return rows.withColumn("drug_database_id", identity)


def upsert(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """The catalog with each id's last entry, in the place of its first. ``ord``
    of the entries follows the catalog's."""
    every = catalog.unionByName(entries)
    by = Window.partitionBy("drug_database_id")
    last = every.withColumn("n", F.row_number().over(by.orderBy(F.desc("ord")))).withColumn("at", F.min("ord").over(by))
    return last.where("n = 1").withColumn("ord", F.col("at")).drop("n", "at")

