"""Toxicity by a classifier with counterfactual regularisation."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.textops import batches, hash_words
from docloom.session import Scratch, prepare

#: Bounds of the labelled sample and of the vocabulary.
SAMPLE_ROWS, TERMS, MIN_DOCS = 20_000, 4096, 5
#: Weight of squared score changes under a swap, ridge and steps of the fit.
SWAP_PENALTY, RIDGE, STEPS = 1.0, 2e-4, 400

#: Identity terms that are swapped within their group, in English, German, French
#: and Spanish (fixed values).
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("immigrants", "natives"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("schwarze", "weiße"),
    ("muslime", "juden", "christen", "hindus"), ("ausländer", "einheimische"), ("schwule", "lesben"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("noirs", "blancs", "arabes"),
    ("musulmans", "juifs", "chrétiens"), ("immigrés", "natifs"), ("homosexuels", "lesbiennes"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("negros", "blancos", "latinos"),
    ("musulmanes", "judíos", "cristianos"), ("inmigrantes", "nativos"), ("homosexuales", "lesbianas"),
)

_SEPARATORS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


#: Beside whole words, their first bytes are terms; a term counts as seen, and
#: again as seen so often.
PREFIXES, LEVELS = (4, 6, 8), (1, 2, 4)


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word of the lower-cased texts, split at ASCII signs
    and white space, and of every prefix."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    hashes, first, _, _ = hash_words(raw, _SEPARATORS, PREFIXES)
    row = np.tile(np.repeat(np.arange(len(texts)), np.diff(first)), len(hashes))
    hashes = hashes.ravel()
    return row[hashes != 0], hashes[hashes != 0]


def _levels(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and level of each term of each row, once for each level."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])[: len(term)])
    count = np.diff(np.append(new, len(term)))
    picked = [(new[count >= n], i) for i, n in enumerate(LEVELS)]
    at = np.concatenate([p for p, _ in picked])
    return row[at], term[at], np.concatenate([np.full(len(p), i) for p, i in picked])


def features(texts: list[str | None], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and index (term, level) of what is seen in the texts of ``terms``."""
    row, h = terms_of(texts)
    if not len(h) or not len(terms):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    row, term, level = _levels(row[hit], at[hit])
    return row, term * len(LEVELS) + level


def swaps(text: str, identity=IDENTITY):
    """The lower-cased text with an identity term replaced by another of its
    group, for each such pair."""
    text = text.lower()
    for group in identity:
        for mine in group:
            if mine in text and (at := re.compile(rf"\b{mine}\b")).search(text):
                for other in group:
                    if other != mine:
                        yield at.sub(other, text)


class Classifier:
    """A logistic model over the terms of a text and how often they are seen."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = terms, weights, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, term = features(texts, self.terms)
        total = np.bincount(row, self.weights[term], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(rows: int, row: np.ndarray, term: np.ndarray, label: np.ndarray, swap_row: np.ndarray, swap_term: np.ndarray,
        swap_sign: np.ndarray, n_swaps: int, n_terms: int, swap_penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the mean log loss, plus the ridge, plus
    ``swap_penalty`` times the mean squared change of the score's logit under the
    counterfactual swaps (given as terms gained, +1, and lost, -1)."""
    w, bias = np.zeros(n_terms), 0.0
    if not rows:
        return w, bias
    m, v = np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[term], minlength=rows) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / rows
        g = np.bincount(term, error[row], minlength=n_terms) + 2 * RIDGE * w
        if n_swaps:
            change = np.bincount(swap_row, w[swap_term] * swap_sign, minlength=n_swaps)
            g += 2 * swap_penalty / n_swaps * np.bincount(swap_term, change[swap_row] * swap_sign, minlength=n_terms)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: int = TERMS, swap_penalty: float = SWAP_PENALTY,
          identity=IDENTITY, scratch: Scratch | None = None) -> Classifier:
    """Fits on about ``rows`` labelled rows at most, those of the least hash of
    doc_id. Its terms are the ``terms`` words and prefixes most unlike by label
    (chi square) among those in at least 5 of the documents, and the identity
    terms. A swap is made in the text itself. Null ids and labels are left out;
    of a doc_id's labels the largest counts, of its texts the one of least hash,
    so that repeated ids make the sample no larger. Without rows all scores are
    0.5."""
    spark = prepare(docs.sparkSession)
    scratch = scratch or Scratch(spark, "toxicity")
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    n = known.count()
    grain = 1 << 30
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < min(grain, int(rows / max(n, 1) * grain)))
    known = scratch.keep(known.orderBy(F.xxhash64("doc_id")).limit(rows), "labels")
    one = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id")
    one = one.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
    sample = scratch.keep(one.select("text", "label"), "sample")

    def distinct(arrow_batches):
        for batch in arrow_batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for some in batches(pairs, lambda p: len(p[0] or ""), 1 << 20):
                row, term, level = _levels(*terms_of([p[0] for p in some]))
                label = np.array([p[1] for p in some])[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term.view(np.int64)), pa.array(level), pa.array(label)], ["term", "level", "label"]
                )

    counts = sample.mapInArrow(distinct, "term long, level long, label double").groupBy("term", "level").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("docs")
    )
    share = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0)), F.count("*")).first()
    expected = F.col("docs") * F.lit(float(share[0]))
    counts = counts.where(F.col("docs") >= MIN_DOCS).withColumn("chi", F.pow(F.col("toxic") - expected, 2) / (expected + 1e-9))
    best = counts.groupBy("term").agg(F.max("chi").alias("chi")).orderBy(F.desc("chi"), "term").limit(terms).select("term").collect()
    named = terms_of([" ".join(g) for g in identity])[1]
    vocabulary = np.unique(np.concatenate([np.array([r["term"] for r in best], dtype=np.int64).view(np.uint64), named]))
    sent = spark.sparkContext.broadcast(vocabulary)

    def examples(arrow_batches):
        own = sent.value
        for batch in arrow_batches:
            texts = batch.column(0).to_pylist()
            out = []
            for text, label in zip(texts, batch.column(1).to_pylist()):
                mine = features([text], own)[1]
                out.append((label, mine.tolist(), None, None))
                for changed in swaps(text or "", identity):
                    other = features([changed], own)[1]
                    out.append((None, None, np.setdiff1d(other, mine).tolist(), np.setdiff1d(mine, other).tolist()))
            columns = zip(*out) if out else [[]] * 4
            kinds = (pa.float64(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "terms", "gained", "lost"])

    got = sample.mapInArrow(examples, "label double, terms array<long>, gained array<long>, lost array<long>").toPandas()
    is_row = got["label"].notna().to_numpy()
    own, swapped = got[is_row], got[~is_row]
    flat = lambda lists: (
        np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if len(lists) else np.zeros(0, dtype=np.int64),
        np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if len(lists) else np.zeros(0, dtype=np.int64),
    )
    row, term = flat(list(own["terms"]))
    (up_row, up), (down_row, down) = flat(list(swapped["gained"])), flat(list(swapped["lost"]))
    sign = np.concatenate([np.ones(len(up)), -np.ones(len(down))])
    weights, bias = fit(
        len(own), row, term, own["label"].to_numpy(dtype=float), np.concatenate([up_row, down_row]),
        np.concatenate([up, down]), sign, len(swapped), len(vocabulary) * len(LEVELS), swap_penalty,
    )
    return Classifier(vocabulary, weights, bias)


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of each row of
    ``docs`` (doc_id, text). A null text is empty and scores as one; texts of any
    length are scored whole, repeated rows each, an empty table has no rows, and
    other columns are ignored."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(arrow_batches):
        own = sent.value
        for batch in arrow_batches:
            texts = batch.column(1).to_pylist()
            scores = [own.score(some) for some in batches(texts, lambda t: len(t or ""), 1 << 20)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        run, "doc_id long, score double, predicted int"
    )
