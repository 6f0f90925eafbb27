"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import prepare

UNKNOWN = "und"
#: Bounds of the labelled sample: languages, rows of each, characters of each, and
#: of all together, so that the model stays below some 500 MB with any number of languages.
MAX_LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS, ALL_CHARS = 200, 300, 32_768, 1 << 19
#: A parse begins anew after so many characters, so that a text's blocks are
#: parsed side by side; a block adds one phrase at most.
BLOCK = 1024
#: Columns of the dense table of a language's states.
SYMBOLS = 64


def normalise(text: str) -> np.ndarray:
    """Lower-case code points, every run of others than letters as one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_letters()[codes], codes, 0)
    if len(codes) > 1:
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return codes


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def shared(texts: list[np.ndarray], total: int) -> np.ndarray:
    """The beginnings of ``texts`` (which ``train`` lets begin anywhere), each of the
    same share of ``total`` symbols; what shorter ones leave of theirs goes to the others."""
    sizes, left = sorted(len(t) for t in texts), total
    share = extra = 0
    for i, n in enumerate(sizes):
        share, extra = divmod(left, len(sizes) - i)
        if n > share:
            break
        left -= n
        share, extra = n, 0
    out = []
    for t in texts:
        more = int(len(t) > share and extra > 0)
        out.append(t[: share + more])
        extra -= more
    return np.concatenate(out)


class Model:
    """The automata of all languages. Each has an alphabet of its own, the letters
    of its sample: the commonest are columns of a dense table of states, any others
    are looked up among sorted (state, letter) keys. An entry is twice the row of
    the next state, plus 1 where a phrase ends before the symbol."""

    def __init__(self, texts: dict[str, list[str]], chars: int = SAMPLE_CHARS):
        self.languages = sorted(k for k, v in texts.items() if any(len(normalise(t)) for t in v))
        samples = {k: shared([np.append(normalise(t), 0) for t in texts[k]], chars) for k in self.languages}
        seen = np.unique(np.concatenate([np.zeros(1, dtype=np.uint32), *samples.values()]))
        # a letter of no sample is one past those that are; 0 stays 0
        self.codes = np.zeros(0x110000, dtype=np.int32)
        self.codes[np.flatnonzero(_letters())] = len(seen)
        self.codes[seen] = np.arange(len(seen))
        self.local, self.rare, tables, self.roots, self.bits, at = [], [], [], [], [], 0
        for k in self.languages:
            own, local = self._alphabet(self.codes[samples[k]], len(seen))
            nxt = automaton(local[self.codes[samples[k]]].tolist())
            dead = len(nxt)
            row = lambda state: (state + at) * SYMBOLS * 2  # noqa: E731, B023
            t = np.tile(row(np.array([nxt[0].get(c, dead) for c in range(SYMBOLS)])) + 1, (dead + 1, 1))
            keys, values = [], []
            for state, to in enumerate(nxt):
                for c, into in to.items():
                    if c < SYMBOLS:
                        t[state, c] = row(into)
                    else:
                        keys.append((state + at) * SYMBOLS * own + c)
                        values.append(row(into))
            order = np.argsort(np.array(keys, dtype=np.int64))
            again = np.array([row(nxt[0].get(c, dead)) + 1 for c in range(SYMBOLS, own)], dtype=np.int32)
            self.rare.append((own, np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int32)[order], again))
            self.local.append(local)
            tables.append(t.astype(np.int32))
            self.roots.append(at * SYMBOLS)
            self.bits.append(math.log2(len(samples[k]) + 1))
            at += dead + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)

    @staticmethod
    def _alphabet(sample: np.ndarray, unseen: int) -> tuple[int, np.ndarray]:
        """How many symbols a language has, and its symbol for each code: 0 between
        words, then its letters by frequency, but for the last dense one, which is
        every letter it does not have."""
        letters, counts = np.unique(sample[sample > 0], return_counts=True)
        letters = letters[np.lexsort((letters, -counts))]
        local = np.full(unseen + 1, SYMBOLS - 1, dtype=np.int32)
        local[0] = 0
        symbol = np.arange(1, len(letters) + 1)
        local[letters] = symbol + (symbol >= SYMBOLS - 1)
        return max(SYMBOLS, len(letters) + 2), local

    def _entries(self, language: int, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        own, keys, values, again = self.rare[language]
        if own == SYMBOLS:
            return self.table[at + codes]
        entry = self.table[at + np.minimum(codes, SYMBOLS - 1)]
        rare = np.flatnonzero(codes >= SYMBOLS)
        if len(rare):
            wanted = at[rare].astype(np.int64) * own + codes[rare]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            entry[rare] = np.where(keys[place] == wanted, values[place], again[codes[rare] - SYMBOLS])
        return entry

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (as codes) by each language, block by block."""
        cuts = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), BLOCK)]
        cuts.sort(key=lambda c: -min(BLOCK, len(texts[c[0]]) - c[1]))
        lengths = np.array([min(BLOCK, len(texts[i]) - a) for i, a in cuts], dtype=np.int64)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not len(cuts) or not self.languages:
            return out
        padded = np.zeros((len(cuts), lengths[0]), dtype=np.int32)
        for row, (i, a) in enumerate(cuts):
            padded[row, : lengths[row]] = texts[i][a : a + BLOCK]
        steps = np.ascontiguousarray(padded.T)
        owner = np.array([i for i, _ in cuts])
        width = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for column, root in enumerate(self.roots):
            at = np.full(len(cuts), root, dtype=np.int32)
            ended = np.ones(len(cuts), dtype=np.int32)
            local = self.local[column]
            # the first symbol of a block begins its first phrase and ends none
            first = self._entries(column, at, local[steps[0]]) & 1
            for codes, w in zip(steps, width.tolist()):
                entry = self._entries(column, at[:w], local[codes[:w]])
                ended[:w] += entry & 1
                at[:w] = entry >> 1
            np.add.at(out[:, column], owner, ended - first)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [normalise(t or "") for t in texts]
        known = [i for i, c in enumerate(codes) if c.any()] if self.languages else []
        out = [(UNKNOWN, 0.0)] * len(texts)
        counts = self.phrases([self.codes[codes[i]] for i in known])
        for i, found in zip(known, counts):
            entropy = found * np.array(self.bits) / len(codes[i])
            share = 1 / entropy
            best = int(np.argmin(entropy))
            out[i] = (self.languages[best], float(share[best] / share.sum()))
        return out


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fits automata on a bounded sample of ``labelled`` (doc_id, text, lang): of
    each language about ``rows`` rows, those of the least hash, and of their
    texts together at most ``chars`` characters, in equal shares. A text's share
    begins at a place in it that its hash tells, and goes on from its beginning
    behind its end, so that no part of texts is learnt before others. Rows without
    text or language are left out, equal rows count once, and of an empty table
    the model has no language."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model({})
    chars = min(chars, ALL_CHARS // len(counts))
    grain = 1 << 30
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(grain, math.ceil(2 * rows / r["count"] * grain)))])
    # by the text too, as null ids have no hash of their own; equal rows are one
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(grain))
    first = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text"), F.lit(1))).cast("int")
    turned = F.concat(F.col("text").substr(first + 1, F.lit(chars)), F.lit(" "), F.col("text").substr(F.lit(1), F.least(first, F.lit(chars))))
    sample = (
        labelled.withColumn("place", place)
        .where(F.col("place") < F.element_at(most, F.col("lang")))
        .groupBy("lang", "place")
        .agg(F.min(F.struct("doc_id", F.substring(turned, 1, chars).alias("text"))).alias("one"))
        .select("lang", "place", "one.*")
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["place"], r["doc_id"] or 0, r["text"])):
        if len(texts.setdefault(r["lang"], [])) < rows:
            texts[r["lang"]].append(r["text"])
    return Model(texts, chars)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row of ``docs`` (doc_id, text).

    The language wins whose automaton needs the fewest phrases for the text,
    times the bits of a position in its sample, for each character. A null text,
    or one without letters, is ``und`` with score 0, and so is every text where
    the model has no language. Ties go to the first language in order. Texts of
    any length are parsed whole, in blocks that begin anew (``BLOCK``); repeated
    rows have a row each, an empty table none, and other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(arrow_batches):
        own = sent.value
        for batch in arrow_batches:
            found = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )
