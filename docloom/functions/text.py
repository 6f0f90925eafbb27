"""Text normalisation and extraction as column builders.

Every function takes and returns a Column and never raises. Unicode
normalisation has no built-in, so it is one Arrow UDF; a text of ASCII alone
passes it by.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Fixed values of the domain: units, their milligrams, and unit words.
UNIT_MG = {"mcg": 0.001, "µg": 0.001, "ug": 0.001, "mg": 1.0, "g": 1000.0}
UNIT_WORDS = {"v": "viên", "vien": "viên", "goi": "gói", "ong": "ống", "thia": "thìa", "nhat": "nhát", "giot": "giọt"}
FREQUENCIES = ("ONCE_DAILY", "TWICE_DAILY", "THREE_TIMES_DAILY", "DAILY", "WEEKLY", "EVERY_OTHER_DAY", "AS_NEEDED")
TIMES_PER_DAY = {"ONCE_DAILY": 1, "TWICE_DAILY": 2, "THREE_TIMES_DAILY": 3, "DAILY": 1}

#: A word boundary between ASCII words only.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
UNICODE_B = r"\b"
#: White space with the no-break and other Unicode blanks.
WS = r"[\s   -     　﻿]"
# Fixed value: what a strength looks like.
STRENGTH = rf"\d+(?:[.,]\d+)?{WS}*(?:mcg|µg|ug|mg|g|ml)"
_COMBINING = re.compile("[̀-ͯ]")


def _text(col) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _arrow(f):
    """``f`` of texts, as a UDF; a batch of ASCII texts comes back as it is."""

    def run(values: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(values)).as_py() is not False:
            return values
        return pa.array([v if v is None or v.isascii() else f(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())


_nfkc = _arrow(lambda v: unicodedata.normalize("NFKC", v))
_nfc = _arrow(lambda v: unicodedata.normalize("NFC", v))
_combining_stripped = _arrow(lambda v: _COMBINING.sub("", unicodedata.normalize("NFD", v)))
_marks_stripped = _arrow(lambda v: "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c)[0] != "M"))
_nonspacing_stripped = _arrow(lambda v: "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn"))


def nfkc(col) -> Column:
    return _nfkc(_text(col))


def strip_combining(col) -> Column:
    """Decomposed, without U+0300 to U+036F; đ is kept."""
    return _combining_stripped(_text(col))


def collapse(col) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_text(col), rf"{WS}+", " "))


def clean_text(col) -> Column:
    """Trimmed; null is empty."""
    return F.regexp_replace(_text(col), rf"^{WS}+|{WS}+$", "")


def normalize_key(col) -> Column:
    return F.regexp_replace(F.lower(strip_combining(col)), rf"(?:{WS}|[_\-./])+", "")


def strip_vietnamese_marks(col) -> Column:
    """đ as d, and no marks at all."""
    return _marks_stripped(F.translate(_text(col), "đĐ", "dD"))


def _drug_base(col) -> Column:
    return F.regexp_replace(strip_vietnamese_marks(F.lower(nfkc(col))), rf"(?:rng|mng){B}", "mg")


def normalize_drug_text(col) -> Column:
    spaced = F.regexp_replace(_drug_base(col), rf"(\d){WS}*(mg|mcg|ug|µg|g|ml){B}", "$1 $2")
    return F.trim(F.regexp_replace(spaced, "[^a-z0-9µ]+", " "))


def normalize_ocr_text(col) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_combining(col)), "[^a-z0-9]+", " "))


def normalize_comparable_text(col) -> Column:
    return F.translate(strip_combining(F.lower(clean_text(col))), "đ", "d")


def normalize_eval_text(col, remove_diacritics: bool = False) -> Column:
    """For OCR scores: composed, collapsed and lower case; đ is kept."""
    text = F.lower(collapse(_nfc(_text(col))))
    return strip_combining(text) if remove_diacritics else text


def normalize_eval_text_plain(col, remove_diacritics: bool = False) -> Column:
    """As the one above without composing; all non-spacing marks go."""
    text = F.lower(collapse(col))
    return _nonspacing_stripped(text) if remove_diacritics else text


def string_similarity(a: Column, b: Column) -> Column:
    """1 less the edits for each character of the longer; of normalised texts."""
    longer = F.greatest(F.length(a), F.length(b))
    near = F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longer)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(near)


def character_error_rate(reference: Column, prediction: Column) -> Column:
    """Edits for each reference character, of normalised texts."""
    empty = F.when(F.length(prediction) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, prediction) / F.length(reference))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def wer_legacy(reference: Column, prediction: Column) -> Column:
    """Character edits of the joined words for each reference word."""
    gold, said = _words(reference), _words(prediction)
    empty = F.when(F.size(said) == 0, 0.0).otherwise(1.0)
    edits = F.levenshtein(F.array_join(gold, "\u0001"), F.array_join(said, "\u0001"))
    return F.when(F.size(gold) == 0, empty).otherwise(edits / F.size(gold))


@F.pandas_udf(LongType())
def _word_edits(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(reference, prediction):
        if a is None or b is None:
            out.append(None)
            continue
        code: dict[str, int] = {}
        x, y = (np.array([code.setdefault(w, len(code)) for w in t.split(" ") if w], dtype=np.int64) for t in (a, b))
        place = np.arange(len(y) + 1)
        row = place.copy()
        for i, w in enumerate(x.tolist(), 1):
            best = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (y != w)))
            row = np.minimum.accumulate(best - place) + place
        out.append(int(row[-1]))
    return pd.Series(out, dtype="Int64")


def word_edits(reference: Column, prediction: Column) -> Column:
    """Edits of words, of any number of them, a row of the table at a time."""
    return _word_edits(reference, prediction)


def word_count(text: Column) -> Column:
    return F.size(_words(text)).cast("long")


def parse_strength(col) -> Column:
    """struct(value, unit, comparable_mg), null without a number and unit. The
    micro sign becomes a Greek letter under NFKC, which is no unit here."""
    pattern = rf"(\d+(?:[.,]\d+)?)\s*(mcg|ug|µg|mg|g|ml){B}"

    def found(text: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").cast("double")
        return F.when(F.regexp_extract(text, pattern, 2) != "", F.struct(value.alias("value"), F.regexp_extract(text, pattern, 2).alias("unit")))

    def known(s: Column) -> Column:
        factor = F.coalesce(*[F.when(s["unit"] == u, F.lit(f)) for u, f in UNIT_MG.items()])
        return F.when(s.isNotNull(), F.struct(s["value"].alias("value"), s["unit"].alias("unit"), (s["value"] * factor).alias("comparable_mg")))

    return let(let(F.regexp_replace(_drug_base(col), rf"{WS}+", " "), found), known)


def split_drug_name(col) -> Column:
    """struct(raw_text, drug_name, strengths) of a line of a prescription."""
    raw = clean_text(nfkc(col))
    text = clean_text(F.regexp_replace(raw, rf"^{WS}*\d+{WS}*[).:-]{WS}*", ""))
    pattern = rf"(?iu){STRENGTH}{B}"
    strengths = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), collapse)
    name = collapse(F.regexp_replace(F.regexp_replace(text, pattern, " "), rf"[+,:;/-]+{WS}*$", ""))
    return F.struct(raw.alias("raw_text"), F.when(name != "", name).otherwise(text).alias("drug_name"), strengths.alias("strengths"))


def normalize_unit(col) -> Column:
    text = F.lower(nfkc(col))
    return F.coalesce(*[F.when(text == a, F.lit(b)) for a, b in UNIT_WORDS.items()], text)


# The patterns of the following functions, up to the dates, are fixed values of the domain.
def parse_quantity(col) -> Column:
    """struct(value, unit, text) of ``SL: n unit``, else null."""
    pattern = rf"(?iu){B}SL{WS}*:{WS}*(\d+(?:[.,]\d+)?){WS}*([^,;]+)"
    found = F.regexp_extract(_text(col), pattern, 0)
    value = F.regexp_replace(F.regexp_extract(_text(col), pattern, 1), ",", ".").cast("double")
    unit = normalize_unit(clean_text(F.regexp_extract(_text(col), pattern, 2)))
    return F.when(found != "", F.struct(value.alias("value"), unit.alias("unit"), found.alias("text")))


def _first(col, pattern: str, group: int) -> Column:
    return let(F.regexp_extract(_text(col), pattern, group), lambda found: F.when(found != "", found))


def timing(col, boundary: str = B) -> Column:
    """The first time of day; an accented letter at an end hides it unless the
    boundary is Unicode's."""
    return _first(col, rf"(?iu){boundary}(sáng|trưa|chiều|tối|đêm|sang|trua|chieu|toi|dem){boundary}", 1)


def dose(col, boundary: str = B) -> Column:
    """The first dose, with the unit's accents."""
    units = "viên|vien|v|gói|goi|ống|ong|ml|mg|g|thìa|thia|nhát|nhat|giọt|giot"
    pattern = rf"(?iu){boundary}(\d+(?:[.,]\d+)?){WS}*({units}){boundary}"
    return F.concat(_first(col, pattern, 1), F.lit(" "), normalize_unit(F.regexp_extract(_text(col), pattern, 2)))


def meal_timing(col) -> Column:
    return _first(col, rf"(?iu)(uống{WS}+(?:sau|trước){WS}+khi{WS}+ăn)", 1)


_NUMBERED = rf"^{WS}*(\d{{1,3}}){WS}*[).:-]{WS}*(.+)$"


def is_medicine(line) -> Column:
    """Whether ``parse_medicine`` finds one."""
    return _text(line).rlike(_NUMBERED)


def parse_medicine(line, number) -> Column:
    """struct(order, name, strength, quantity, unit, raw, source_line) of a
    numbered line, else null. A % never ends a strength at a text's end."""
    units, word = "mg|g|ml|mcg|µg|%", "[A-Za-z0-9_]"
    # B where a letter or a digit follows is that no word ends here
    sl = rf"(?iu)^(.*?)(?<!{word})SL{WS}*:{WS}*([\d.,]+){WS}*([^\d\s,;]+).*$"
    one = rf"(?iu)(?=\d)(?<!{word})(\d+(?:[.,]\d+)?{WS}*(?:{units})){B}"
    tail = rf"(?iu){WS}+\d+(?:[.,]\d+)?{WS}*(?:{units}){WS}*$"

    # each part is computed once, from the ones before it; a collapsed text has no line ends
    def parts(raw: Column, cut: Column, has: Column, before: Column, strength: Column) -> Column:
        name = F.when(strength != "", F.regexp_replace(before, tail, "")).otherwise(before)
        return F.struct(
            F.regexp_extract(_text(line), rf"^{WS}*(\d{{1,3}})", 1).cast("long").alias("order"),
            let(name, lambda n: F.when(n != "", n).otherwise(before)).alias("name"),
            F.when(strength != "", strength).alias("strength"),
            F.when(has, F.split_part(cut, F.lit("\n"), F.lit(3))).alias("quantity"),
            F.when(has, F.split_part(cut, F.lit("\n"), F.lit(4))).alias("unit"),
            raw.alias("raw"),
            number.cast("long").alias("source_line"),
        )

    def strength(before: Column) -> Column:
        found = F.regexp_extract_all(before, F.lit(one), F.lit(1))
        return F.array_join(F.transform(found, lambda x: F.regexp_replace(x, rf"^(\d+(?:[.,]\d+)?){WS}*", "$1 ")), " ")

    def of(raw: Column, cut: Column) -> Column:
        has = F.startswith(cut, F.lit("\n"))
        before = F.when(has, F.trim(F.split_part(cut, F.lit("\n"), F.lit(2)))).otherwise(raw)
        return let(before, lambda b: let(strength(b), lambda s: parts(raw, cut, has, b, s)))

    known = lambda raw: let(F.regexp_replace(raw, sl, "\n$1\n$2\n$3"), lambda cut: of(raw, cut))
    return let(F.regexp_extract(_text(line), _NUMBERED, 2), lambda found: F.when(found != "", let(collapse(found), known)))


def is_diagnosis(line) -> Column:
    return _text(line).rlike(r"(?iu)(chẩn đoán|cận lâm sàng|bệnh lý|diagnos|i10|g\d{2})")


def line_date(line) -> Column:
    return _first(line, rf"(?iu){B}(?:ngày{WS}*)?(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}){B}", 1)


def frequency_from_text(col) -> Column:
    """The first rule that holds; digits are not anchored, so 12 lan is twice."""
    text = normalize_comparable_text(col)
    # Fixed values, in order.
    rules = (
        ("AS_NEEDED", "as needed|prn|khi can|khi co nhu cau"),
        ("EVERY_OTHER_DAY", "every other day|cach ngay|moi hai ngay"),
        ("WEEKLY", "weekly|moi tuan|hang tuan"),
        ("THREE_TIMES_DAILY", r"(3|ba)\s*(lan|times)|three times"),
        ("TWICE_DAILY", r"(2|hai)\s*(lan|times)|twice|sang.*toi|toi.*sang"),
        ("ONCE_DAILY", r"once daily|1\s*(lan|time)\s*(/|moi|per)?\s*(ngay|day)|mot lan moi ngay"),
        ("DAILY", "daily|moi ngay|hang ngay"),
    )
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules])


def frequency_warning(col) -> Column:
    """Whether a count stands right after another digit."""
    return normalize_comparable_text(col).rlike(r"\d[123]\s*(lan|times)")


def normalize_frequency(frequency, source) -> Column:
    raw = clean_text(frequency)
    given = clean_text(source)
    kept = F.when(given != "", given).when(raw != "", raw)
    known = raw.isin(*FREQUENCIES)
    found = F.when(known, raw).otherwise(frequency_from_text(kept))
    return F.struct(found.alias("frequency"), kept.alias("frequency_source"), found.isNotNull().alias("recognized"))


def default_times_per_day(frequency: Column) -> Column:
    return F.coalesce(*[F.when(frequency == k, F.lit(v)) for k, v in TIMES_PER_DAY.items()])


# What UTF-8 read as a single-byte encoding shows.
MOJIBAKE = ("Ã", "Â", "áº", "á»", "Ä", "Æ", "Å", "\ufffd")


_CONTROL = re.compile("[\x80-\x9f]")


def _decodings(text: str):
    yield text
    for encoding in ("cp1252", "latin1"):
        raw = text.encode(encoding, "ignore")
        fixed = raw.decode("utf-8", "ignore")
        if fixed.encode() == raw and raw.decode(encoding) == text:
            yield fixed


def _signs(text: str) -> int:
    return sum(map(text.count, MOJIBAKE))


def _repaired(text: str) -> str:
    best = min(_decodings(text), key=_signs)
    if best is text and (_signs(text) or _CONTROL.search(text) or "ï¿½" in text):
        # a text's own Ä is one sign before and after, and U+FFFD none before
        return next((t for t in _decodings(text) if t is not text and _signs(t) - t.count("\ufffd") <= _signs(text)), text)
    return best


_mojibake_less = _arrow(lambda v: min(_decodings(v), key=_signs))
_mojibake_repaired = _arrow(_repaired)


def repair_mojibake(col, own_letters: bool = False) -> Column:
    """The text, or its bytes in a single-byte encoding read as UTF-8 if that leaves
    fewer signs of ``MOJIBAKE``. ``own_letters`` also puts right a text whose only signs
    are letters of its own (Ä shows as one sign before and after): then a whole decoding
    is taken at as many signs, if the text has a sign or a control character."""
    return _mojibake_repaired(col) if own_letters else _mojibake_less(col)


def numeric_signature(col) -> Column:
    """The numbers of a text in order, a comma as a point."""
    found = F.regexp_extract_all(_text(col), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")))
