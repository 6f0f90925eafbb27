"""Fill-in-the-middle examples: texts cut at zero-width borders of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: For each unit grammar, the place between two units: what a unit ends with
#: stands before it, what one begins with behind it, and nothing is consumed.
BORDERS = {
    "line": r"(?<=\n)(?=[\s\S])",  # [^\n]*\n|[^\n]+
    "word": r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])",  # blanks and the word behind them
    "sentence": r"(?<=[.!?\n])(?=[^.!?\n])",  # up to and with the marks that end one
    "char": r"(?<=[\s\S])(?=[\s\S])",
}


def units(text: Column, unit: str) -> Column:
    """The units of a text in order, which joined give the text; none of an empty one."""
    return F.when(text != "", F.split(text, BORDERS[unit], -1)).otherwise(F.array().cast("array<string>"))


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers of a document: the first groups of 8 digits of
    the SHA-256 of the seed, a colon and the id; no id counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of some form was made of, from these two alone. Texts
    that hold a mark stay plain, so the marks are the only ones; none of them begins
    as another ends, so none arises where pieces meet."""
    mark = lambda *names: F.lit("|".join(names))
    # an empty piece first, then the three pieces in the order of the form
    piece = F.split(output, mark(PREFIX, SUFFIX, MIDDLE), -1)
    psm = F.concat(F.get(piece, F.lit(1)), F.get(piece, F.lit(3)), F.get(piece, F.lit(2)))
    spm = F.concat(F.get(piece, F.lit(2)), F.get(piece, F.lit(3)), F.get(piece, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Each document of ``docs`` (doc_id, text) as a fill-in-the-middle example.

    doc_id, text (null as empty), n (units), form, prefix, middle, suffix and output.
    Two draws of the document (``draws``) name the places where the middle begins and
    ends; the third keeps the text plain in 100 - ``rate`` of 100 cases, the fourth
    makes ``spm_rate`` of 100 begin with the suffix. Empty texts and those that hold a
    mark are plain, with null pieces. Every step is a column expression, so rows
    never move; a very long text is one row's value. Equal rows give equal examples,
    rows without an id those of the id null. An empty table gives no rows, other
    columns are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", units(F.col("text"), unit).alias("u"), draws(F.col("doc_id"), seed).alias("d"))
    rows = rows.select("*", F.size("u").cast("long").alias("n"))
    cut = lambda k: F.col("d")[k] % (F.col("n") + 1)
    rows = rows.select("*", F.least(cut(0), cut(1)).cast("int").alias("a"), F.greatest(cut(0), cut(1)).cast("int").alias("b"))
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | held | (F.col("d")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("d")[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"))
    some = lambda first, size: F.when(F.col("form") != "plain", F.array_join(F.slice("u", first, size), ""))
    a, b, n = F.col("a"), F.col("b"), F.col("n").cast("int")
    rows = rows.select(
        "doc_id", "text", "n", "form", some(F.lit(1), a).alias("prefix"), some(a + 1, b - a).alias("middle"), some(b + 1, n - b).alias("suffix")
    )
    psm = F.concat(F.lit(PREFIX), F.col("prefix"), F.lit(SUFFIX), F.col("suffix"), F.lit(MIDDLE), F.col("middle"))
    spm = F.concat(F.lit(SUFFIX), F.col("suffix"), F.lit(PREFIX), F.col("prefix"), F.lit(MIDDLE), F.col("middle"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("*", output.alias("output"))


#: The query's rows: lines, seed 7, no plain ones but by need, half begin with the suffix.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
), d AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS z FROM t
), f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
    WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:], '') AS s FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f"""
