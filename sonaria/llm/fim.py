"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar cuts a text into units that cover it. Each is translated to a zero-width boundary:
the places whose neighbours are of two given classes of characters, as a regular expression of a
lookbehind and a lookahead. Spark's ``split`` at such a boundary keeps every character, so units
are joined again without loss; it would give one empty unit for an empty text, which has none,
so empty texts are handled apart. All is DataFrame expressions on one row: nothing is shuffled.

Two places among the units, and the form, come from four groups of digits of a hash of the id.
``psm`` puts the middle last, ``spm`` the suffix first, and ``plain`` leaves the text alone.

Rows: a null text counts as empty; an empty text, and one that contains a mark, stays plain; a null
id hashes as no digits; equal ids cut alike, so repeated rows give equal rows and no ties arise;
very long texts take memory in proportion to the text; an empty table gives an empty result; other
columns pass through ``transform`` unless they bear the name of a new one, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import table

ANY = r"[\s\S]"


@dataclass(frozen=True)
class Grammar:
    """Units by the classes of characters on both sides of a boundary between them."""

    sides: tuple[tuple[str, str], ...]

    @property
    def boundary(self) -> str:
        return "|".join(f"(?<={before})(?={after})" for before, after in self.sides)


def ended_by(last: str) -> Grammar:
    """``[^last]*last|[^last]+``: units that end with a character of the class."""
    return Grammar(((last, ANY),))


def begun_by(first: str) -> Grammar:
    """``first[^first]*|[^first]+``: units that begin with a character of the class."""
    return Grammar(((ANY, first),))


def led_by(run: str, rest: str) -> Grammar:
    """``run+rest*|rest+``: runs of one class, each with what follows it of the other."""
    return Grammar(((rest, run),))


def runs_of(*classes: str) -> Grammar:
    """``a+|b+|...``: runs of classes that exclude one another."""
    return Grammar(tuple((a, b) for a in classes for b in classes if a != b))


#: Lines with their line feed; words with the white space after them; runs of words, spaces and other marks;
#: sentences with their white space, which begin after a mark and white space.
UNITS = {
    "lines": ended_by(r"\n"),
    "words": led_by(r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"),
    "runs": runs_of(r"[\p{L}\p{N}_]", r"[\x20\x09-\x0D]", r"[^\p{L}\p{N}_\x20\x09-\x0D]"),
    "sentences": Grammar(((r"[.!?][\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"),)),
}


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def all(self) -> tuple[str, str, str]:
        return (self.prefix, self.suffix, self.middle)


def units_of(text: Column, unit: str | Grammar = "lines") -> Column:
    """array<string>: the units of ``text`` in order; none for an empty one."""
    grammar = UNITS[unit] if isinstance(unit, str) else unit
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def _number(digits: Column, group: int) -> Column:
    return F.conv(F.substring(digits, 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str | Grammar = "lines", rate: int = 100, spm_rate: int = 50, seed: int = 7, marks: Marks = Marks(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix, middle, suffix (null where plain) and output.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of these with the suffix first.
    """
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__text", text).withColumn("__units", units_of(F.col("__text"), unit)).withColumn("__h", digits)
    rows = rows.withColumn("n", F.size("__units").cast("long"))
    a, b = (F.pmod(_number(F.col("__h"), g), F.col("n") + 1).cast("int") for g in (0, 1))
    plain = (F.col("__text") == "") | (_number(F.col("__h"), 2) % 100 >= rate)
    for mark in marks.all:
        plain = plain | F.contains(F.col("__text"), F.lit(mark))
    form = F.when(plain, "plain").when(_number(F.col("__h"), 3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "__a": F.least(a, b), "__b": F.greatest(a, b)})
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("__units", start, size), ""))
    rows = rows.withColumns({
        "prefix": part(F.lit(1), F.col("__a")), "middle": part(F.col("__a") + 1, F.col("__b") - F.col("__a")), "suffix": part(F.col("__b") + 1, F.col("n").cast("int")),
    })
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in zip(marks.all, ("prefix", "suffix", "middle")))
    output = F.when(F.col("form") == "plain", F.col("__text")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    return rows.withColumn("output", output).drop("__text", "__units", "__h", "__a", "__b")


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that ``transform`` was given, from its output and form."""
    after = lambda text, mark: F.split_part(text, F.lit(mark), F.lit(2))
    before = lambda text, mark: F.split_part(text, F.lit(mark), F.lit(1))
    p, s, m = marks.all
    middle = after(output, m)
    head = before(output, m)
    psm = F.concat(before(after(head, p), s), middle, after(head, s))
    spm = F.concat(after(head, p), middle, before(after(head, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_query(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), g AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
