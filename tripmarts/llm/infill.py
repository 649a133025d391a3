r"""Fill-in-middle: each text becomes prefix, suffix and middle in one of two orders, or stays plain.

regexp_count gives the number n of tokens of a text. Four numbers from a hash of the seed and the id choose two cuts a <= b between tokens and
the form. A pattern of the row's own, `(unit{a})(unit{b-a})(rest)` with possessive groups, then captures the three parts in one match, and the
replacement writes them in the order of the form. Possessive groups match in a loop, not by recursion, and never go back, so long texts cost one
pass and no stack. Everything is a column expression: no shuffle, no Python.

Texts with a marker inside stay plain, so the markers of an output are the only ones, and `restored` cuts it at them.

Null texts are empty and plain; repeated rows give equal rows; a null id hashes as the text 'null'. An empty table gives no rows. Other columns
pass through `infill` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmarts.llm.common import fresh_name

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that change; of 100 of these, those that start with the suffix.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42


def draw(hashed: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")


def parts(output: Column, form: Column) -> Column:
    """(prefix, middle, suffix) of an output; all null if it is plain."""
    cut = F.split(output, "<[PSM]>", -1)
    first = F.when(form == "spm", 2).otherwise(1)
    return F.when(form != "plain", F.struct(F.get(cut, first).alias("prefix"), F.get(cut, F.lit(3)).alias("middle"), F.get(cut, F.lit(3) - first).alias("suffix")))


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an output."""
    p = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(p["prefix"], p["middle"], p["suffix"]))


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "infill", seed: int = SEED, rate: int = RATE,
           suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with a column struct(n, form, output); it takes another name if docs has out_col (always the last column)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))), 256)
    counted = docs.select(row.alias("row"), text.alias("text"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), *[draw(hashed, k).alias(f"h{k + 1}") for k in range(4)])
    marked = F.col("text").rlike("<[PSM]>")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    placed = counted.select("row", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    unit = f"(?:{UNIT})"
    pattern = F.concat(F.lit(rf"(?s)\A((?:{unit}){{"), F.col("a"), F.lit(rf"}}+)((?:{unit}){{"), F.col("b") - F.col("a"), F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    name = fresh_name(docs.columns, out_col)
    made = placed.select("row", F.struct("n", "form", output.alias("output")).alias("made"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("made").alias(name))
