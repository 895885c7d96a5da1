"""Free-text answers to canonical labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinegrid.functions.series import let

#: Line ends that end a line of an answer.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
NUMBER = r"-?\d+(?:\.\d+)?"


def normalise(text: Column) -> Column:
    """Lower case, no asterisks or backticks, single blanks, no white space around, no closing punctuation."""
    plain = F.regexp_replace(F.lower(text), r"[*`]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"[.,;:!?]+$", "")


def last_line(text: Column) -> Column:
    """The last line that is not blank; null if there is none."""
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.try_element_at(lines, F.lit(-1))


def _word(text: Column, choice: str) -> Column:
    from re import escape

    return text.rlike(r"\b" + escape(choice) + r"\b")


def whole_word_match(text: Column, choices: list[str]) -> Column:
    """The longest choice that stands in the text as a whole word, with blanks for underscores too; choices of one length in the given order."""
    out = F.lit(None).cast("string")
    for choice in reversed(sorted(choices, key=lambda c: -len(c))):
        out = F.when(_word(text, choice) | (_word(text, choice.replace("_", " ")) if "_" in choice else F.lit(False)), choice).otherwise(out)
    return out


def exact_match(text: Column, choices: list[str]) -> Column:
    """A choice that is the whole text, or is but for underscores and blanks."""
    same = [F.when(text == c, c) for c in choices]
    alike = [F.when(F.replace(text, F.lit("_"), F.lit(" ")) == c.replace("_", " "), c) for c in choices]
    return F.coalesce(*same, *alike)


def parse_choice(answer: Column, choices: list[str]) -> Column:
    """The choice an answer names: exactly, on its last line, or anywhere; null if blank or none."""

    def choose(s: Column) -> Column:
        text, last = s["text"], s["last"]
        return F.when(text != "", F.coalesce(exact_match(text, choices), exact_match(last, choices), whole_word_match(last, choices), whole_word_match(text, choices)))

    return let(F.struct(normalise(answer).alias("text"), normalise(last_line(answer)).alias("last")), choose)


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({NUMBER})", 1), F.lit(""))


def fixed(number: Column, decimals: int) -> Column:
    """A double with so many decimals, as printf does: the exact binary value is rounded, a tie to the even digit; nan, inf, and null for null.

    format_string rounds the shortest decimal text half up (1.005 to 1.01). format_number rounds the binary value, but writes zeros where that
    text ends, so it gets the part after the point alone. Whole parts from 2^63 up have the digits of that text.
    """

    def written(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size)
        part = F.call_function("format_number", size - whole.cast("double"), F.lit("0." + "0" * decimals))
        digits = F.concat((whole + F.left(part, F.lit(1)).cast("long")).cast("string"), F.substring(part, 2, decimals + 1)) if decimals else F.bround(size).cast("long").cast("string")
        near = F.concat(F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise(""), digits)
        odd = F.when(F.isnan(v), "nan").when(size == float("inf"), F.when(v > 0, "inf").otherwise("-inf"))
        return F.when(v.isNotNull(), F.coalesce(odd, F.when(size < 2.0**63, near), F.format_string(f"%.{decimals}f", v)))

    return let(number.cast("double"), written)


def short_number(value: Column) -> Column:
    """Six significant digits without closing zeros, an exponent outside 1e-4 to 1e6; the text itself if it is no number."""
    number = value.try_cast("double")
    rounded = F.lower(F.call_function("format_number", number, F.lit("0.00000E0")))
    mantissa, exponent = F.split_part(rounded, F.lit("e"), F.lit(1)), F.split_part(rounded, F.lit("e"), F.lit(2)).try_cast("int")
    bare = F.regexp_replace(F.regexp_replace(mantissa, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded.try_cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    wide = F.concat(bare, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(exponent.isNull(), value).when((exponent < -4) | (exponent >= 6), wide).otherwise(plain)


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def grouped_answers(text: Column, n: int) -> Column:
    """Answers of n numbered questions: lines such as `A2: yes`; the last of a number counts, others are empty."""
    lines = F.transform(F.split(text, LINE_ENDS), lambda x: F.struct(F.regexp_extract(x, r"^\s*[Aa]?(\d+)[.):]\s*(.+)$", 1).alias("k"), F.trim(F.regexp_extract(x, r"^\s*[Aa]?(\d+)[.):]\s*(.+)$", 2)).alias("a")))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at(F.filter(lines, lambda x: x["k"].try_cast("int") == i), F.lit(-1))["a"], F.lit("")))


def model_name(stem: Column) -> Column:
    return F.regexp_replace(stem, "(_answers|_eval)$", "")


def clip_parts(clip_id: Column) -> Column:
    """scene, behaviour, window of an id scene__behaviour__wN."""
    part = F.split(clip_id, "__")
    return F.struct(F.try_element_at(part, F.lit(1)).alias("scene"), F.try_element_at(part, F.lit(2)).alias("behaviour"), F.regexp_replace(F.try_element_at(part, F.lit(3)), "^w", "").try_cast("int").alias("window"))


def source_of(clip_id: Column) -> Column:
    """Ids that begin with clip_ come from the real set, all others from the simulated one."""
    return F.when(clip_id.startswith("clip_"), "nuscenes").otherwise("carla")
