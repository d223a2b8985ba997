"""Text, name and option expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kana, ideographs (extension A, unified, compatibility) and half-width katakana.
CJK = "[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]"


def escaped(text: Column) -> Column:
    """Text for an element."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escaped_attribute(text: Column) -> Column:
    """Text for a quoted attribute."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def without_subset(name: Column) -> Column:
    """A font's base name: a subset tag of up to six characters and its plus sign go."""
    at = F.locate("+", name)
    return F.when((at > 0) & (at <= 7), F.substring(name, at + 1, F.length(name))).otherwise(name)


def face_id(name: Column) -> Column:
    """A CSS family: other characters than letters, digits and - become -."""
    return F.concat(F.lit("pdf-"), F.regexp_replace(without_subset(name), "[^A-Za-z0-9-]", "-"))


def style_of(name: Column) -> tuple[Column, Column, Column]:
    """(bold, italic, mono) from a font's name."""
    low = F.lower(name)
    return low.rlike("bold|black|heavy"), low.rlike("italic|oblique"), low.rlike("courier|mono")


def tolerant_real(text: Column) -> Column:
    """A real number read leniently: minus signs toggle, a second point ends it, no digits are 0."""
    body = F.regexp_replace(text, "^[+-]+", "")
    number = F.regexp_extract(body, r"^([0-9]*\.?[0-9]*)", 1)
    signs = F.length(F.regexp_replace(F.regexp_extract(text, "^([+-]+)", 1), r"\+", ""))
    value = F.coalesce(F.when(number.rlike("[0-9]"), F.concat(F.lit("0"), number).try_cast("double")), F.lit(0.0))
    return F.when(signs % 2 == 1, -value).otherwise(value)


def unhexed(text: Column) -> Column:
    """A hex string's bytes: other characters are skipped, an odd last digit is followed by 0."""
    digits = F.regexp_replace(F.regexp_extract(text, "(?s)^([^>]*)", 1), "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def boolean_of(text: Column) -> Column:
    """'' 0 false no off are false, 1 true yes on are true, others null; letter case does not matter."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low.isin("", "0", "false", "no", "off"), False).when(low.isin("1", "true", "yes", "on"), True)


def selected_pages(selection: Column, n: Column) -> Column:
    """Zero-based pages of a selection such as 1-3,7,9-,-2: split, expanded, clamped to 1..n, distinct, sorted.

    Empty selects all. Null if a part is no range or nothing in it exists.
    """
    parts = F.transform(F.split(selection, ","), lambda p: F.trim(p))
    shape = r"^([0-9]+|[0-9]+-[0-9]*|-[0-9]+)$"

    def pages(part: Column) -> Column:
        low, high = F.regexp_extract(part, "^([0-9]*)", 1), F.regexp_extract(part, "([0-9]*)$", 1)
        a = F.greatest(F.when(low == "", F.lit(1)).otherwise(low.try_cast("int")), F.lit(1))
        b = F.least(F.when(high == "", n).otherwise(high.try_cast("int")), n)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    good = F.forall(parts, lambda p: p.rlike(shape))
    got = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
    got = F.when(F.trim(selection) == "", F.when(n > 0, F.sequence(F.lit(1), n))).when(good & (F.size(got) > 0), got)
    return F.transform(got, lambda p: (p - 1).cast("int"))
