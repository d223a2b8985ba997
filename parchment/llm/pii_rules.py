"""Personal data by regular expressions, checksums and context, with built-in expressions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm them, and words before a span
raise its score. Base kinds (email, ip, card, phone) are those whose pattern and check hold, whatever their score;
spans that the method adds (iban, secret, tel) need a score of at least `LEAST_SCORE`, and none overlaps a base span.

Scale: everything is a projection of one row: no shuffle, no Python, whole-text regular expressions that
advance without going back (possessive), so that long runs of one character class cost linear time.
Offsets are code points: each pattern is matched together with the text before it, and lengths add up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, written so that repeats never give characters back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The length of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA", 23: "TL GI IQ IL OM SO AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MR MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: Kinds that the method adds: International Bank Account Numbers, secrets, national telephone numbers.
MORE = {
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}+",
    "tel": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: What must stand in a text for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
KINDS = ["email", "ip", "card", "phone", "iban", "secret", "tel"]
#: Words within CONTEXT code points before a span that speak for its kind.
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|mobil|telefon|teléfono|téléphone)\b",
    "iban": r"(?i)\b(?:iban|account|konto|cuenta|compte|bank)\b",
    "secret": r"(?i)(?:token|secret|key|password|passwd|pwd|credential|bearer)",
    "tel": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|mobil|telefon|teléfono|téléphone)\b",
}
CONTEXT = 24
BASE_SCORE = {"email": 0.6, "ip": 0.5, "card": 0.1, "phone": 0.5, "iban": 0.4, "secret": 0.3, "tel": 0.3}
CHECKED, IN_CONTEXT, LEAST_SCORE = 0.5, 0.4, 0.6


def _pieces(text: Column, pattern: str) -> Column:
    """Each match together with the text before it, as (gap length, match)."""
    found = F.regexp_extract_all(text, F.lit(f"(?s:.)*?(?:({pattern})|\\z)"), F.lit(0))
    tail = F.regexp_extract_all(text, F.lit(f"(?s:.)*?(?:({pattern})|\\z)"), F.lit(1))
    both = F.arrays_zip(found.alias("w"), tail.alias("m"))
    return F.filter(both, lambda x: x["m"] != "")


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, match) of the leftmost matches that do not overlap."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["w"])
        return F.struct(end.alias("at"), F.concat(acc["got"], F.array(F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("match")))).alias("got"))

    got = F.aggregate(_pieces(text, pattern), start, step, lambda acc: acc["got"])
    return F.transform(got, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn checksum of a string of digits holds."""
    chars = F.split(F.reverse(digits), "")
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """The mod-97 checksum of an account number holds."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10))
    return F.aggregate(F.split(F.array_join(values, ""), ""), F.lit(0), lambda a, d: (a * 10 + d.cast("int")) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(F.when(F.length(digits).between(13, 19), digits).otherwise("0"))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _score(kind: str, span: Column, text: Column) -> Column:
    """A proposed span's score: its kind's, more if a checksum or the words before it speak for it."""
    score = F.lit(BASE_SCORE[kind])
    if kind == "card":  # its checksum held, or it were no span
        score = score + CHECKED
    if kind == "iban":
        score = score + F.when(mod97(span["match"]), CHECKED).otherwise(-1.0)
    if kind == "secret":  # letters and digits mixed
        score = score + F.when(span["match"].rlike("[0-9]") & span["match"].rlike("[A-Za-z]"), 0.0).otherwise(-1.0)
    since = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return score + F.when(F.substring(text, since + 1, span["start"] - since).rlike(WORDS[kind]), IN_CONTEXT).otherwise(0.0)


def _where(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(array, lambda x: test(x))


def _confirmed(kind: str, span: Column) -> Column:
    return _valid(kind, span["match"])


def _supported(kind: str, text: Column, base: Column, span: Column) -> Column:
    return (_score(kind, span, text) >= LEAST_SCORE) & ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def _of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def spans(text: Column) -> Column:
    """All confirmed spans of a text, (kind, start, end, match), by kind as in KINDS, then start; null text has none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    parts = []
    for kind, pattern in PATTERNS.items():
        got = _where(_spans(text, kind, pattern), partial(_confirmed, kind))
        parts.append(F.when(text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]"), got).otherwise(none))
    return F.concat(*parts)


def more_spans(text: Column, base: Column) -> Column:
    """Spans of the added kinds that reach LEAST_SCORE and overlap no base span."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
    parts = []
    for kind, pattern in MORE.items():
        got = _where(_spans(text, kind, pattern), partial(_supported, kind, text, base))
        parts.append(F.when(text.rlike("[0-9]"), got).otherwise(none))
    return F.concat(*parts)


def _joined(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _scores(text: Column, all_spans: Column) -> Column:
    """Scores of spans, comma-joined."""

    def one(x: Column) -> Column:
        out = F.lit(0.0)
        for kind in KINDS:
            out = F.when(x["kind"] == kind, _score(kind, x, text)).otherwise(out)
        return F.round(out, 2).cast("string")

    return F.array_join(F.transform(all_spans, one), ",")


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns base_spans and more_spans in place of any so named; all other columns as they are.

    Each row is judged alone: repeated rows and null ids get their own spans, null and empty texts none.
    """
    text = F.col(f"`{text_col}`")
    return docs.withColumn("base_spans", spans(text)).withColumn("more_spans", more_spans(text, F.col("base_spans")))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans (kind:start:end, end exclusive), scores in the order of spans.

    Null and empty texts have no spans and empty strings for them; repeated rows and null ids are reported each; an
    empty table gives an empty result.
    """
    got = found(docs.select("doc_id", "text"))
    counts = [F.size(_where(F.col("base_spans"), partial(_of_kind, k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return got.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.concat("base_spans", "more_spans")).alias("spans"), _scores(F.coalesce("text", F.lit("")), F.concat("base_spans", "more_spans")).alias("scores"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    got = found(docs, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = F.array_sort(F.transform(F.concat("base_spans", "more_spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size(F.concat("base_spans", "more_spans")) > 0, done).otherwise(F.col(f"`{text_col}`"))
    return got.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
