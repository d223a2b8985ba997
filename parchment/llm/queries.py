"""One query per corpus operator: whole tables, production parameters, the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_lm import scored
from .common import crc_mod, table
from .minhash_dedup import near_duplicates
from .permutation_index import nearest
from .pii_rules import report
from .quality_qda import classified
from .sentence_pieces import round_trips
from .suffix_dedup import deduplicated
from .tiling_decontamination import leaks
from .url_rules import judged
from .warc_normaliser import round_trip


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest embeddings of every one whose id is divisible by 50, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels of those whose crc32 mod 5 is not 0."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, normalised, and read back through the indexes."""
    return round_trip(table(spark, sf_dir, "pages"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents over distinct 4-word shingles at 80 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items whose words its passages cover by half or more."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judged(table(spark, sf_dir, "pages"))


def op7_pii_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text of documents."""
    return report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that remain when every later occurrence of a 20-word window is removed."""
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from those whose crc32 mod 7 is not 2."""
    return scored(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded to pieces and decoded again, as digests."""
    return round_trips(table(spark, sf_dir, "documents"))


def url_stated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op6_url_rules: host, path and stated rule, and the verdict where a stated rule fits."""
    return op6_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op7_pii_rules: the base kinds."""
    return op7_pii_rules(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op9_bloom_lm: the smoothed word model."""
    return op9_bloom_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ten = (op1_permutation_index, op2_quality_qda, op3_warc_normaliser, op4_minhash_dedup, op5_tiling_decontamination, op6_url_rules, op7_pii_rules, op8_suffix_dedup, op9_bloom_lm, op10_sentence_pieces)
    return {f.__name__: f for f in (*ten, url_stated_rules, pii_base_spans, lm_base_scores)}


#: Words of a text and A-Z lower-cased, as the contracts say.
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of an id as text: bytes, each followed by eight steps of the register.
_CRC = """xor(4294967295, list_reduce(flatten([[4294967295]::bigint[], flatten(list_transform(string_split(cast({} as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))]),
  lambda r, x: case when x >= 0 then xor(r, x) when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end))"""

_OP3 = """with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
q as (select *, case when n >= 100 then min(page_id) over (partition by d) else page_id end as head from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when head = page_id then 'response' else 'revisit' end as record_type, case when head <> page_id then head end as refers_to from q"""

_OP4 = f"""with recursive w as (select doc_id, {_WORDS.format(_LOWER.format('text'))} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(g) as n from w left join s using (doc_id) group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as same from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 80 * (x.n + y.n - same)),
reach as (select doc_id as d, doc_id as c from w union select l.b, r.c from reach r join links l on l.a = r.d)
select doc_id, cast(any_value(n) as bigint) as n_shingles, min(c) as component_id, min(c) = doc_id as kept from n join reach on d = doc_id group by doc_id"""

_OP6 = """with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f as (select page_id, arg_max(struct_pack(r := h || r.p, v := v), length(h || r.p)) as best from p join rules r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p) group by page_id)
select page_id, host, path, best.r as rule, best.v as verdict from p left join f using (page_id)"""

_KIND = """{k}_at as (select doc_id, coalesce(text, '') as rest, 0 as pos, '' as m from documents
  union all select doc_id, substr(rest, strpos(rest, m2) + length(m2)), pos + strpos(rest, m2) - 1 + length(m2), m2 from (select *, regexp_extract(rest, '{p}') as m2 from {k}_at) where m2 <> ''),
{k}s as (select doc_id, {i} as kind, '{k}' as name, pos - length(m) as start, pos as stop from (select *, regexp_replace(m, '[^0-9]', '', 'g') as d from {k}_at) where m <> '' and {valid})"""
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(right(x, 3) as int), 999) <= 255))"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(d) between 13 and 19 and list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: case when i % 2 = 1 then try_cast(c as int) else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + try_cast(c as int)] end)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15"),
}
_PARTS = [_KIND.format(k=k, p=p, i=i, valid=v) for i, (k, (p, v)) in enumerate(_KINDS.items())]
_OP7 = f"""with recursive {', '.join(_PARTS)}, s as ({' union all '.join(f'select * from {k}s' for k in _KINDS)})
select doc_id, {', '.join(f"cast(count(*) filter (kind = {i}) as bigint) as n_{k}" for i, k in enumerate(_KINDS))},
  sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' order by kind, start), '')) as base_sha256 from documents left join s using (doc_id) group by doc_id"""

_OP8 = f"""with d as (select doc_id, {_WORDS.format('text')} as w from documents),
words as (select doc_id, unnest(generate_series(1, len(w))) as i, unnest(w) as x from d),
windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d where len(w) >= 20)),
late as (select doc_id, i, true as late from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from windows) where r > 1),
gone as (select doc_id, i, x, max(late) over (partition by doc_id order by i rows between 19 preceding and current row) is not null as gone from words left join late using (doc_id, i))
select doc_id, cast(len(any_value(w)) as bigint) as n_words, cast(count(*) filter (gone) as bigint) as n_removed, sha256(coalesce(string_agg(x, ' ' order by i) filter (not gone), '')) as kept_sha256 from d left join gone using (doc_id) group by doc_id"""

_OP9 = f"""with d as (select doc_id, {_CRC.format('doc_id')} % 7 = 2 as held_out, list_append({_WORDS.format(_LOWER.format('text'))}, '') as w from documents),
t as (select doc_id, held_out, unnest(w) as x from d),
c as (select x, count(*) filter (not held_out) as c from t group by x),
a as (select coalesce(sum(c), 0) as n, count(*) filter (c > 0) as v from c)
select doc_id, held_out, cast(count(*) as bigint) as n_tokens, cast(count(*) filter (c > 0) as bigint) as n_known, cast(any_value(n) as bigint) as train_tokens, round(sum(log10((c + 1) / (n + v + 1.0::double))), 4) as base_score
from t join c using (x), a group by doc_id, held_out"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can state exactly; the others are held against brute force in the tests."""
    return {"op3_warc_normaliser": _OP3, "op4_minhash_dedup": _OP4, "op8_suffix_dedup": _OP8, "url_stated_rules": _OP6, "pii_base_spans": _OP7, "lm_base_scores": _OP9}
