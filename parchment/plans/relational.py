"""Relational operators over the driver's tables: stand-in inputs, the engine's own arithmetic.

Each query's oracle states the same result in SQL. A match shows that the expression is right on these
inputs; the queries of plans.documents run real files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, geometry, text
from .registry import query


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(x, to: int = 6):
    return F.round(x, to) + F.lit(0.0)


@query("""select doc_id, cast(p - 1 as int) as page from (select distinct doc_id, unnest(generate_series(greatest(lo, 1), least(hi, n))) as p from (
  select doc_id, n, unnest([a, b, c]) as lo, unnest([a + 2, b, n]) as hi from (
    select doc_id, 1 + n_chars // 500 as n, 1 + doc_id % 4 as a, 2 + doc_id % 7 as b, 9 as c from documents)) where greatest(lo, 1) <= least(hi, n))""")
def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page selections such as 1-3,4,9- expanded against a page count."""
    d = _t(spark, sf_dir, "documents").withColumn("n", (1 + F.floor(F.col("n_chars") / 500)).cast("int"))
    a, b = 1 + F.col("doc_id") % 4, 2 + F.col("doc_id") % 7
    d = d.withColumn("selection", F.concat(a, F.lit("-"), a + 2, F.lit(", "), b, F.lit(",9-")))
    return d.select("doc_id", F.explode(text.selected_pages(F.col("selection"), F.col("n"))).alias("page"))


@query("""select l_orderkey, l_linenumber, dpi, case when dpi >= 8 and dpi <= 1200 then dpi else null end as accepted,
  case when flag in ('A', 'N') then flag = 'A' else null end as gray from (select l_orderkey, l_linenumber, l_quantity * 30 as dpi, l_returnflag as flag from lineitem)""")
def option_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution limits and booleans of job options."""
    word = F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", " off ").otherwise("maybe")
    dpi = F.col("l_quantity") * 30
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dpi.alias("dpi"), F.when(dpi.between(8, 1200) & ~F.isnan(dpi), dpi).alias("accepted"), text.boolean_of(word).alias("gray"))


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1""")
def xref_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest section's entry of each object wins."""
    newest = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest.alias("e")).select("o_custkey", "e.o_orderkey", "e.o_totalprice")


_TREE = """with recursive edges as (
  select 'r' || r_regionkey as id, 'root' as parent, case when r_regionkey % 2 = 0 then r_name end as box from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, case when n_nationkey % 3 = 0 then n_name end from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, case when c_custkey % 5 = 0 then c_mktsegment end from customer),
tree as (select 'root' as id, cast('' as {s}) as path, 0 as depth, cast('default' as {s}) as box
  union all select e.id, t.path || '/' || e.id, t.depth + 1, coalesce(e.box, t.box) from tree t join edges e on e.parent = t.id where t.depth < 64)
select id, path, cast(depth as int) as depth, box from tree"""


@query(_TREE.format(s="varchar"))
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree flattened with a depth guard; a node without a box inherits its nearest ancestor's."""
    for name in ("region", "nation", "customer"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_TREE.format(s="string"))


@query("""select c_custkey, coalesce(case when c_custkey % 4 = 0 then c_mktsegment end, case when n_nationkey % 2 = 0 then n_name end, r_name, 'none') as resource
  from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def resource_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name looked up innermost first."""
    c, n, r = (_t(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), "r_name", F.lit("none")).alias("resource"))


@query("""select source, bool_or(regexp_matches(t, '[\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff66}-\\x{ff9f}]')) as cjk
  from (select source, case when doc_id % 97 = 0 then text || chr(20320) else text end as t from documents) group by source""")
def cjk_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any page of a document holds Chinese, Japanese or Korean script."""
    d = _t(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("你"))).otherwise(F.col("text"))
    return d.groupBy("source").agg(F.bool_or(text.has_cjk(t)).alias("cjk"))


@query("""select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as body,
  replace(replace(replace(url, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') as href from pages""")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element and attribute escapes."""
    return _t(spark, sf_dir, "pages").select("page_id", text.escaped(F.col("html")).alias("body"), text.escaped_attribute(F.col("url")).alias("href"))


@query("""select p_partkey, case when strpos(n, '+') between 1 and 7 then substr(n, strpos(n, '+') + 1) else n end as base,
  'pdf-' || regexp_replace(case when strpos(n, '+') between 1 and 7 then substr(n, strpos(n, '+') + 1) else n end, '[^A-Za-z0-9-]', '-', 'g') as face
  from (select p_partkey, case when p_partkey % 2 = 0 then 'ABCDEF+' else '' end || p_name as n from part)""")
def face_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font families without their subset tags."""
    p = _t(spark, sf_dir, "part").withColumn("n", F.concat(F.when(F.col("p_partkey") % 2 == 0, "ABCDEF+").otherwise(""), "p_name"))
    return p.select("p_partkey", text.without_subset(F.col("n")).alias("base"), text.face_id(F.col("n")).alias("face"))


@query("""select p_partkey, regexp_matches(n, 'bold|black|heavy') as bold, regexp_matches(n, 'italic|oblique') as italic, regexp_matches(n, 'courier|mono') as mono
  from (select p_partkey, lower(p_name || ['-Bold', '-Oblique', 'Mono', ''][1 + p_partkey % 4]) as n from part)""")
def font_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, slant and pitch told by a font's name."""
    tail = F.element_at(F.array(*map(F.lit, ("-Bold", "-Oblique", "Mono", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    bold, italic, mono = text.style_of(F.concat("p_name", tail))
    return _t(spark, sf_dir, "part").select("p_partkey", bold.alias("bold"), italic.alias("italic"), mono.alias("mono"))


@query("""select conv_id, turn, i, c, round(coalesce(sum(w * 12.0 + 0.5 + case when c = ' ' then 1.0 else 0.0 end) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0.0), 6) as x
  from (select conv_id, turn, cast(i as int) as i, substr(text, i, 1) as c, (300 + ascii(substr(text, i, 1)) % 50 * 10) / 1000.0::double as w
    from (select conv_id, turn, text, unnest(generate_series(1, length(text))) as i from conversations where length(text) > 0))""")
def glyph_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each glyph of a run stands: running sum of width * size + character and word spacing."""
    d = _t(spark, sf_dir, "conversations").where(F.length("text") > 0)
    g = d.select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("k", "c")).where("c != ''").withColumn("i", (F.col("k") + 1).cast("int"))
    step = (300 + F.ascii("c") % 50 * 10) / F.lit(1000.0) * 12.0 + 0.5 + F.when(F.col("c") == " ", 1.0).otherwise(0.0)
    before = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("conv_id", "turn", "i", "c", _r(F.coalesce(F.sum(step).over(before), F.lit(0.0))).alias("x"))


@query("""select n_nationkey, cast(code as int) as code, chr(cast(65 + n_nationkey + code - lo as int)) as unicode
  from (select n_nationkey, n_nationkey * 3 as lo, unnest(generate_series(n_nationkey * 3, n_nationkey * 3 + n_regionkey)) as code from nation)""")
def bfrange_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode ranges expanded to a character for each code."""
    lo = F.col("n_nationkey") * 3
    n = _t(spark, sf_dir, "nation").select("n_nationkey", lo.alias("lo"), F.explode(F.sequence(lo, lo + F.col("n_regionkey"))).alias("code"))
    return n.select("n_nationkey", F.col("code").cast("int"), F.char(65 + F.col("n_nationkey") + F.col("code") - F.col("lo")).alias("unicode"))


@query("""select cid, arg_max(w, s_suppkey) as w from (select s_suppkey, unnest(generate_series(s_suppkey * 2, s_suppkey * 2 + s_nationkey)) as cid, round(s_acctbal / 1000, 6) as w from supplier) group by cid""")
def cid_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width ranges expanded to codes; of overlapping ranges the last wins."""
    first = F.col("s_suppkey") * 2
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(first, first + F.col("s_nationkey"))).alias("cid"), _r(F.col("s_acctbal") / 1000).alias("w"))
    return s.groupBy("cid").agg(F.max_by("w", "s_suppkey").alias("w"))


@query("""select l_orderkey, l_linenumber, round(0.2 + pow(x, 1.7) * 0.7, 6) as power, round(case when x < 0.3 then 0.0 + (x / 0.3) * 0.5 else 0.5 + pow((x - 0.3) / 0.7, 2.0) * 0.5 end, 6) as stitched, round(1 - greatest(x, y), 6) as gray
  from (select l_orderkey, l_linenumber, greatest(0, least(1, l_discount * 10)) as x, greatest(0, least(1, l_tax * 10)) as y from lineitem)""")
def tint_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential and stitched functions, and the gray of a separation colour."""
    x, y = F.col("l_discount") * 10, F.col("l_tax") * 10
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(color.exponential(x, 0.2, 0.9, 1.7)).alias("power"), _r(color.stitched(x, [0.3], [(0.0, 0.5, 1.0), (0.5, 1.0, 2.0)])).alias("stitched"), _r(color.separation_gray([x, y])).alias("gray"))


@query("""select l_orderkey, l_linenumber, round(r, 9) as r, round(g, 9) as g, round(b, 9) as b, round(0.299 * r + 0.587 * g + 0.114 * b, 9) as gray,
  '#' || printf('%02x%02x%02x', cast(floor(r * 255 + 0.5) as int), cast(floor(g * 255 + 0.5) as int), cast(floor(b * 255 + 0.5) as int)) as css from (
  select l_orderkey, l_linenumber, 1 - least(1, c + k) as r, 1 - least(1, m + k) as g, 1 - least(1, y + k) as b from (
  select l_orderkey, l_linenumber, greatest(0, least(1, l_discount * 8)) as c, greatest(0, least(1, l_tax * 9)) as m, greatest(0, least(1, l_quantity / 60)) as y, greatest(0, least(1, l_extendedprice / 200000)) as k from lineitem))""")
def cmyk_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device colours, gray and style-sheet notation."""
    r, g, b = color.rgb_of_cmyk(F.col("l_discount") * 8, F.col("l_tax") * 9, F.col("l_quantity") / 60, F.col("l_extendedprice") / 200000)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(r, 9).alias("r"), _r(g, 9).alias("g"), _r(b, 9).alias("b"), _r(color.gray_of_rgb(r, g, b), 9).alias("gray"), color.css(r, g, b).alias("css"))


@query("""select l_orderkey, l_linenumber, round(a * e, 6) as ma, round(b * h, 6) as mb, round(px, 6) as px, round(py, 6) as py, round(sqrt(abs(a * d - b * c)), 6) as expansion,
  case when abs(a * d - b * c) >= 1e-12 then round(d / (a * d - b * c), 6) end as inv_a, abs(b) < 1e-9 and abs(c) < 1e-9 or abs(a) < 1e-9 and abs(d) < 1e-9 as straight from (
  select *, a * 3 + c * 4 + 7 as px, b * 3 + d * 4 + 9 as py from (select l_orderkey, l_linenumber, l_quantity as a, l_discount * 10 as b, l_tax * 10 as c, l_quantity / 2 as d, 2.0::double as e, 0.5::double as h from lineitem))""")
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, points, size and inverses of matrices."""
    q = F.col("l_quantity")
    m = (q, F.col("l_discount") * 10, F.col("l_tax") * 10, q / 2, F.lit(7.0), F.lit(9.0))
    scale = (F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(0.0))
    both, (px, py) = geometry.concat(m, scale), geometry.point(m, F.lit(3.0), F.lit(4.0))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(both[0]).alias("ma"), _r(both[1]).alias("mb"), _r(px).alias("px"), _r(py).alias("py"), _r(geometry.expansion(m)).alias("expansion"), _r(geometry.inverse(m)[0]).alias("inv_a"), geometry.rectilinear(m).alias("straight"))


@query("""select p_partkey, cast(ceil(case when q % 2 = 1 then h else w end * dpi / 72 - 0.001) as int) as width, cast(ceil(case when q % 2 = 1 then w else h end * dpi / 72 - 0.001) as int) as height
  from (select p_partkey, p_size * 12.0::double as w, p_retailprice / 3 as h, p_partkey % 4 as q, 150.0::double as dpi from part)""")
def page_ctm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a turned page box at a resolution."""
    w, h = geometry.page_size(F.col("p_size") * 12.0, F.col("p_retailprice") / 3, F.col("p_partkey") % 4 * 90, F.lit(150.0))
    return _t(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("""select l_orderkey, l_linenumber, cast(floor(x0) as int) as ox0, cast(ceil(x1) as int) as ox1, greatest(x0, 10.0) as ix0, least(x1, 30.0) as ix1, greatest(x0, 10.0) >= least(x1, 30.0) as empty,
  case when x0 >= x1 then 10.0 else least(x0, 10.0) end as ux0, case when x0 >= x1 then 30.0 else greatest(x1, 30.0) end as ux1
  from (select l_orderkey, l_linenumber, round(l_quantity * 0.73, 6) as x0, round(l_discount * 400, 6) as x1 from lineitem)""")
def rect_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes rounded outward, intersected and united."""
    x0, x1 = _r(F.col("l_quantity") * 0.73), _r(F.col("l_discount") * 400)
    p, q = (x0, F.lit(0.0), x1, F.lit(1.0)), (F.lit(10.0), F.lit(0.0), F.lit(30.0), F.lit(1.0))
    o, i, u = geometry.outer(*p), geometry.intersect(p, q), geometry.union(p, q)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", o[0].alias("ox0"), o[2].alias("ox1"), i[0].alias("ix0"), i[2].alias("ix1"), geometry.empty(i).alias("empty"), u[0].alias("ux0"), u[2].alias("ux1"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 numbers of each embedding as an image of 8 rows of 8 bytes."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "f"))
    v = color.to255((F.col("f").cast("double") + 4) / 8)
    return e.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), v.alias("v"))


_CELLS = """(select vec_id, cast((k - 1) // 8 as int) as y, cast((k - 1) % 8 as int) as x, cast(floor(greatest(0, least(1, (cast(embedding[k] as double) + 4) / 8)) * 255 + 0.5) as int) as v
  from (select vec_id, embedding, unnest(generate_series(1, 64)) as k from embeddings))"""


@query(f"""select vec_id, y, x, ((s * a + 128 + ((s * a + 128) >> 8)) >> 8) + ((d * (255 - a) + 128 + ((d * (255 - a) + 128) >> 8)) >> 8) as v
  from (select vec_id, y, x, v as s, cast(x * 36 as int) as a, cast(y * 30 as int) as d from {_CELLS})""")
def blend_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes composited by coverage."""
    return _cells(spark, sf_dir).select("vec_id", "y", "x", color.over(F.col("v"), F.col("y") * 30, F.col("x") * 36).alias("v"))


@query(f"select vec_id, y, x, cast(floor(greatest(0, least(1, 1 + v * (0.25 - 1) / 255)) * 255 + 0.5) as int) as v from {_CELLS}")
def decode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples mapped by a Decode pair."""
    return _cells(spark, sf_dir).select("vec_id", "y", "x", color.decoded_sample(F.col("v"), 8, 1.0, 0.25).alias("v"))


@query(f"select vec_id, y, x, cast(sum(v) over (partition by vec_id, y order by x) % 256 as int) as v from {_CELLS}")
def predictor_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal differences undone: a running sum modulo 256 in each row."""
    w = Window.partitionBy("vec_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return _cells(spark, sf_dir).select("vec_id", "y", "x", (F.sum("v").over(w) % 256).cast("int").alias("v"))


@query(f"select vec_id, cast(y // 2 as int) as y, cast(x // 2 as int) as x, cast(sum(v) // 4 as int) as v from {_CELLS} group by vec_id, y // 2, x // 2")
def box_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer means of blocks of 2 by 2."""
    by = ["vec_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")]
    return _cells(spark, sf_dir).groupBy(*by).agg(F.expr("cast(sum(v) div 4 as int)").alias("v"))


@query("""select l_suppkey, x, cast(sum(d) over (partition by l_suppkey order by x) as bigint) as coverage from (
  select l_suppkey, x, sum(d) as d from (select l_suppkey, unnest([l_linenumber * 3, l_linenumber * 3 + cast(l_quantity as bigint)]) as x, unnest([1, -1]) as d from lineitem) group by l_suppkey, x)""")
def coverage_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a scan line: span ends added up, then a running sum."""
    start = (F.col("l_linenumber") * 3).cast("long")
    ends = F.array(F.struct(start.alias("x"), F.lit(1).alias("d")), F.struct((start + F.col("l_quantity").cast("long")).alias("x"), F.lit(-1).alias("d")))
    d = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.inline(ends)).groupBy("l_suppkey", "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("l_suppkey").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("l_suppkey", "x", F.sum("d").over(w).alias("coverage"))


@query(f"""select vec_id, case when da * db > 0 then round((8 * ab - a * b) / sqrt(da * db), 6) else 0.0 end as r from (
  select vec_id, a, b, ab, 8 * aa - a * a as da, 8 * bb - b * b as db from (select vec_id, sum(i) as a, sum(j) as b, sum(i * j) as ab, sum(i * i) as aa, sum(j * j) as bb from (
  select vec_id, y, cast(sum(255 - v) as double) as i from {_CELLS} group by vec_id, y) p join (select vec_id, x as y, cast(sum(255 - v) as double) as j from {_CELLS} group by vec_id, x) q using (vec_id, y) group by vec_id))""")
def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the ink of rows and of columns; 0 where one is flat."""
    ink = F.sum(255 - F.col("v")).cast("double")
    rows = _cells(spark, sf_dir).groupBy("vec_id", "y").agg(ink.alias("i"))
    cols = _cells(spark, sf_dir).groupBy("vec_id", F.col("x").alias("y")).agg(ink.alias("j"))
    s = rows.join(cols, ["vec_id", "y"]).groupBy("vec_id").agg(F.sum("i").alias("a"), F.sum("j").alias("b"), F.sum(F.col("i") * F.col("j")).alias("ab"), F.sum(F.col("i") * F.col("i")).alias("aa"), F.sum(F.col("j") * F.col("j")).alias("bb"))
    a, b = F.col("a"), F.col("b")
    spread = (8 * F.col("aa") - a * a) * (8 * F.col("bb") - b * b)
    return s.select("vec_id", F.when(spread > 0, _r((8 * F.col("ab") - a * b) / F.sqrt(spread))).otherwise(0.0).alias("r"))


@query(f"""select p.vec_id, round(avg(abs(p.v - q.v)), 6) as mean_diff, cast(sum(case when abs(p.v - q.v) > 64 then 1 else 0 end) as bigint) as big, min(case when abs(p.v - q.v) > 64 then p.x end) as x0, max(case when abs(p.v - q.v) > 64 then p.x end) as x1
  from {_CELLS} p join {_CELLS} q on q.vec_id = p.vec_id + 1 and p.x = q.x and p.y = q.y group by p.vec_id""")
def image_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of neighbouring images, count and bounds of the large ones."""
    p = _cells(spark, sf_dir)
    q = p.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("v").alias("w"))
    d = p.join(q, ["vec_id", "y", "x"]).withColumn("d", F.abs(F.col("v") - F.col("w")))
    big = F.when(F.col("d") > 64, F.col("x"))
    return d.groupBy("vec_id").agg(_r(F.avg("d")).alias("mean_diff"), F.count(big).alias("big"), F.min(big).alias("x0"), F.max(big).alias("x1"))


@query("""select user_id, done, failed, case when done = 0 then 'failed' when failed > 0 then 'partial' else 'done' end as status from (
  select user_id, cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as done, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as failed from events group by user_id)""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's final status from its pages'."""
    g = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return g.select("*", F.when(F.col("done") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("done").alias("status"))


@query("select event_id from events where event_type in ('purchase', 'error') and ts + interval 1 hour < timestamp '2024-01-15 00:00:00'")
def job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended jobs past their time to live."""
    return _t(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error") & (F.col("ts") + F.expr("interval 1 hour") < F.lit("2024-01-15 00:00:00").cast("timestamp"))).select("event_id")


@query("select conv_id, string_agg('<section>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</section>', chr(10) order by turn) as body, cast(count(text) as bigint) as sections from conversations group by conv_id")
def doc_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a document in order."""
    one = F.concat(F.lit("<section>"), text.escaped(F.col("text")), F.lit("</section>"))
    c = _t(spark, sf_dir, "conversations").where("text is not null")
    rows = F.sort_array(F.collect_list(F.struct("turn", one.alias("s"))))
    return c.groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.array_join("r.s", "\n").alias("body"), F.size("r").cast("long").alias("sections"))


@query("select conv_id, role, arg_min(text, turn) as data, min(turn) as first_turn from conversations group by conv_id, role")
def font_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each family stays."""
    return _t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("data"), F.min("turn").alias("first_turn"))


@query("""select p_partkey, round(case when neg % 2 = 1 then -v else v end, 6) as v from (select p_partkey, p_partkey % 4 as neg, cast(cast(floor(p_retailprice) as bigint) || '.' || p_size as double) as v from part)""")
def tolerant_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with repeated signs and a second point."""
    raw = F.concat(F.repeat(F.lit("-"), (F.col("p_partkey") % 4).cast("int")), F.floor("p_retailprice"), F.lit("."), "p_size", F.lit(".75"))
    return _t(spark, sf_dir, "part").select("p_partkey", _r(text.tolerant_real(raw)).alias("v"))


@query("select doc_id, text as back from documents")
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex strings with white space in them read back."""
    loose = F.concat(F.regexp_replace(F.hex("text"), "(.{40})", "$1\n "), F.lit(">trailing"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.unhexed(loose).cast("string").alias("back"))


@query("""select l_orderkey, l_linenumber, cast(ceil(bits * colors * l_partkey / 8.0) as int) as row_bytes, greatest(1, cast(ceil(bits * colors / 8.0) as int)) as pixel_bytes,
  cast(least(greatest(l_partkey * 100000000 - l_suppkey * 90000000000, -2147483648), 2147483647) as int) as clamped
  from (select *, [1, 2, 4, 8, 16][1 + l_linenumber % 5] as bits, 1 + l_linenumber % 4 as colors from lineitem)""")
def row_strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of rows and pixels of packed samples; 32-bit clamps."""
    bits = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 16))), F.col("l_linenumber") % 5 + 1)
    colors = 1 + F.col("l_linenumber") % 4
    big = F.col("l_partkey") * 100000000 - F.col("l_suppkey") * 90000000000
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.row_bytes(bits, colors, F.col("l_partkey")).alias("row_bytes"), geometry.pixel_bytes(bits, colors).alias("pixel_bytes"), geometry.clamp32(big).alias("clamped"))
