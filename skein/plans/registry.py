"""Every query of the graph and note operators by name, with its definition in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexer, series
from ..operators import graph as G
from ..operators import proposals, spectral, stack
from . import corpora as C

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REACH = "reach as (select id, id as root from v union select e.dst, r.root from reach r join e on e.src = r.id), lab as (select id, min(root) as label from reach group by id)"
WALK = REACH + ", walk as (select id, 0 as d from lab where id = label union select e.dst, w.d + 1 from walk w join e on e.src = w.id where w.d < 14), col as (select id, min(d) % 2 as color from walk group by id)"
TRIANGLES = "tri as (select x.a, x.b, y.b as c from one x join one y on x.b = y.a join one z on z.a = x.a and z.b = y.b)"

# structure of graphs


@query(f"with {C.PART_SUPPLIER} select id, degree from deg order by degree desc, id limit 20")
def graph_hubs(spark, d):
    return G.hubs(C.part_supplier(spark, d), 20)


@query(f"""with {C.WORD_GRAPH} select count(*) as n, cast(sum(degree) / 2 as bigint) as edges, avg(degree) as mean, quantile_cont(degree, 0.5) as median, max(degree) as max,
count_if(degree = 0) as deg_0, count_if(degree = 1) as deg_1, count_if(degree = 2) as deg_2, count_if(degree = 3) as deg_3, count_if(degree >= 10) as deg_10_up from deg""")
def graph_degree_stats(spark, d):
    return G.degree_stats(C.note_graph(C.word_notes(spark, d)))


@query(f"with {C.PART_SUPPLIER} select n, edges, round(edges / (n * (n - 1) / 2), 12) as density from (select count(*) as n, cast(sum(degree) / 2 as bigint) as edges from deg)")
def graph_density(spark, d):
    return G.density(C.part_supplier(spark, d)).withColumn("density", F.round("density", 12))


@query(f"with {C.PARTS_IN_ORDERS}, {TRIANGLES} select count(*) as triangles from tri")
def graph_triangles(spark, d):
    return G.triangles(C.parts_in_orders(spark, d))


@query(f"""with {C.PARTS_IN_ORDERS}, {TRIANGLES}, t as (select id, count(*) as n from (select unnest([a, b, c]) as id from tri) group by id)
select round(avg(2.0 * coalesce(n, 0) / (degree * (degree - 1))), 9) as clustering, count(*) as n_evaluated from deg left join t using (id) where degree >= 2""")
def graph_clustering(spark, d):
    return G.clustering(C.parts_in_orders(spark, d)).withColumn("clustering", F.round("clustering", 9))


@query(f"""with {C.PART_SUPPLIER} select cast(case when exists (select 1 from one x join one y on x.b = y.a join one z on z.a = x.a and z.b = y.b) then 3
when exists (select 1 from e x join e y on x.dst = y.src where x.src < y.dst group by x.src, y.dst having count(*) > 1) then 4 end as integer) as girth""")
def graph_girth(spark, d):
    return G.girth(C.part_supplier(spark, d))


@query(f"with recursive {C.WORD_GRAPH}, {REACH} select count(*) as components, max(size) as largest, count_if(size = 1) as isolates from (select label, count(*) as size from lab group by label)")
def graph_components(spark, d):
    return G.component_stats(C.note_graph(C.word_notes(spark, d)))


@query(f"with recursive {C.WORD_GRAPH}, {REACH} select label, count(*) as size from lab group by label order by size desc, label limit 20")
def graph_component_sizes(spark, d):
    return G.component_sizes(C.note_graph(C.word_notes(spark, d))).orderBy(F.desc("size"), "label").limit(20)


@query(f"""with recursive {C.WORD_GRAPH}, {WALK}, bad as (select count(*) as clashes from one join col p on p.id = a join col q on q.id = b where p.color = q.color)
select clashes = 0 as bipartite, count_if(color = 0) as a, count_if(color = 1) as b, round(count_if(color = 0) / greatest(count_if(color = 1), 1), 9) as ratio, clashes from col, bad group by clashes""")
def graph_bipartite_notes(spark, d):
    return G.bipartite(C.note_graph(C.word_notes(spark, d))).withColumn("ratio", F.round("ratio", 9))


@query(f"""with recursive {C.PART_SUPPLIER}, walk as (select min(id) as id, 0 as d from v union select e.dst, w.d + 1 from walk w join e on e.src = w.id where w.d < 10), col as (select id, min(d) % 2 as color from walk group by id),
bad as (select count(*) as clashes from one join col p on p.id = a join col q on q.id = b where p.color = q.color)
select clashes = 0 as bipartite, count_if(color = 0) as a, count_if(color = 1) as b, round(count_if(color = 0) / greatest(count_if(color = 1), 1), 9) as ratio, clashes from col, bad group by clashes""")
def graph_bipartite(spark, d):
    return G.bipartite(C.part_supplier(spark, d)).withColumn("ratio", F.round("ratio", 9))


@query(f"""with recursive {C.WORD_GRAPH}, {WALK}, s as (select src as id, count(*) as degree, count_if(color = 0) as a, count_if(color = 1) as b from e join col on col.id = e.dst group by src having count(*) >= 4)
select id, degree, a, b, round(least(a, b) / greatest(a, b) * degree, 9) as score from s order by least(a, b) / greatest(a, b) * degree desc, degree desc, id desc limit 15""")
def graph_dirac_single(spark, d):
    return G.dirac_single(C.note_graph(C.word_notes(spark, d))).withColumn("score", F.round("score", 9))


@query(f"""with {C.LAYERS}, p as (select e.src as id, lv.vo, count(*) as n from e join lv on lv.id = e.dst group by all), s as (select id, sum(n) as degree, sum(n * ln(n)) as h from p group by id having sum(n) >= 4)
select id, cast(degree as bigint) as degree, round((ln(degree) - h / degree) * degree, 6) as score, (select string_agg(p.vo || ':' || p.n, ' ' order by p.vo) from p where p.id = s.id) as spread
from s order by score desc, degree desc, id desc limit 15""")
def graph_dirac_stack(spark, d):
    x = C.customer_supplier(spark, d)
    r = G.dirac_stack(G.Graph(x.vertices, x.edges.select("src", "dst")), x.vertices)
    spread = F.array_join(F.transform(F.map_entries("spread"), lambda m: F.concat_ws(":", m["key"].cast("string"), m["value"].cast("string"))), " ")
    return r.select("id", "degree", F.round("score", 6).alias("score"), spread.alias("spread"))


# notes


@query(f"with {C.WORDS} select src, dst, key as raw_key from links")
def links_resolve(spark, d):
    return C.word_notes(spark, d).links().select("src", "dst", "raw_key")


@query(f"with {C.SUPPLIERS} select src, dst, key as raw_key, kind from links")
def links_resolve_kinds(spark, d):
    return C.supplier_notes(spark, d).links()


@query("""with s as (select s_suppkey as id, n_regionkey as vo from supplier join nation on s_nationkey = n_nationkey),
h as (select id, vo, (id * 3 + 2) % 100 as t, (vo + 1) % 5 as tv, 0 as pos from s union all select id, vo, (id * 7 + 1) % 100, vo, 1 from s),
m as (select h.id as src, s.id as dst, h.vo, s.vo as dv, row_number() over (partition by h.id, s.id order by h.pos) as rn from h join s on s.id = h.t and s.vo = h.tv where s.id <> h.id)
select src, dst, 'supplier-' || dst as raw_key, 'md' as kind, vo = dv as within from m where rn = 1""")
def links_between_vaults(spark, d):
    c = C.sibling_notes(spark, d)
    place = c.facts.select("note_id", "vault_ord")
    a, b = (place.select(F.col("note_id").alias(x), F.col("vault_ord").alias(f"v_{x}")) for x in ("src", "dst"))
    return c.links().join(a, "src").join(b, "dst").select("src", "dst", "raw_key", "kind", (F.col("v_src") == F.col("v_dst")).alias("within"))


@query(f"with {C.WORDS} select key, count(distinct src) as n, string_agg(src, ' ' order by src) as sources from lost group by key")
def links_unresolved(spark, d):
    u = C.word_notes(spark, d).unresolved().groupBy("key").agg(F.sort_array(F.collect_set("src")).alias("s"))
    return u.select("key", F.size("s").cast("bigint").alias("n"), F.array_join("s", " ").alias("sources"))


@query(f"with {C.WORDS} select id as note_id, relpath from notes where id not in (select dst from links)")
def links_orphans(spark, d):
    return C.word_notes(spark, d).orphans().select("note_id", "relpath")


@query(f"with {C.SUPPLIERS} select dst, src, count(*) as n from links group by all")
def links_backlink_counts(spark, d):
    return C.supplier_notes(spark, d).backlinks()


@query(rf"""with notes as (select doc_id as id, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') as l from documents), x as (select id, unnest(l) as target, unnest(range(len(l))) as pos from notes)
select id as note_id, cast(min(pos) as bigint) as pos, min_by(target, pos) as target from x group by id, lower(target)""")
def links_outgoing(spark, d):
    return C.word_notes(spark, d).outgoing().select("note_id", F.col("pos").cast("bigint").alias("pos"), "target")


@query(f"with {C.WORDS} select id as note_id, alias from notes where alias <> ''")
def notes_aliases(spark, d):
    return C.word_notes(spark, d).aliases.select("note_id", "alias")


@query(f"with {C.WORDS} select key, id as note_id from idx")
def notes_name_index(spark, d):
    return C.word_notes(spark, d).name_index.select("key", "note_id")


@query(f"with {C.WORDS} select min_by(id, vo * 100000000000 + rn) as note_id from (select *, row_number() over (order by relpath) as rn from idx where key = 'that')")
def notes_resolve_file(spark, d):
    return C.word_notes(spark, d).resolve_file("That.md")


@query(f"""with {C.SUPPLIERS} select id as note_id, 'tags' as key, true as is_list, 'seg-' || (id % 7) || ', band-' || (id % 3) as value from notes
union all select id, 'status', false, 'open' from notes where id % 2 = 0""")
def notes_properties(spark, d):
    return C.supplier_notes(spark, d).properties.select("note_id", "key", "is_list", F.when(F.col("is_list"), F.array_join("items", ", ")).otherwise(F.col("scalar")).alias("value"))


@query(f"with {C.SUPPLIERS} select id as note_id, unnest(['seg-' || (id % 7), 'band-' || (id % 3)]) as item from notes")
def notes_property_get(spark, d):
    return C.supplier_notes(spark, d).listed("tags").select("note_id", "item")


@query(f"with {C.SUPPLIERS} select tag, count(*) as n, count(distinct id) as n_notes from tags group by tag")
def tags_distribution(spark, d):
    return C.supplier_notes(spark, d).tag_counts()


@query(f"with {C.SUPPLIERS} select distinct id as note_id from tags where tag = 'zone/3'")
def tags_notes(spark, d):
    return C.supplier_notes(spark, d).tagged("#zone/3").select("note_id")


@query("""select o_orderkey as note_id, 1 as line, o_orderstatus in ('F', 'P') as done, 'ship ' || o_orderkey as text from orders
union all select o_orderkey, 2, false, 'call ' || o_orderpriority from orders""")
def tasks_all(spark, d):
    return C.order_notes(spark, d).tasks.select("note_id", "line", "done", "text")


@query("select o_orderkey as note_id, 'ship ' || o_orderkey as text from orders where o_orderstatus not in ('F', 'P') union all select o_orderkey, 'call ' || o_orderpriority from orders")
def tasks_todo(spark, d):
    return C.order_notes(spark, d).tasks.filter("not done").select("note_id", "text")


@query(f"with {C.WORDS} select id as note_id from notes where contains(lower(body), 'license')")
def search_notes(spark, d):
    return C.word_notes(spark, d).search("License").select("note_id")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as i from documents)
select doc_id as note_id, count(*) as n_lines, cast(min(i) + 4 as bigint) as first_line from l where contains(lower(t), 'license') group by doc_id""")
def search_context(spark, d):
    r = C.word_notes(spark, d).search("license", context=True)
    return r.select("note_id", F.size("matches").cast("bigint").alias("n_lines"), F.col("matches")[0]["line"].cast("bigint").alias("first_line"))


@query(f"with {C.WORDS} select vo as vault_ord, vault, count(*) as files, cast(sum(strlen('---' || chr(10) || 'aliases: ' || alias || chr(10) || '---' || chr(10) || body)) as bigint) as size from notes group by all")
def vault_info(spark, d):
    return C.word_notes(spark, d).vault_info()


# stacks of vaults


@query("""with s as (select distinct lang, case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 when 'fr' then 4 else 0 end as vo, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) as name from documents where regexp_extract(text, '^([A-Za-z]+)', 1) <> ''),
z as (select vo, count(*) as n from s group by vo), p as (select a.vo as a, b.vo as b, (select count(*) from s x join s y on x.name = y.name where x.vo = a.vo and y.vo = b.vo) as shared, a.n + b.n as na from z a join z b on a.vo < b.vo)
select a, b, shared, na - shared as total, round(shared / (na - shared), 9) as jaccard from p""")
def stack_moire(spark, d):
    return stack.moire(C.named_notes(spark, d)).withColumn("jaccard", F.round("jaccard", 9))


@query("""select lower(regexp_extract(text, '^([A-Za-z]+)', 1)) as name, count(distinct lang) as n_vaults from documents where regexp_extract(text, '^([A-Za-z]+)', 1) <> '' group by name having count(distinct lang) >= 2""")
def stack_shared_names(spark, d):
    return stack.shared_names(C.named_notes(spark, d))


@query(f"""with recursive {C.WORD_GRAPH}, {WALK}, bad as (select count(*) as clashes from one join col p on p.id = a join col q on q.id = b where p.color = q.color)
select (select count(*) from notes) as notes, (select count(*) from one) as edges, (select count(*) from notes where id not in (select dst from links)) as orphans, (select count_if(degree = 0) from deg) as isolates,
(select count(distinct key) from lost) as unresolved, (select count(*) from notes where false) as tags, clashes = 0 as bipartite, (select count_if(color = 0) from col) as a, (select count_if(color = 1) from col) as b,
round(2 * (select count(*) from one) / (select count(*) from notes), 9) as mean_degree from bad""")
def health_single(spark, d):
    return stack.health(C.word_notes(spark, d)).withColumn("mean_degree", F.round("mean_degree", 9))


@query(f"""with {C.WORDS}, near as (select k.id as src, k.vo, k.key, (select min_by(i.id, i.relpath) from idx i where i.key = k.key and i.vo = k.vo) as dst from keys k),
al as (select distinct vo, least(src, dst) as a, greatest(src, dst) as b from near where dst is not null and dst <> src),
wl as (select distinct least(src, dst) as a, greatest(src, dst) as b from links),
per as (select vo as vault_ord, count(*) as notes, (select count(*) from al where al.vo = notes.vo) as edges, count_if(id not in (select dst from near where dst is not null and dst <> src)) as orphans,
(select count(distinct key) from near where near.vo = notes.vo and dst is null) as unresolved, cast(null as bigint) as cross_sheet from notes group by vo)
select * from per union all select null, (select count(*) from notes), (select count(*) from wl), (select count(*) from notes where id not in (select dst from links)), (select count(distinct key) from lost), (select count(*) from wl) - (select count(*) from al)""")
def health_stack(spark, d):
    return stack.stack_health(C.word_notes(spark, d))


@query(f"with {C.LAYERS} select (select count(*) from lv) as n, count_if(class = 'intra') as intra, count_if(class = 'inter') as inter from ce where src < dst")
def stack_layers(spark, d):
    return stack.layer_counts(C.customer_supplier(spark, d))


LAYER_COLORS = "le as (select src, dst from ce where class = 'intra'), lreach as (select id, id as root from v union select le.dst, r.root from lreach r join le on le.src = r.id), llab as (select id, min(root) as label from lreach group by id), lwalk as (select id, 0 as d from llab where id = label union select le.dst, w.d + 1 from lwalk w join le on le.src = w.id where w.d < 14), col as (select id, min(d) % 2 as color from lwalk group by id)"


@query(f"""with recursive {C.LAYERS}, {LAYER_COLORS}, q as (select lv.vo, count(*) as edges, count_if(p.color = r.color) as bad from le join lv on lv.id = le.src join col p on p.id = le.src join col r on r.id = le.dst where le.src < le.dst group by lv.vo)
select vo as vault_ord, edges, round(1 - bad / edges, 9) as quality from q""")
def stack_coloring_quality(spark, d):
    x = C.customer_supplier(spark, d)
    return stack.quality(x, stack.colors(x)).withColumn("quality", F.round("quality", 9))


@query(f"""with recursive {C.LAYERS}, {LAYER_COLORS} select count_if(class = 'intra') as intra, count_if(class = 'inter' and p.color = 0 and q.color = 0) as aa, count_if(class = 'inter' and p.color = 1 and q.color = 1) as bb,
count_if(class = 'inter' and p.color <> q.color) as ab from ce join col p on p.id = src join col q on q.id = dst where src < dst""")
def stack_edge_classes(spark, d):
    x = C.customer_supplier(spark, d)
    return stack.sublattice_counts(x, stack.colors(x))


# spectra


def power_sql(sets: str, iters: int) -> str:
    """CTEs for power iteration on w (k, src, dst, weight) and v: top (k, value), and for the second: gap, vec."""
    mod, prime = spectral._M, spectral._P

    def run(name: str, start: str, shifted: bool) -> str:
        mean = f" - avg(x) over (partition by k)" if shifted else ""
        y = "t.value * i.x - (d.d * i.x - coalesce(s.s, 0))" if shifted else "d.d * i.x - coalesce(s.s, 0)"
        top = "join top t on t.k = i.k" if shifted else ""
        return f"""{name} as (select 0 as step, k, id, x / sqrt(sum(x * x) over (partition by k)) as x from (select k, id, x{mean} as x from ({start}))
union all select step, k, id, x / sqrt(sum(x * x) over (partition by k)) from (select step, k, id, x{mean} as x from (select i.step + 1 as step, i.k, i.id, {y} as x
from {name} i join wd d on d.k = i.k and d.id = i.id {top} left join (select w.k, w.src, sum(w.weight * j.x) as s from {name} j join w on w.k = j.k and w.dst = j.id group by w.k, w.src) s on s.k = i.k and s.src = i.id where i.step < {iters})))"""

    def rayleigh(name: str, it: str) -> str:
        return f"""{name} as (select i.k, sum(i.x * (d.d * i.x - coalesce(s.s, 0))) as value from {it} i join wd d on d.k = i.k and d.id = i.id
left join (select w.k, w.src, sum(w.weight * j.x) as s from {it} j join w on w.k = j.k and w.dst = j.id where j.step = {iters - 1} group by w.k, w.src) s on s.k = i.k and s.src = i.id where i.step = {iters - 1} group by i.k)"""

    def start(seed: int) -> str:
        return f"select k, id, cast((id * {mod} + {seed * 7919}) % {prime} as double) / cast({prime} as double) - 0.5 as x from v cross join ks"

    return f"""{sets}, wd as (select ks.k, v.id, coalesce(sum(w.weight), 0) as d from v cross join ks left join w on w.k = ks.k and w.src = v.id group by all),
{run('p1', start(0), False)}, {rayleigh('top', 'p1')}, {run('p2', start(1), True)}, {rayleigh('low', 'p2')},
ip as (select k, sum(x * x * x * x) / (sum(x * x) * sum(x * x)) as ipr, count(*) as n from p2 where step = {iters} group by k)"""


SPECTRUM = "select cast(top.k as integer) as step, round(top.value, 6) as lambda_max, round(low.value, 6) as lambda_2, round(ipr, 6) as ipr, round(ipr * n, 4) as n_ipr from top join low using (k) join ip using (k)"


def rounded(df):
    return df.select("step", *(F.round(c, 6).alias(c) for c in ("lambda_max", "lambda_2", "ipr")), F.round("n_ipr", 4).alias("n_ipr"))


@query(f"with recursive {C.PART_SUPPLIER}, {power_sql('ks as (select 0 as k), w as (select 0 as k, src, dst, 1.0::double as weight from e)', 24)} {SPECTRUM}")
def spectral_spectrum(spark, d):
    g = C.part_supplier(spark, d)
    return rounded(spectral.spectrum(g.vertices, g.edges, iters=24, tol=0))


SWEEP = power_sql("ks as (select unnest([0, 1, 2, 3, 4]) as k), w as (select k, src, dst, case class when 'intra' then 1.0::double else k * 0.5::double end as weight from ce cross join ks)", 16)


@query(f"with recursive {C.LAYERS}, {SWEEP} {SPECTRUM}")
def spectral_layered_sweep(spark, d):
    return rounded(stack.layered_spectrum(C.customer_supplier(spark, d), series.parse_sweep("0,2,5"), 16, 0))


@query(f"with recursive {C.LAYERS}, {SWEEP} {SPECTRUM} order by ip.ipr desc, top.k limit 1")
def spectral_sweep_peak(spark, d):
    return rounded(stack.peak(stack.layered_spectrum(C.customer_supplier(spark, d), series.parse_sweep("0,2,5"), 16, 0)))


@query(f"""with recursive {C.LAYERS}, {LAYER_COLORS}, {power_sql("ks as (select unnest([0, 1, 2]) as k), w as (select k, src, dst, case when class = 'intra' or p.color <> q.color then 1.0::double else 0.5 + k * 0.5::double end as weight from ce join col p on p.id = src join col q on q.id = dst cross join ks)", 16)} {SPECTRUM}""")
def spectral_sublattice_sweep(spark, d):
    return rounded(stack.sublattice_spectrum(C.customer_supplier(spark, d), series.parse_sweep("0.5,1.5,3"), iters=16, tol=0))


@query(f"with {C.PART_SUPPLIER} select round(sum(pow(degree, 4)) / (sum(degree * degree) * sum(degree * degree)), 12) as ipr from deg")
def spectral_ipr(spark, d):
    return G.degrees(C.part_supplier(spark, d)).select(F.col("degree").cast("double").alias("x")).agg(F.round(series.ipr(F.col("x")), 12).alias("ipr"))


@query("select cast(k as integer) as step, 0.5 + k * 0.25 as value from range(7) t(k)")
def spectral_sweep(spark, d):
    return series.sweep(spark, "0.5,2,7")


@query("select cast(k as integer) as k, round(((64 - k + 1) * cos(pi() * k / 65) + sin(pi() * k / 65) * cos(pi() / 65) / sin(pi() / 65)) / 65, 9) as g from range(64) t(k)")
def spectral_jackson(spark, d):
    return series.jackson(spark, 64).withColumn("g", F.round("g", 9))


MOMENTS, PROBES, BINS = 16, 3, 40
_X = f"((id * {spectral._M} + r * 40503) % {spectral._P})"
KPM = f"""top as (select 2.0 * max(degree) as t from deg), pv as (select r, id, (case when ({_X} * {_X} % {spectral._P} * 31 + r) % 2 = 0 then 1.0 else -1.0 end) / sqrt((select count(*) from v)) as x from v cross join range({PROBES}) p(r)),
kp as (select 0 as step, r, id, x as v, x as b, cast(0 as double) as a from pv
union all select i.step + 1, i.r, i.id, i.v, (case when i.step = 0 then 1 else 2 end) * (2 / t.t * (d.degree * i.b - coalesce(s.s, 0)) - i.b) - i.a, i.b * (case when i.step = 0 then 1 else 1 end)
from kp i join deg d on d.id = i.id cross join top t left join (select j.r, e.src, sum(j.b) as s from kp j join e on e.dst = j.id group by j.r, e.src) s on s.r = i.r and s.src = i.id where i.step < {MOMENTS - 1}),
mu as (select step as k, sum(v * b) / {PROBES} as mu from kp group by step)"""
DOS = f"""grid as (select b as bin, 0.999 * cos(({BINS} - 1 - b + 0.5) * pi() / {BINS}) as x from range({BINS}) g(b)),
dos as (select bin, (select t from top) / 2 * (x + 1) as energy, greatest(sum((case when k = 0 then 1 else 2 end) * ((({MOMENTS} - k + 1) * cos(pi() * k / {MOMENTS + 1}) + sin(pi() * k / {MOMENTS + 1}) * cos(pi() / {MOMENTS + 1}) / sin(pi() / {MOMENTS + 1})) / {MOMENTS + 1}) * mu * cos(k * acos(x))) / (pi() * sqrt(1 - x * x)), 0) as rho from grid cross join mu group by bin, x)"""


def bounded(spark, d):
    """The part-supplier graph and twice its largest degree, which no eigenvalue exceeds."""
    g = C.part_supplier(spark, d)
    return g, 2.0 * G.degrees(g).agg(F.max("degree")).first()[0]


def moments_dos(spark, d):
    g, top = bounded(spark, d)
    return spectral.reconstruct(spectral.kpm_moments(g.vertices, g.edges, top, MOMENTS, PROBES), top, BINS)


@query(f"with recursive {C.PART_SUPPLIER}, {KPM} select cast(k as integer) as k, round(mu, 9) as mu from mu")
def spectral_kpm_moments(spark, d):
    g, top = bounded(spark, d)
    return spectral.kpm_moments(g.vertices, g.edges, top, MOMENTS, PROBES).withColumn("mu", F.round("mu", 9))


@query(f"with recursive {C.PART_SUPPLIER}, {KPM}, {DOS} select cast(bin as integer) as bin, round(energy, 6) as energy, round(rho, 6) as rho from dos")
def spectral_dos(spark, d):
    return moments_dos(spark, d).select("bin", F.round("energy", 6).alias("energy"), F.round("rho", 6).alias("rho"))


@query(f"""with recursive {C.PART_SUPPLIER}, {KPM}, {DOS}, z as (select bin, rho, (rho - avg(rho) over ()) / stddev_pop(rho) over () as z, lag(rho) over (order by bin) as l, lead(rho) over (order by bin) as r from dos)
select cast(bin as integer) as bin, round(rho, 6) as rho, round(z, 6) as z from z where rho > l and rho > r and z >= 0.5 order by rho desc limit 5""")
def spectral_peaks(spark, d):
    return series.peaks(moments_dos(spark, d), 0.5).select("bin", F.round("rho", 6).alias("rho"), F.round("z", 6).alias("z"))


# The queries above run fewer steps than the operators' defaults, so that their SQL stays cheap; these run the defaults.


@query()
def spectral_spectrum_default(spark, d):
    """With the default 120 steps and tolerance."""
    g = C.part_supplier(spark, d)
    return spectral.spectrum(g.vertices, g.edges)


@query()
def spectral_layered_sweep_default(spark, d):
    """With the default 200 steps and tolerance."""
    return stack.layered_spectrum(C.customer_supplier(spark, d), series.parse_sweep("0,2,5"))


@query()
def spectral_sublattice_sweep_default(spark, d):
    """With the default 200 steps and tolerance."""
    return stack.sublattice_spectrum(C.customer_supplier(spark, d), series.parse_sweep("0.5,1.5,3"))


@query()
def spectral_kpm_moments_default(spark, d):
    """With the default 200 moments and 8 probes."""
    g, top = bounded(spark, d)
    return spectral.kpm_moments(g.vertices, g.edges, top)


@query()
def spectral_peaks_default(spark, d):
    """Of the default density of states."""
    g = C.part_supplier(spark, d)
    return series.peaks(spectral.density_of_states(g.vertices, g.edges))


@query()
def spectral_dos_default(spark, d):
    """With the default 200 moments, 8 probes and a largest eigenvalue found by iteration to a tolerance."""
    g = C.part_supplier(spark, d)
    return spectral.density_of_states(g.vertices, g.edges)


@query()
def spectral_localized(spark, d):
    """The vector depends on the iteration's last step, to a tolerance."""
    g = C.part_supplier(spark, d)
    return spectral.localized(spectral.fiedler(g.vertices, g.edges))


# proposals


@query(f"with {C.SUPPLIERS} select key as target, key || '.md' as path, count(*) as n_sources from lost where key not similar to '.*[(){{}}<>=!,*$\"|].*' group by key")
def propose_stub(spark, d):
    return proposals.stubs(C.supplier_notes(spark, d)).select("target", "path", "n_sources")


@query(f"""with {C.SUPPLIERS}, o as (select id from notes where id not in (select dst from links)), ft as (select id, tag from tags where origin = 'frontmatter'),
p as (select o.id as orphan, y.id as note_id, count(*) as score, string_agg(y.tag, ' ' order by y.tag) as shared_tags from o join ft x on x.id = o.id join ft y on y.tag = x.tag and y.id <> o.id group by all),
r as (select p.*, n.relpath as path, row_number() over (partition by orphan order by score desc, n.vo desc, n.relpath desc) as rank from p join notes n on n.id = p.note_id)
select orphan, note_id, path, 'supplier-' || orphan as link_to, score, shared_tags, cast(rank as integer) as rank from r where rank <= 3""")
def propose_bond(spark, d):
    return proposals.bonds(C.supplier_notes(spark, d)).withColumn("shared_tags", F.array_join("shared_tags", " ")).drop("vault_ord")


@query(f"""with {C.SUPPLIERS}, h as (select id, 'tags' as key from notes union all select id, 'status' from notes where id % 2 = 0), c as (select key, count(*) / (select count(*) from notes) as share from h group by key having count(*) / (select count(*) from notes) >= 0.4)
select n.id as note_id, string_agg(c.key, ' ' order by c.key) as keys, round_even(max(share), 3) as share from notes n cross join c where not exists (select 1 from h where h.id = n.id and h.key = c.key) group by n.id""")
def propose_propagate(spark, d):
    m = proposals.missing_keys(C.supplier_notes(spark, d), 0.4)
    return m.select("note_id", F.array_join("keys", " ").alias("keys"), F.array_max("shares").alias("share"))


@query("select * from (values (1, 'missing targets', 'unresolved', 'stub'), (2, 'notes without links to them', 'orphans', 'bond'), (3, 'uneven metadata', 'properties', 'propagate')) t(position, finding, reading, proposal)")
def propose_correspondence(spark, d):
    return proposals.correspondence(spark)


@query(r"""with k as (select distinct text as t from (select p_name as t from part union select p_type from part union select n_name from nation union select event_type from events union select props from events)  x(text))
select t as target, not regexp_matches(t, '[()=!,*$"<>{}|]') and not contains(t, '...') and not contains(t, '->') and not regexp_matches(t, '^[0-9]+$') and length(t) between 1 and 120 and not starts_with(t, '.') and not starts_with(t, '/') as plausible from k""")
def names_plausible(spark, d):
    parts, n, ev = C.table(spark, d, "part"), C.table(spark, d, "nation"), C.table(spark, d, "events")
    t = parts.select(F.col("p_name").alias("target")).union(parts.select("p_type")).union(n.select("n_name")).union(ev.select("event_type")).union(ev.select("props")).distinct()
    return t.select("target", lexer.plausible_name(F.col("target")).alias("plausible"))


@query(r"select p_name as name, regexp_replace(p_brand || '/' || p_type || ':' || p_name, '[\\:*?""<>|]', '_', 'g') as slug from part".replace('""', '"'))
def names_slug(spark, d):
    p = C.table(spark, d, "part")
    return p.select(F.col("p_name").alias("name"), lexer.slug(F.concat("p_brand", F.lit("/"), "p_type", F.lit(":"), "p_name")).alias("slug"))
