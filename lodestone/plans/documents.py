"""Document structure, manifests and incremental loads over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import columns as K
from lodestone.operators import documents as D
from lodestone.sources.io import table as T
from lodestone.streaming import incremental as I

from .registry import query

C = F.col
#: Whole texts with a heading, a table and a figure put around them, in an expression that either engine reads alike.
MD = "'# Title ' || doc_id || chr(10) || text || chr(10) || 'Tabella ' || lang || chr(10) || 'x' || chr(10) || 'a | b' || chr(10) || '--- | ---' || chr(10) || source || ' | ' || n_chars || chr(10) || 'end' || chr(10) || '  ## inner' || chr(10) || '![p](p.png)' || chr(10) || chr(10) || 'Caption of ' || source || case when doc_id % 2 = 0 then chr(10) || 'h - | g' else '' end"
LINES = f"""with l0 as (select doc_id, string_split({MD}, chr(10)) a from documents where text is not null), l as (select doc_id, unnest(a) line, generate_subscripts(a, 1) - 1 pos from l0),
 m as (select *, contains(line, '|') pipe, sum(case when contains(line, '|') then 0 else 1 end) over (partition by doc_id order by pos) island, max(pos) over (partition by doc_id) last_pos from l) """


def docs(s, d):
    return T(s, d, "documents").where("text is not null").selectExpr("doc_id", f"{MD} as text")


def lines(s, d):
    return D.lines(docs(s, d))


@query("doc03_headings", LINES + r"select doc_id, pos, length(regexp_extract(line, '^(#*)', 1)) as level, substr(trim(regexp_replace(trim(line), '^#+', '')), 1, 200) as text from l where starts_with(trim(line), '#')")
def _(s, d):
    return D.headings(lines(s, d))


def _tables_sql(flush: bool) -> str:
    return LINES + f""", c as (select doc_id, pos p, (select min(struct_pack(q := k.pos, t := trim(k.line))).t from l k where k.doc_id = m.doc_id and k.pos between m.pos - 5 and m.pos - 1 and contains(k.line, 'Tabella')) cap from m where pipe),
 t as (select *, min(case when regexp_matches(line, '[-─]') then pos end) over (partition by doc_id, island) start, max(pos) over (partition by doc_id, island) end_ from m where pipe),
 u as (select * from t where pos >= start {'' if flush else 'and end_ < last_pos'}),
 g as (select doc_id, start, count(*) n_rows, string_agg(line, chr(10) order by pos) content, arg_min(line, pos) head from u group by 1, 2)
 select g.doc_id, row_number() over (partition by g.doc_id order by start) table_no, start, n_rows, content, list_filter(list_transform(string_split(head, '|'), lambda x: trim(x)), lambda x: x <> '') "columns", coalesce(cap, 'N/A') caption from g join c on c.doc_id = g.doc_id and c.p = g.start"""


@query("doc04_tables", _tables_sql(False))
def _(s, d):
    return D.tables(lines(s, d))


@query("doc06_tables_flush", _tables_sql(True))
def _(s, d):
    return D.tables(lines(s, d), flush=True)


@query("doc05_figures", LINES + """, f as (select * from l where contains(line, '![') or contains(line, '<!-- image'))
 select doc_id, row_number() over (partition by doc_id order by pos) figure_no, pos, coalesce((select min(struct_pack(q := k.pos, t := trim(k.line))).t from l k where k.doc_id = f.doc_id and k.pos between f.pos + 1 and f.pos + 4 and trim(k.line) <> '' and not starts_with(trim(k.line), '#')), 'N/A') caption from f""")
def _(s, d):
    return D.figures(lines(s, d))


@query("doc07_table_meta", "with t as (" + _tables_sql(False) + ') select doc_id, table_no, len("columns") n_columns, greatest(n_rows - 1, 0) rows_estimated from t')
def _(s, d):
    return D.table_meta(D.tables(lines(s, d)))


@query("doc08_stats", "select doc_id, length(text) chars, regexp_matches(text, '(^|\\n)#') or contains(text, '|') structured from documents where text is not null")
def _(s, d):
    return D.stats(T(s, d, "documents").where("text is not null"))


@query("snk05_table_files", "with t as (" + _tables_sql(False) + ") select doc_id, table_no, 'DOC ' || doc_id || ' TABLE ' || table_no || chr(10) || 'CAPTION: ' || caption || chr(10) || 'COLUMNS: ' || array_to_string(\"columns\", ', ') || chr(10) || repeat('=', 40) || chr(10) || content body from t")
def _(s, d):
    t = D.tables(lines(s, d))
    return t.select("doc_id", "table_no", D.table_file(C("doc_id"), C("table_no"), C("caption"), C("columns"), C("content")).alias("body"))


@query("doc10_manifest", "with t as (" + _tables_sql(False) + f"), c as (select doc_id, 0 o, 0 p, 'markdown_text' k, length({MD}) n from documents where text is not null union all select doc_id, 1, table_no, 'table', length('TABELLA: ' || caption || chr(10) || case when len(\"columns\") > 0 then 'COLONNE: ' || array_to_string(\"columns\", ', ') || chr(10) else '' end || 'CONTENUTO:' || chr(10) || content) from t union all select doc_id, 2, 1, 'image_vlm', length('about ' || lang) from documents where doc_id % 3 = 0) select doc_id, list(k order by o, p) content_types, count(*) n_chunks, cast(sum(n) as bigint) chars from c group by 1")
def _(s, d):
    images = T(s, d, "documents").select("doc_id", F.lit(1).alias("position"), F.when(C("doc_id") % 3 == 0, F.concat(F.lit("about "), C("lang"))).alias("description"))
    m = D.manifest(D.chunks(docs(s, d), D.tables(lines(s, d)), images))
    return m.select("doc_id", "content_types", "n_chunks", F.aggregate("indexable_content", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("chars"))


@query("doc11_readiness", "with i as (select doc_id, count(*) n from documents group by 1), t as (select doc_id, count(*) n from labels group by 1) select coalesce(i.doc_id, t.doc_id) doc_id, coalesce(i.n, 0) n_images, coalesce(t.n, 0) n_texts, coalesce(i.n, 0) = coalesce(t.n, 0) ready from i full outer join t on i.doc_id = t.doc_id")
def _(s, d):
    return D.readiness(T(s, d, "documents"), T(s, d, "labels"))


@query("agg10_11_chunk_counts", LINES + "select count(*) filter (contains(line, '|')) pipes, count(*) filter (starts_with(trim(line), '#')) heads, count(*) n from l")
def _(s, d):
    return lines(s, d).agg(F.count_if(F.contains("line", F.lit("|"))).alias("pipes"), F.count_if(F.trim("line").startswith("#")).alias("heads"), F.count("*").alias("n"))


@query("join08_zip_images", LINES + "select doc_id, row_number() over (partition by doc_id order by pos) figure_no, 'p.png' file from l where contains(line, '![')")
def _(s, d):
    images = docs(s, d).select("doc_id", F.lit(1).alias("image_no"), F.lit("p.png").alias("file"))
    return D.zip_images(D.figures(lines(s, d)), images).select("doc_id", "figure_no", "file")


@query("snk07_missing_sidecars", "select doc_id from documents where lang is not null and doc_id not in (select doc_id from labels)")
def _(s, d):
    return T(s, d, "documents").where("lang is not null").join(T(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


HTML = r"select page_id, url, coalesce(nullif(trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), chr(160), ' '), '\s+', ' ', 'g')), ''), 'N/A') title from pages"


@query("htmlf1_title", HTML)
def _(s, d):
    return D.scrape(T(s, d, "pages"), {"title": ("title",)})


@query("htmlf2_fallback_chain")
def _(s, d):
    return D.scrape(T(s, d, "pages"), {"title": ("h1", "title", "h2", "p"), "abstract": ("p", "li")})


def _listing(s, d):
    p = T(s, d, "pages").select("url", C("page_id").alias("ordinal"))
    return p.unionByName(p.select("url", (C("ordinal") + 1_000_000).alias("ordinal")))


@query("str01_incremental_load", "select url, min(page_id) ordinal from pages where url not in (select url from pages where page_id % 3 = 0) and url is not null and url <> '' group by 1")
def _(s, d):
    return I.plan_load(_listing(s, d), T(s, d, "pages").where("page_id % 3 = 0").select("url"))


@query("str02_update_report", "select (select count(distinct url) from pages where page_id % 3 = 0) existing, (select count(distinct url) from pages where url not in (select url from pages where page_id % 3 = 0)) new_found, count(*) filter (page_id % 5 <> 0) new_processed, count(*) filter (page_id % 5 = 0) failed from pages")
def _(s, d):
    results = T(s, d, "pages").select(F.when(C("page_id") % 5 == 0, "error").otherwise("success").alias("status"))
    return I.update_report(_listing(s, d), T(s, d, "pages").where("page_id % 3 = 0").select("url"), results)


@query("str03_changes", "select c_custkey k, 'added' change from customer where c_custkey not in (select o_custkey from orders)")
def _(s, d):
    return I.changes(T(s, d, "orders").select(C("o_custkey").alias("k")), T(s, d, "customer").select(C("c_custkey").alias("k")), "k")


@query("str05_dead_letters", "select page_id from pages where page_id % 5 = 0")
def _(s, d):
    return I.split_results(T(s, d, "pages").select("page_id", F.when(C("page_id") % 5 == 0, "error").otherwise("success").alias("status")))[1].select("page_id")


@query("flt06_status_filter", "select doc_id, source from documents where text is not null and source <> 'src0'")
def _(s, d):
    x = T(s, d, "documents").select("doc_id", "source", F.when(C("source") != "src0", "success").otherwise("error").alias("status"), F.when(C("text").isNotNull(), F.struct("text", "lang")).alias("document_content"))
    return x.where("status = 'success' and document_content is not null").select("doc_id", "source")


@query("strf1_nfkc")
def _(s, d):
    return T(s, d, "documents").select("doc_id", K.normalize_query(C("text"), compose=True).alias("t"))
