"""Document preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import citation
from cohortloom.operators import chunking
from cohortloom.plans import sqlkit as k
from cohortloom.plans.registry import query
from cohortloom.sources import files, html

NL2 = "chr(10) || chr(10)"
SECTIONS_SQL = f"""sec as (select doc_id, list_transform({k.lines('text')}, lambda l: struct_pack(name := '#' || split_part(l, ' ', 1), content := replace(l, ', ', ',' || {NL2}))) as sections from documents)"""


def _sections(b):
    """Every line a section named after its first word; its clauses are the paragraphs."""
    return b.documents.select(
        "doc_id",
        F.transform(
            chunking.lines(F.col("text")),
            lambda line: F.struct(
                F.concat(F.lit("#"), F.split_part(line, F.lit(" "), F.lit(1))).alias("name"),
                F.replace(line, F.lit(", "), F.lit(",\n\n")).alias("content"),
            ),
        ).alias("sections"),
    )


PACK_SQL = f"""p as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as i from (select doc_id, list_filter({k.lines('text')}, lambda p: length(p) >= 20) as parts from documents)),
    t as (select doc_id, part, i, len(regexp_extract_all(part, '\\S+')) as n from p),
    w as (select doc_id, i, n as used, 0 as win from t where i = 0 union all
      select t.doc_id, t.i, case when w.used > 0 and w.used + t.n > 120 then t.n else w.used + t.n end, case when w.used > 0 and w.used + t.n > 120 then w.win + 1 else w.win end from w join t on t.doc_id = w.doc_id and t.i = w.i + 1)"""


@query(
    "section_windows",
    f"""WITH RECURSIVE {PACK_SQL} select doc_id, win as window_idx, min(i) as first_par, max(i) as last_par, string_agg(part, {NL2} order by i) as text from w join t using (doc_id, i) group by 1, 2""",
)
def _windows(b):
    return chunking.section_windows(b.documents, "doc_id", "text", max_tokens=120).drop("members")


@query(
    "keyword_union",
    f"""WITH RECURSIVE {PACK_SQL}, kw as (select doc_id, win as window_idx, unnest(regexp_extract_all(lower(part), '[a-z]{{9,}}')) as kw from w join t using (doc_id, i)),
    a as (select distinct doc_id, win as window_idx from w), g as (select doc_id, window_idx, array_to_string(list_sort(list(distinct kw)), ' ') as keywords from kw group by 1, 2)
    select doc_id, window_idx, coalesce(keywords, '') as keywords from a left join g using (doc_id, window_idx)""",
)
def _keyword_union(b):
    wins = chunking.section_windows(b.documents, "doc_id", "text", max_tokens=120)
    out = chunking.keyword_union(wins, "doc_id", "members", lambda m: F.regexp_extract_all(F.lower(m), F.lit("[a-z]{9,}"), F.lit(0)))
    return out.withColumn("keywords", F.array_join("keywords", " "))


@query(
    "number_paragraphs",
    f"""WITH {SECTIONS_SQL}, s as (select doc_id, unnest(sections) as s, generate_subscripts(sections, 1) as si from sec),
    p as (select doc_id, si, s.name as name, unnest(pp) as par, generate_subscripts(pp, 1) as num from (select doc_id, si, s, {k.lines('s.content', NL2)} as pp from s)),
    d as (select *, row_number() over (partition by doc_id order by si, num) - 1 as paragraph_id, trim(regexp_replace(name, '^#+', '')) || '.' || num as paragraph_ref from p),
    z as (select *, unnest(ss) as sentence, generate_subscripts(ss, 1) as k from (select *, list_filter(string_split(regexp_replace(par, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda t: trim(t) <> '') as ss from d))
    select doc_id, row_number() over (partition by doc_id order by paragraph_id, k) - 1 as sentence_id, paragraph_id, paragraph_ref, num as section_paragraph_num, trim(sentence) as sentence from z""",
)
def _numbering(b):
    return chunking.number_paragraphs(_sections(b), "doc_id", "sections")


@query(
    "overview_chunk",
    f"""WITH {SECTIONS_SQL}, kept as (select doc_id, list_filter(sections, lambda s: trim(s.content) <> '' and not {k.skip_section('s.name', 's.content')} and {k.count_in('lower(s.content)', chunking.AUTHOR_SIGNALS)} < 3) as kept from sec),
    o as (select doc_id, len(kept) as sections_used, trim(array_to_string(list_transform(kept, lambda s: '## ' || trim(regexp_replace(trim(s.name), '^#+', '')) || {NL2} || trim(s.content)), {NL2})) as overview,
      coalesce({k.count_in('lower(kept[1].content)', chunking.ABSTRACT_SIGNALS)} >= 2, false) as first_is_abstract from kept)
    select doc_id, sections_used, {k.text_clean('overview')} as overview, first_is_abstract from o where length(overview) >= 100""",
)
def _overview(b):
    return chunking.overview_chunk(_sections(b), "doc_id", "sections")


@query(
    "char_windows",
    """WITH c as (select doc_id, trim(text) as body from documents where trim(text) <> ''), n as (select doc_id, body, case when length(body) <= 1800 then 1 else cast(ceil((length(body) - 1800) / 1600.0) as int) + 1 end as cnt from c),
    e as (select doc_id, body, unnest(range(cnt)) as chunk_index from n) select doc_id, chunk_index, substr(body, chunk_index * 1600 + 1, 1800) as text from e""",
)
def _char_windows(b):
    return chunking.char_windows(b.documents, "doc_id", "text")


@query(
    "text_clean",
    f"""WITH t as (select note_id, replace(text, '%', '\\%') || ' [^3] $n=' || note_id || '$ \\mathrm{{mg}} <br/>x    y \\alpha' as raw from notes) select note_id, {k.text_clean('raw')} as clean from t""",
    "notes",
)
def _text_clean(b):
    raw = F.concat(
        F.replace(F.col("text"), F.lit("%"), F.lit("\\%")), F.lit(" [^3] $n="), F.col("note_id").cast("string"),
        F.lit("$ \\mathrm{mg} <br/>x    y \\alpha"),
    )
    return b.notes.select("note_id", chunking.text_clean(raw).alias("clean"))


_HEADERS = ["Part", "Qty", "Price"]


def _cells():
    return F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_linestatus"))


@query(
    "table_row_text",
    """WITH t as (select l_orderkey, l_linenumber, l_partkey, 'Table ' || l_linenumber as num, case when l_returnflag = 'A' then 'Doses' else '' end as title,
      [cast(l_partkey as varchar), cast(cast(l_quantity as int) as varchar), l_linestatus] as c, l_returnflag from lineitem),
    x as (select *, trim(num || ' - ' || title || '. ' || case when l_returnflag = 'R' then array_to_string(c, '; ') else 'Part: ' || c[1] || '; Qty: ' || c[2] || '; Price: ' || c[3] end) as text from t)
    select l_orderkey, l_linenumber, l_partkey, case when length(text) >= 20 then text end as text from x""",
)
def _row_text(b):
    headers = F.when(F.col("l_returnflag") == "R", F.array(F.lit("Part"))).otherwise(F.array(*map(F.lit, _HEADERS)))
    title = F.when(F.col("l_returnflag") == "A", "Doses").otherwise("")
    number = F.concat(F.lit("Table "), F.col("l_linenumber").cast("string"))
    return b.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", chunking.table_row_text(number, title, headers, _cells()).alias("text"))


@query(
    "table_to_map",
    """select l_orderkey, l_linenumber, l_partkey, cast(cast(l_quantity as int) as varchar) as qty, case when l_returnflag <> 'R' then l_linestatus end as price, case when l_returnflag = 'R' then 1 else 2 end as columns_n from lineitem""",
)
def _table_map(b):
    headers = F.when(F.col("l_returnflag") == "R", F.array(F.lit("Part"), F.lit("Qty"))).otherwise(F.array(*map(F.lit, _HEADERS)))
    rows = b.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", chunking.table_to_map(headers, _cells()).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("m")["Qty"].alias("qty"), F.col("m")["Price"].alias("price"), F.size("m").alias("columns_n"))


_ROLLUP_SQL = "r as (select distinct source, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]{10,}'), lambda t: lower(t))) as term from documents), g as (select source, list_sort(list(term)) as terms from r group by 1)"


def _rollup(b):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{10,}"), F.lit(0))
    return chunking.term_rollup(b.documents.select("source", words.alias("words")), "source", "words")


@query("term_rollup", f"WITH {_ROLLUP_SQL} select source, len(terms) as n_terms, sha256(array_to_string(terms, ' ')) as terms_hash from g")
def _term_rollup(b):
    return _rollup(b).select("source", F.size("terms").alias("n_terms"), F.sha2(F.array_join("terms", " "), 256).alias("terms_hash"))


@query(
    "rollup_stats",
    f"WITH {_ROLLUP_SQL}, s as (select distinct source from documents), j as (select coalesce(len(terms), 0) as n from s left join g using (source)) select count(*) as total, count_if(n > 0) as with_terms, avg(n) filter (n > 0) as avg_terms, max(n) as max_terms from j",
)
def _rollup_stats(b):
    return chunking.rollup_stats(b.documents.select("source").distinct().join(_rollup(b), "source", "left"), "terms")


@query(
    "doc_level_inherit",
    "select chunk_id, section, o.tag as doc_level_flag from hits left join (select doc_id, arg_min(flag, chunk_id) as tag from hits where window_idx = 1 group by 1) o using (doc_id)",
    "hits",
)
def _inherit(b):
    rows = b.hits.select("chunk_id", "doc_id", "section", "window_idx", "flag")
    return chunking.doc_level_inherit(rows, "doc_id", F.col("window_idx") == 1, F.col("chunk_id"), "flag").select("chunk_id", "section", "doc_level_flag")


def _clean_match_sql(x: str) -> str:
    low = f"regexp_replace(lower({x}), '\\$[^$]*\\$|\\\\[a-zA-Z]+\\{{[^}}]*\\}}|\\\\[a-zA-Z]+|#{{1,6}}\\s*|<[^>]+>|\\[\\^?\\d+\\]', '', 'g')"
    return f"regexp_replace(trim(regexp_replace({low}, '\\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g')"


def _grams_sql(text: str) -> str:
    words = f"list_filter(string_split({text}, ' '), lambda x: x <> '')"
    return f"case when length({text}) >= 20 and len({words}) >= 5 then list_distinct(list_transform(range(1, len({words}) - 3), lambda i: array_to_string(({words})[i:i + 4], ' '))) else [] end"


@query(
    "section_align",
    f"""WITH RECURSIVE {PACK_SQL}, {SECTIONS_SQL},
    c as (select doc_id, win as chunk_idx, {_clean_match_sql(f"string_agg(part, {NL2} order by i)")} as c from w join t using (doc_id, i) group by 1, 2),
    cg as (select *, {_grams_sql('c')} as cgrams from c where length(c) >= 20),
    s as (select doc_id, j, s.name as name, {_clean_match_sql('s.name')} as nc, {_clean_match_sql('s.content')} as body from (select doc_id, unnest(sections) as s, generate_subscripts(sections, 1) as j from sec)),
    g as (select *, {_grams_sql('body')} as grams from s),
    f as (select cg.doc_id, chunk_idx, c, j, name, nc, body, len(list_intersect(cgrams, grams)) as found from cg join g using (doc_id)),
    x as (select doc_id, chunk_idx, j, name, greatest(case when length(nc) >= 4 and contains(c, nc) then 100 + length(nc) else 0 end, case when found >= 2 then 50 + found * 10 else 0 end,
      case when length(body) >= 30 and contains(c, body) then 80 + length(body) else 0 end) as score from f)
    select doc_id, chunk_idx, max(score) as score, arg_max(name, (score, -j)) as section from x group by 1, 2 having max(score) >= 50""",
)
def _align(b):
    parts = b.documents.select("doc_id", F.filter(chunking.lines(F.col("text")), lambda p: F.length(p) >= 20).alias("parts"))
    wins = parts.withColumn("chunks", chunking.window_texts(F.col("parts"), chunking.pack(F.col("parts"), 120)))
    return chunking.section_align(wins.join(_sections(b), "doc_id"), "doc_id", "chunks", "sections")


@query("html_sections")
def _html(b):
    return html.html_sections(b.pages)


_NAMES = """n as (select o_orderkey, case when extract(month from o_orderdate) < 4 then 'Dr. John Smith, MD' when extract(month from o_orderdate) < 7 then 'Smith' || o_orderkey || ', Jane, PhD'
      when extract(month from o_orderdate) < 10 then 'Anna van der Berg, FRCR' else null end as first_author, 1 + cast(extract(day from o_orderdate) as int) // 11 as n_authors,
      'Published ' || cast(cast(o_orderdate as date) as varchar) as pub, 'https://doi.org/10.1000/x.' || o_orderkey || ' ' as doi from orders)"""
_CLEAN_NAME = r"""trim(regexp_replace(regexp_replace(regexp_replace(first_author, '(?i),?\s*\b(MD|M\.D\.|DO|D\.O\.|PhD|Ph\.D\.|MBBS|MBChB|FRCP|FRCS|FACS|FACP|MPH|MS|MSc|MA|MBA|RN|NP|PA|PA-C|Jr\.?|Sr\.?|III|IV|FRCR|FRANZCR|FASTRO|Professor|Prof\.?|Dr\.?)\b\.?', '', 'g'), ',\s*,', ',', 'g'), '\s+', ' ', 'g'), ' ,.')"""


@query(
    "cite_format",
    f"""WITH {_NAMES}, c as (select *, {_CLEAN_NAME} as name from n),
    l as (select *, case when contains(name, ',') then trim(split_part(name, ',', 1)) when contains(name, ' van der ') then 'van der ' || split_part(name, ' van der ', 2) else regexp_extract(name, '(\\S+)$', 1) end as surname from c),
    e as (select *, case when first_author is null or name = '' then 'Unknown author' when n_authors = 1 then name else surname || ' et al.' end as author_et_al, cast(regexp_extract(pub, '\\b((?:19|20)\\d{{2}})\\b', 1) as int) as year,
      nullif(trim(regexp_replace(doi, '^(?i)https?://(dx\\.)?doi\\.org/', '')), '') as clean_doi from l)
    select o_orderkey, author_et_al, year, author_et_al || ' (' || year || ') doi:' || clean_doi as citation from e""",
)
def _cite(b):
    month, day = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    first = (
        F.when(month < 4, F.lit("Dr. John Smith, MD"))
        .when(month < 7, F.concat(F.lit("Smith"), F.col("o_orderkey").cast("string"), F.lit(", Jane, PhD")))
        .when(month < 10, F.lit("Anna van der Berg, FRCR"))
    )
    count = 1 + F.floor(day / 11)
    others = F.array_repeat(F.lit("Li Wei"), (count - 1).cast("int"))
    authors = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array(first), others))
    pub = F.concat(F.lit("Published "), F.col("o_orderdate").cast("date").cast("string"))
    doi = F.concat(F.lit("https://doi.org/10.1000/x."), F.col("o_orderkey").cast("string"), F.lit(" "))
    et_al, year = citation.author_et_al(authors), citation.extract_year(pub)
    return b.orders.select("o_orderkey", et_al.alias("author_et_al"), year.alias("year"), citation.citation(et_al, year, None, None, citation.clean_doi(doi)).alias("citation"))


@query(
    "citation_repair",
    """WITH t as (select c_custkey as doc_id, case when c_nationkey < 8 then 'MD et al.' when c_nationkey < 16 then 'Smith et al.' else 'PhD, Jones et al.' end as before from customer),
    f as (select *, regexp_matches(before, '(?i)\\b(MD|PhD)\\b\\s*(et al|,)') as bad from t) select doc_id, before, case when before like 'PhD%' then 'Jones et al.' else 'Unknown author' end as after from f where bad""",
)
def _repair(b):
    nation = F.col("c_nationkey")
    before = F.when(nation < 8, "MD et al.").when(nation < 16, "Smith et al.").otherwise("PhD, Jones et al.")
    names = F.array(F.regexp_replace(before, r" et al\.$", ""), F.lit("Li Wei"))
    rows = b.customer.select(F.col("c_custkey").alias("doc_id"), before.alias("before"), names.alias("authors"))
    return citation.repair(rows, "doc_id", "before", "authors")


_PROFILE_JSON = """chr(123) || '"arms": [' || chr(123) || '"name": "A", "n": ' || cast(floor(o_totalprice / 1000) as bigint) || chr(125) || case when o_orderstatus = 'F' then ', ' || chr(123) || '"name": "B", "n": 7' || chr(125) else '' end
  || '], "criteria": [' || case when o_orderstatus = 'O' then '' else chr(123) || '"name": "age > ' || extract(day from o_orderdate) || '"' || chr(125) end || ']' || chr(125)"""


@query(
    "explode_profile",
    f"""WITH t as (select o_orderkey, cast({_PROFILE_JSON} as json) as d from orders),
    e as (select o_orderkey, 'arms' as child, unnest(cast(d->'arms' as json[])) as e, generate_subscripts(cast(d->'arms' as json[]), 1) - 1 as child_order from t
      union all select o_orderkey, 'criteria', unnest(cast(d->'criteria' as json[])), generate_subscripts(cast(d->'criteria' as json[]), 1) - 1 from t)
    select o_orderkey, child, child_order, json_extract_string(e, '$.name') as name, cast(json_extract_string(e, '$.n') as bigint) as n from e""",
)
def _explode_profile(b):
    rows = b.spark.sql("select o_orderkey, " + _PROFILE_JSON + " as d from {orders}", orders=b.orders)
    item = "array<struct<name:string,n:bigint>>"
    out = files.explode_profile(rows, "o_orderkey", "d", f"arms {item}, criteria {item}", ["arms", "criteria"])
    return out.select("o_orderkey", "child", "child_order", F.get_json_object("entry", "$.name").alias("name"), F.get_json_object("entry", "$.n").cast("bigint").alias("n"))


@query("scan_docs", "select lang as category, count(*) as docs, sum(n_chars) as chars from documents group by 1")
def _scan_docs(b):
    """Index files written under category folders, read back with the category taken from the path."""
    root = files.scratch_path(b.spark, "docs")
    body = F.to_json(F.struct("doc_id", "n_chars"))
    b.documents.select(body.alias("value"), F.col("lang").alias("category")).write.partitionBy("category").text(root)
    lines = b.spark.read.option("recursiveFileLookup", True).text(root)
    doc = F.from_json("value", "doc_id bigint, n_chars bigint")
    category = F.regexp_extract(F.input_file_name(), r"category=([^/]+)/", 1)
    return lines.select(category.alias("category"), doc.alias("doc")).groupBy("category").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("doc.n_chars").alias("chars")
    )


@query("scan_jsonl", "select doc_id, source, n_chars from documents where source not in ('src1', 'src2')")
def _scan_jsonl(b):
    path = files.scratch_path(b.spark, "jsonl")
    good = F.to_json(F.struct("doc_id", "source", "n_chars"))
    line = F.when(F.col("source") == "src1", F.concat(F.lit('{"doc_id": '), F.col("source"))).when(F.col("source") == "src2", F.lit("")).otherwise(good)
    b.documents.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    return files.read_jsonl(b.spark, path, schema)


@query("sink_manifest", "select page_id, url, length(html) as size from pages")
def _sink(b):
    path = files.scratch_path(b.spark, "manifest")
    files.write_manifest(b.pages.select("page_id", "url", F.length("html").alias("size")), path, "csv")
    return b.spark.read.option("header", True).schema("page_id bigint, size bigint, url string").csv(path).select("page_id", "url", "size")


@query("sink_tables", "select 'T' || l_linenumber as table_key, l_orderkey, cast(l_partkey as varchar) || '/' || l_returnflag as cells from lineitem")
def _sink_tables(b):
    path = files.scratch_path(b.spark, "tables")
    cells = F.array(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag"))
    key = F.concat(F.lit("T"), F.col("l_linenumber").cast("string"))
    files.write_tables(b.lineitem.select(key.alias("table_key"), cells.alias("cells")), path, "table_key", "cells")
    back = files.read_tables(b.spark, path, "table_key")
    return back.select("table_key", F.col("cells")[0].cast("bigint").alias("l_orderkey"), F.concat_ws("/", F.col("cells")[1], F.col("cells")[2]).alias("cells"))
