"""Queries over pages and documents: sources, string rules, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import chunking, html, scalars, text
from corpusflow.queries.registry import query
from corpusflow.session import table


def _count(column: str, words: list[str]) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, ' {w} ', ''))) // {len(w) + 2}" for w in words)


def _starts(column: str, openers: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({column}, '{o}')" for o in openers) + ")"


@query("select page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) as title from pages")
def src09_page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("""with h as (select distinct page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) as href from pages)
select page_id, href from h where not regexp_matches(href, '^(#|javascript:|mailto:|tel:|data:)')""")
def src10_page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as site_id from pages")
def src11_site_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.site(F.col("url")).alias("site_id"))


@query("select doc_id, sha256(text) as content_hash from documents")
def src12_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("select page_id, strlen(html) as page_bytes from pages where strlen(html) <= 2097152 and trim(html) <> ''")
def src04_accepted_pages(spark, sf_dir):
    from corpusflow.sources.web import accepted

    pages = table(spark, sf_dir, "pages").withColumns({"depth": F.lit(0), "allowed": F.lit(True), "content_type": F.lit("text/html"), "status": F.lit(200), "markdown": F.col("html")})
    return accepted(pages).select("page_id", F.octet_length("html").cast("long").alias("page_bytes"))


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.a.b') as missing from events")
def src19_json_path(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", scalars.json_path(props, "k").alias("k"), scalars.json_path(props, "a.b").alias("missing"))


_LINES = r"list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '\s+$', ''))"


@query(rf"""with l as (select doc_id, {_LINES} as lines from documents),
j as (select doc_id, regexp_replace(array_to_string(list_transform(lines, lambda x: case when regexp_matches(x, '[\p{{L}}\p{{N}}_]') then x else '' end), chr(10)), '([ \t]*\n){{3,}}', chr(10) || chr(10), 'g') as t from l)
select doc_id, sha256(case when trim(t, chr(10) || ' ' || chr(9)) = '' then '' else trim(t, chr(10)) || chr(10) end) as normalized_sha256 from j""")
def str01_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalized(F.col("text")), 256).alias("normalized_sha256"))


@query(rf"""with s as (select doc_id, text, ' ' || regexp_replace(lower(text[1:2000]), '^\s+|\s+$', '', 'g') || ' ' as sample from documents)
select doc_id, case when text = '' then 'id' when {_starts('ltrim(sample)', text.ID_OPENERS)} then 'id' when {_starts('ltrim(sample)', text.EN_OPENERS)} then 'en'
when {_count('sample', text.EN_MARKERS)} > {_count('sample', text.ID_MARKERS)} then 'en' else 'id' end as language from s""")
def str06_site_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.site_language(F.col("text")).alias("language"))


@query("select doc_id, case when length(text) < 20 then 'en' when " + " + ".join(f"contains(lower(text), ' {w} ')::int" for w in text.ITEM_MARKERS) + " >= 2 then 'id' else 'en' end as language from documents")
def str07_item_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.item_language(F.col("text")).alias("language"))


@query(f"with s as (select doc_id, lower(text[1:300]) as sample from documents) select doc_id, case when {_count('sample', text.REFUSAL_ID_MARKERS)} > {_count('sample', text.REFUSAL_EN_MARKERS)} then 'id' else 'en' end as language from s")
def str08_refusal_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.refusal_language(F.col("text")).alias("language"))


@query(f"select doc_id, length(text) - length(translate(text, '{text.INVISIBLE}', '')) as invisible from documents")
def str10_invisible_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.invisible_count(F.col("text")).alias("invisible"))


@query(f"select doc_id, md5(translate(text, '{text.LOOKALIKES}', '{text.LATIN}')) as folded_md5 from documents")
def str11_lookalikes_folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.latin_for_lookalikes(F.col("text"))).alias("folded_md5"))


@query(f"select doc_id, md5(translate(text || ' {text.ENCLOSED}', '{text.ENCLOSED}', '{text.OPENED}')) as opened_md5 from documents")
def str12_enclosed_letters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.opened_letters(F.concat("text", F.lit(" " + text.ENCLOSED)))).alias("opened_md5"))


@query("select doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) as rotated_md5 from documents")
def str16_rot13(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.rot13(F.col("text"))).alias("rotated_md5"))


@query(r"select page_id, unnest(regexp_extract_all(html || ' ' || url, 'https?://\S+')) as url from pages")
def str20_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.urls_in(F.concat("html", F.lit(" "), "url"))).alias("url"))


@query(r"select page_id, trim(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) || ' ' || url) as body from pages")
def str21_bare_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.with_title_if_bare_url(F.col("url"), html.title(F.col("html"))).alias("body"))


@query("select doc_id, 'doc:' || source || ':' || sha256(doc_id::varchar)[1:12] as file_id, sha256(text) as chunk_hash, sha256(source || '::glossary::' || text) as glossary_hash from documents")
def str22_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("file_id"), F.sha2("text", 256).alias("chunk_hash"), F.sha2(F.concat("source", F.lit("::glossary::"), "text"), 256).alias("glossary_hash"))


@query(r"select page_id, regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') as file_name from pages")
def str30_file_safe(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.file_safe(F.col("url")).alias("file_name"))


_SPELLS = "select n_nationkey, case n_nationkey % 4 when 0 then 'U' || n_name[1:1] || 'O' when 1 then 'U' || n_name[1:1] || 'X' when 2 then 'UO' else 'XQ' || n_nationkey end as acronym, n_nationkey % 4 < 3 as spells from nation"


@query(_SPELLS)
def str05_initials(spark, sf_dir):
    """Initials that agree, that are one edit away, and that do not agree."""
    first, way = F.substring("n_name", 1, 1), F.col("n_nationkey") % 4
    rows = table(spark, sf_dir, "nation").withColumn("acronym", F.when(way == 0, F.concat(F.lit("U"), first, F.lit("O"))).when(way == 1, F.concat(F.lit("U"), first, F.lit("X"))).when(way == 2, "UO").otherwise(F.concat(F.lit("XQ"), "n_nationkey")))
    name = F.concat(F.lit("United and "), F.initcap(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(" Office"))
    return rows.select("n_nationkey", "acronym", text.initials_spell(name, F.col("acronym")).alias("spells"))


@query("select doc_id, unnest(list_filter([lang, trim(source), doc_id::varchar], lambda x: x <> '')) as value from documents")
def flt17_csv_set(spark, sf_dir):
    setting = F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" , ,"), F.coalesce("source", F.lit("")), F.lit(",,"), "doc_id", F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.csv_set(setting)).alias("value"))


@query(r"""with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents where not contains(text, chr(10) || chr(10)))
select doc_id, 1 + len(regexp_extract_all(t, '[.!?]\s+[A-ZÄÖÜ]')) as sentences from t where t <> ''""")
def str09_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\n\n")) & F.regexp_like("text", F.lit(r"\S")))
    return docs.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("""select n_regionkey::varchar as site_id, acronym, min_by(full_name, n_nationkey) as full_name from
(select n_regionkey, n_nationkey, 'U' || n_name[1:1] || 'O' as acronym, 'United ' || replace(n_name, ' ', '') || ' Office' as full_name from nation) group by 1, 2""")
def str04_acronyms(spark, sf_dir):
    from corpusflow.plans.ingest import acronyms

    first, name = F.substring("n_name", 1, 1), F.concat(F.lit("United "), F.replace("n_name", F.lit(" "), F.lit("")), F.lit(" Office"))
    short = F.concat(F.lit("U"), first, F.lit("O"))
    said = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("we met: "), name, F.lit(" ("), short, F.lit(") there"))).otherwise(F.concat(F.lit("so "), short, F.lit(" ("), name, F.lit(") came")))
    docs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("site_id"), F.col("n_nationkey").alias("page_id"), F.concat(said, F.lit("; not Some Other Thing (ZZZ)")).alias("text"))
    return acronyms(docs)


@query("""select conv_id, turn, case when conv_id % 2 = 0 then role || turn when text is null then null else text end as content from conversations""")
def str31_content_text(spark, sf_dir):
    blocks = F.concat(F.lit('["'), "role", F.lit('", {"type": "text", "text": "'), "turn", F.lit('"}, {"type": "image"}]'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_text(F.when(F.col("conv_id") % 2 == 0, blocks).otherwise(F.col("text"))).alias("content"))


@query("""select conv_id, turn, md5(text || chr(10) || chr(10) || 'Reply with ONLY valid JSON that matches this schema. No prose, no markdown fences, no commentary:' || chr(10) || '```json' || chr(10) || '{"type": "' || role || '"}' || chr(10) || '```') as prompt_md5 from conversations""")
def str32_schema_prompt(spark, sf_dir):
    schema = F.concat(F.lit('{"type": "'), "role", F.lit('"}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.with_json_schema(F.col("text"), schema)).alias("prompt_md5"))


@query("select doc_id, case when doc_id % 2 = 0 then '{\"id\": ' || doc_id || '}' else '{}' end as json from documents")
def str28_salvaged_json(spark, sf_dir):
    fenced = F.concat(F.lit('Sure:\n```json\n{"id": '), "doc_id", F.lit("}\n``` done"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.salvaged_json(F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.concat(F.lit("{broken "), F.col("doc_id")))).alias("json"))


@query(r"""with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as words from documents where not contains(text, '://')),
n as (select doc_id, words, unnest(range(0, greatest(0, ceil((len(words) - 512) / 448.0))::int + 1)) as window_no from w where len(words) > 0)
select doc_id, window_no, md5(array_to_string(words[window_no * 448 + 1:window_no * 448 + 512], ' ')) as window_md5 from n""")
def win05_word_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("://")) & (F.regexp_like("text", F.lit(r"\S"))))
    return docs.select("doc_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("window_no", "w")).select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.md5("w").alias("window_md5"))


@query("""with s as (select doc_id, text, unnest(case when length(text) <= 2000 then [1] else range(1, length(text) + 1, 1500) end) as start from documents)
select doc_id, start, md5(text[start:start + 1999]) as window_md5 from s""")
def win06_char_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.char_windows(F.col("text"))).alias("i", "w"))
    return rows.select("doc_id", (F.col("i") * 1500 + 1).cast("long").alias("start"), F.md5("w").alias("window_md5"))


@query(r"""with p as (select doc_id, unnest(string_split(text, chr(10))) as piece, generate_subscripts(string_split(text, chr(10)), 1) - 1 as chunk_index from documents),
l as (select *, coalesce(lag(piece) over (partition by doc_id order by chunk_index), '') as before from p),
w as (select *, case when length(before) > 40 then before[length(before) - 39:] else before end as tail from l),
t as (select *, case when regexp_matches(tail, '\s') then regexp_replace(tail, '^\S*\s', '') else '' end as snapped from w),
j as (select doc_id, chunk_index, case when snapped = '' then piece when regexp_matches(snapped, '[ \n\t]$') then snapped || piece else snapped || ' ' || piece end as joined from t),
s as (select doc_id, chunk_index, regexp_replace(joined, '^\s+|\s+$', '', 'g') as text,
last_value(case when regexp_matches(joined, '^#{2,4} ') then trim(regexp_replace(joined, '^#+', '')) end ignore nulls) over (partition by doc_id order by chunk_index) as title from j)
select doc_id, chunk_index, coalesce(title, '') as section_title, sha256(text) as chunk_hash from s where text <> ''""")
def win02_chunk_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("pieces"))
    return chunking.chunks(docs, "pieces", overlap=40, size=2048).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "section_title", "chunk_hash")


@query("""with p as (select page_id, url, string_split(html, '><') as pieces from pages), u as (select page_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) - 1 as chunk_index from p),
l as (select *, coalesce(lag(piece) over (partition by page_id order by chunk_index), '') as before from u),
w as (select *, case when length(before) > 20 then before[length(before) - 19:] else before end as tail from l),
t as (select *, case when regexp_matches(tail, '\\s') then regexp_replace(tail, '^\\S*\\s', '') else '' end as snapped from w),
j as (select page_id, chunk_index, regexp_replace(case when snapped = '' then piece when regexp_matches(snapped, '[ \\n\\t]$') then snapped || piece else snapped || ' ' || piece end, '^\\s+|\\s+$', '', 'g') as text from t)
select page_id, 'one address' as source_url, chunk_index, sha256(text) as chunk_hash from j where text <> ''""")
def win02_chunks_of_one_address(spark, sf_dir):
    """All pages under one address: their chunks stay apart."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("one address").alias("source_url"), F.split("html", "><").alias("pieces"))
    return chunking.chunks(pages, "pieces", overlap=20, size=2048).select("page_id", "source_url", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_hash")


@query()
def str02_recursive_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", chunking.split_markdown(F.col("text")).alias("pieces"))
    return chunking.chunks(docs, "pieces").select("doc_id", "chunk_index", "section_title", "chunk_hash")


@query()
def src08_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.markdown(F.col("html")).alias("markdown"))


@query()
def src03_crawl(spark, sf_dir):
    from corpusflow.sources.web import crawled

    pages = table(spark, sf_dir, "pages")
    return crawled(pages, pages.select(F.regexp_replace("url", "#.*$", "").alias("url")), max_depth=1, max_pages=None)
