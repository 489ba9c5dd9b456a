"""The queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import conversations, decontamination, embeddings, exact_dedup, langid, language_model, line_dedup, mining, mixing, pieces, quality, simhash, token_store
from tidewatch.llm.common import crc_mod
from tidewatch.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "score", "nbest_scores", "nbest", "ids_crc32", "round_trip", "exact")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod(F.col("doc_id"), 4)
    model = langid.fit(docs.where(part != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(table(spark, sf_dir, "documents"), token_store.store_path(spark))
    return token_store.read_digests(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=crc_mod(F.col("doc_id"), 3) != 1)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = """
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) h
  from documents),
per as (
  select source, cast(sum(size) as bigint) source_size,
         row_number() over (order by (source is null), source) - 1 rk
  from sized group by source),
weighed as (
  select *, 3 * source_size cap, case rk % 3 when 0 then 5 when 1 then 2 else 1 end weight from per),
levels as (
  select *, cast(sum(source_size) over () - coalesce(sum(cap) over w, 0) as double)
            / cast(sum(weight) over () - coalesce(sum(weight) over w, 0) as double) lvl,
         row_number() over (order by cap / weight, rk) pos
  from weighed window w as (order by cap / weight, rk rows between unbounded preceding and 1 preceding)),
chosen as (select arg_min(lvl, pos) lvl from levels where lvl * weight <= cap),
goals as (
  select l.source, l.source_size, least(cast(l.cap as double), coalesce(c.lvl, 0.0) * l.weight) target
  from levels l cross join chosen c),
needs as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end times from goals),
run as (
  select s.doc_id, s.size, n.source_size, n.target, n.times, n.target - n.times * n.source_size need,
         sum(s.size) over (partition by s.source order by s.h range unbounded preceding) upto,
         sum(s.size) over (partition by s.source, s.h) unit
  from sized s join needs n on s.source is not distinct from n.source)
select doc_id, size, source_size, target,
       cast(size * (times + case when need > 0 and (upto < need or (upto - unit < need and 2 * (need - (upto - unit)) > unit))
                                 then 1 else 0 end) as bigint) taken
from run
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256
from t
"""


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id u, b.vec_id w from v a join v b
  on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select r.vec_id, l.w from r join l on r.c = l.u),
c as (select vec_id, min(c) component_id from r group by vec_id),
n as (select u, count(*) n from l group by u)
select c.vec_id, cast(coalesce(n.n, 0) as bigint) n_links, c.component_id, c.vec_id = c.component_id kept
from c left join n on n.u = c.vec_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages are the documents, a page's site is its source."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _lines_sql(rows: str, key: str) -> str:
    """The query over ``rows``: SQL of (key, site, text)."""
    return f"""
with rows_ as ({rows}),
lines as (
  select {key}, site, generate_subscripts(string_split(text, chr(10)), 1) pos, unnest(string_split(text, chr(10))) line from rows_),
totals as (select site, count(*) site_pages from rows_ group by site),
pages as (
  select site, line, count(distinct {key}) pages from lines where trim(line, ' ') <> '' group by site, line),
bad as (
  select p.site, p.line from pages p join totals t on p.site is not distinct from t.site
  where p.pages >= 3 and p.pages > t.site_pages * cast(0.05 as double)),
marked as (
  select l.*, b.line is not null bad from lines l
  left join bad b on l.site is not distinct from b.site and l.line = b.line),
found as (
  select {key}, cast(count(*) filter (where trim(line, ' ') <> '') as bigint) n_lines,
         cast(count(*) filter (where bad) as bigint) n_dropped,
         md5(coalesce(string_agg(line, chr(10) order by pos) filter (where not bad), '')) text_md5
  from marked group by {key})
select r.{key}, coalesce(f.n_lines, 0) n_lines, coalesce(f.n_dropped, 0) n_dropped, f.text_md5
from rows_ r left join found f on f.{key} = r.{key}
"""


OP8_SQL = _lines_sql("select doc_id, source site, text from documents", "doc_id")


def line_dedup_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages: a page's site is the host of its URL, its lines are the texts between its tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.text_of(F.col("html")).alias("text"))
    out = line_dedup.line_dedup(pages, site_col="host")
    return out.select("page_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


HOST_SQL = _lines_sql(
    r"""select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') site,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),
         '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g') text
  from pages""",
    "page_id",
)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    out = language_model.score_documents(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(vectors, F.col("id") % 100 == 0, label=label)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, cast(list_inner_product(a.q, b.q) as bigint) score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id positive_id, score positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
met as (
  select p.*, s.other_id negative_id, s.score negative_score,
         cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as integer) rank
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
   and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from met where rank <= 5
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    return conversations.digests(edits).withColumnRenamed("conv", "conv_id")


BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _least(g: int, options: list[str]) -> str:
    return f"list_min([{', '.join(options)}]) w{g}"


def _op12_sql() -> str:
    """Backwards over a conversation's rows: for each grammar state the least (cost, audit, repaired rows) to the end, as structs."""
    arcs = {0: [("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    name = {"u": "user", "a": "assistant"}

    def put(cost: str, letter: str, to: str, text: str | None) -> str:
        front = f"list_prepend({text}, {to}.t)" if text else f"{to}.t"
        return f"{{'c': {cost} + {to}.c, 's': '{letter}' || {to}.s, 't': {front}}}"

    def inserted(v: str, rows: str) -> str:
        for _ in range(3):
            rows = "select *, " + ", ".join(_least(g, [f"{v}{g}", *[put("5", "I", f"{v}{to}", f"'{name[c]}:'") for c, to in arcs[g]]]) for g in arcs) + f" from ({rows})"
            rows = f"select * exclude ({', '.join(f'{v}{g}' for g in arcs)}) rename ({', '.join(f'w{g} as {v}{g}' for g in arcs)}) from ({rows})"
        return rows

    def consumed(g: int) -> str:
        more = "case when fault = 'truncated' then 5 else 0 end"
        options = [put("2", "D", f"v{g}", None)]
        free = "fault in ('blank', 'duplicate')"
        keeps = [*arcs[g], *([("s", 1)] if g == 0 else [])]
        options += [f"case when not {free} and left(role, 1) = '{c}' then {put(more, 'K', f'v{to}', 'role || chr(58) || text')} end" for c, to in keeps]
        options += [f"case when not {free} then {put('1 + ' + more, 'R', f'v{to}', repr(name[c] + ':') + ' || text')} end" for c, to in arcs[g]]
        return f"list_min([{', '.join(options)}]) u{g}"

    end = ", ".join(f"{{'c': cast({0 if g in (0, 3) else 1000000} as bigint), 's': '', 't': cast([] as varchar[])}} v{g}" for g in arcs)
    step = "select conv_id, n - 1 n, " + ", ".join(consumed(g) for g in arcs) + " from (select p.conv_id, p.n, v0, v1, v2, v3, o.role, o.text, o.fault from path p join ordered o on o.conv_id is not distinct from p.conv_id and o.pos = p.n)"
    step = inserted("u", step)
    start = inserted("v", f"select conv_id, max(pos) n, {end} from ordered group by conv_id")
    return f"""
with recursive kinds as (
  select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
bits as (select distinct k, k s, cast(4294967295 as bigint) crc, 0 i from kinds),
crcs as (
  select * from bits
  union all
  select k, s, xor(crc >> 8, list_reduce(cast(range(0, 8) as bigint[]), lambda c, j: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as bigint)) else c >> 1 end,
                                    xor(crc & 255, cast(ascii(substr(s, i + 1, 1)) as bigint)))), i + 1
  from crcs where i < length(s)),
damaged as (
  select c.conv_id, c.turn,
         case when m = 4 then 'user' else coalesce(role, ' ') end as role,
         case when m = 1 then '' when m = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
         unnest(case when m = 3 then [1, 2] else [1] end) as copy
  from (select kinds.*, xor(crcs.crc, 4294967295) % 20 m from kinds join crcs on crcs.k = kinds.k and crcs.i = length(crcs.s)) c
  where m <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) pos from damaged),
ordered as (
  select *, case when trim(text, {BLANK_SQL}) = '' then 'blank'
                 when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
                 when right(rtrim(text, {BLANK_SQL}), 1) not in ('.', '!', '?') then 'truncated' else '' end fault,
         lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) pair
  from placed),
path as (
  select conv_id, n, v0, v1, v2, v3 from ({start})
  union all
  select conv_id, n, u0 v0, u1 v1, u2 v2, u3 v3 from ({step})),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
         count(*) filter (where fault = 'blank') blank, count(*) filter (where fault = 'duplicate') duplicate,
         count(*) filter (where fault = 'truncated') truncated,
         count(*) filter (where pair not in ('su', 'ua', 'au')) illegal
  from ordered group by conv_id)
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
       coalesce(illegal, 0) illegal, coalesce(p.v0.c, 0) as cost, coalesce(p.v0.s, '') as audit,
       sha256(coalesce(array_to_string(p.v0.t, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) c
left join counts on counts.conv_id is not distinct from c.conv_id
left join path p on p.conv_id is not distinct from c.conv_id and p.n = 0
"""


OP12_SQL = _op12_sql()


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return documents.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = """
with texts as (
  select row_number() over () r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
items as (
  select coalesce(cast(item_id as varchar), '') item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
windows as (
  select distinct item, least(len(w), 10) n, array_to_string(w[p:p + 9], ' ') t
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from items where len(w) > 0)),
sizes as (select distinct n from windows),
places as (
  select r, n, p, array_to_string(w[p:p + n - 1], ' ') t
  from (select r, n, w, unnest(range(1, len(w) - n + 2)) p from texts, sizes)),
met as (select r, p, p.n, item from places p join windows using (n, t)),
hit as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + n)) q from met) group by r),
found as (select r, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct r, item from met) group by r)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from texts left join hit using (r) left join found using (r)
"""


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_token_store": op3_token_store,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_language_model": op10_language_model,
}

ORACLES: dict[str, str] = {"op5_mixing": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL}

#: Searches and repairs, and a dealt operator on another table of the tests.
MORE_QUERIES: dict[str, Query] = {
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_decontamination": op13_decontamination,
    "line_dedup_by_host": line_dedup_by_host,
}
MORE_ORACLES: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_decontamination": OP13_SQL, "line_dedup_by_host": HOST_SQL}
