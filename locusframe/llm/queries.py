"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import chat, conversation_trie, hash_search, line_dedup, media, mixing, ngram_join, packing, quality, substring_dedup, toxicity, url_trie, vector_codes
from locusframe.llm.common import final_table, materialise, table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _fold(c: str = "doc_id"):
    return F.crc32(F.col(c).cast("string")) % 5


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("kept", "text")


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(_fold() != 0))
    return quality.score(docs, model).select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.decode(media.store(table(spark, sf_dir, "documents")))
    payload = F.col("samples")
    return files.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("frames").alias("n_frames"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hash_search.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(_fold() != 0))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    log = lambda: chat.as_log(rows.unionAll(said))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = ["conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")]
    return final_table(lambda: materialise(chat.read_back(chat.chat(log(), ["seq", "step"])).select(*digest), "chats"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ordinal_quality, op3_suffix_array, op4_media_columns, op5_packing, op6_url_filters, op7_ngram_jaccard, op8_temperature_mixing, op9_multi_index_hashing, op10_toxicity, op11_chat_formatting, op12_conversation_trie, op13_filtering_lloyd)}

ORACLES = {
    "op1_line_dedup": """
with d as (select doc_id, coalesce(text, '') as text from documents),
raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
l as (select *, trim(line, ' ' || chr(9) || chr(13)) as x from raw),
n as (select *, row_number() over (partition by doc_id order by i) as k, len(regexp_extract_all(x, '[^ ' || chr(9) || chr(13) || ']+')) as words from l where x <> ''),
u as (select doc_id, k, 3 as size, x || chr(10) || lead(x) over w || chr(10) || lead(x, 2) over w as unit from n window w as (partition by doc_id order by k)
      union all select doc_id, k, 1, x from n where words >= 50
      union all select doc_id, k, 2, x || chr(10) || lead(x) over w || chr(10) from n window w as (partition by doc_id order by k) qualify words < 50 and lead(words) over w < 50 and words + lead(words) over w >= 50),
r as (select *, row_number() over (partition by size, unit order by doc_id, k) as nth from u where unit is not null),
g as (select distinct doc_id, k + s as k from r, (values (0), (1), (2)) t(s) where nth > 1 and s < size),
m as (select n.*, g.k is not null as gone from n left join g using (doc_id, k)),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by k), false) as head from m),
s as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, count(*) filter (head) as n_runs from e group by doc_id),
t as (select l.doc_id, string_agg(line, chr(10) order by i) as text from l left join (select doc_id, i from m where gone) z using (doc_id, i) where z.i is null group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs, coalesce(t.text, '') as text
from d left join s using (doc_id) left join t using (doc_id)""",
    "op6_url_filters": """
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
rules as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(v, rh, rp)),
j as (select p.*, rh || rp as rule, v, row_number() over (partition by page_id, host, path order by length(rh || rp) desc nulls last) as k
      from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from j where k = 1""",
    "op11_chat_formatting": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
e as (select *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|ROLE\]|SAYS\]))', '\1\\\2', 'g')) as n, length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]|ROLE\]|SAYS\]))', '\1\\\2', 'g')) as m from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(n + case role when 'user' then 15 when 'assistant' then 6 else m + 23 end) as bigint) as formatted_chars
from e group by conv_id""",
    "op12_conversation_trie": """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth,
                  md5(coalesce(role, '')) || md5(coalesce(text, '')) as x, cast(strlen(coalesce(text, '')) as bigint) as bytes from conversations where conv_id is not null),
c as (select conv_id, count(*) as n, xor(list_reduce([4294967295] || [cast(ord(z) as bigint) for z in string_split(cast(conv_id as varchar), '')],
             lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 9 as h from t group by conv_id),
k as (select c.*, least(h, coalesce(b.m, 0)) as taken from c left join (select conv_id as b, n as m from c) b on b.b = c.conv_id - c.conv_id % 5),
r as (select k.conv_id, nth as pos, x, bytes from k join t on t.conv_id = k.conv_id - k.conv_id % 5 and nth <= h
      union all select conv_id, taken + nth - h, x, bytes from k join t using (conv_id) where nth > h),
p as (select *, md5(string_agg(x, '') over (partition by conv_id order by pos)) as key from r),
m as (select conv_id, pos as depth, key, coalesce(lag(key) over (partition by conv_id order by pos), '') as parent, bytes, pos = max(pos) over (partition by conv_id) as ends from p
      union all select conv_id, 0, '', null, 0, conv_id not in (select conv_id from r) from k),
n as (select depth, key, min(conv_id) as conv_id, any_value(parent) as parent, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved,
             sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256 from m group by depth, key),
ch as (select parent, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
v as (select n.*, coalesce(n_children, 0) as n_children from n left join ch on ch.parent = n.key and ch.depth = n.depth),
a as (select a.depth, a.key, sum(v.saved) as saved_tokens, count(*) filter (v.n_children = 0) as n_leaves
      from v join m w on w.conv_id = v.conv_id and w.depth = v.depth and w.key = v.key join m a on a.conv_id = w.conv_id and a.depth <= w.depth group by a.depth, a.key)
select v.conv_id, cast(v.depth as bigint) as depth, u.conv_id as parent_conv_id, v.n_convs, v.n_children, a.n_leaves, cast(a.saved_tokens as bigint) as saved_tokens, v.ends_sha256
from v join a on a.depth = v.depth and a.key = v.key left join n u on u.depth = v.depth - 1 and u.key = v.parent""",
    "op13_filtering_lloyd": """
with v as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 as id, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select id, unnest(q) as x, generate_subscripts(q, 1) - 1 as k, len(q) // 16 as w from v),
e as materialized (select id, k // w as part, k % w as dim, x from u),
c0 as (select part, id as entry, dim, x from e where id < 64),
a0 as (select id, part, entry, d from (select id, e.part, entry, sum((e.x - c.x) * (e.x - c.x)) as d, row_number() over (partition by id, e.part order by sum((e.x - c.x) * (e.x - c.x)), entry) as nth
                             from e join c0 c on c.part = e.part and c.dim = e.dim group by id, e.part, entry) where nth = 1),
c1 as (select part, entry, dim, cast(coalesce((s - ((s % n) + n) % n) // n, x) as bigint) as x from c0 left join (select part, entry, dim, cast(sum(x) as bigint) as s, count(*) as n from a0 join e using (id, part) group by all) using (part, entry, dim)),
a1 as (select id, part, entry, d from (select id, e.part, entry, sum((e.x - c.x) * (e.x - c.x)) as d, row_number() over (partition by id, e.part order by sum((e.x - c.x) * (e.x - c.x)), entry) as nth
                             from e join c1 c on c.part = e.part and c.dim = e.dim group by id, e.part, entry) where nth = 1),
c2 as (select part, entry, dim, cast(coalesce((s - ((s % n) + n) % n) // n, x) as bigint) as x from c1 left join (select part, entry, dim, cast(sum(x) as bigint) as s, count(*) as n from a1 join e using (id, part) group by all) using (part, entry, dim)),
a2 as (select id, part, entry, d from (select id, e.part, entry, sum((e.x - c.x) * (e.x - c.x)) as d, row_number() over (partition by id, e.part order by sum((e.x - c.x) * (e.x - c.x)), entry) as nth
                             from e join c2 c on c.part = e.part and c.dim = e.dim group by id, e.part, entry) where nth = 1),
h as (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, dim)) as codebooks_sha256 from c2),
r as (select id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a2 group by id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v join r using (id) cross join h""",
}
