"""The registered queries of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, licenses, lines, media, packing, sharding, simhash, toolcalls, toxicity, trie, warc
from .common import table

SITES = 10
MAX_TRAIN = 4000
SHARDS = 24


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_as_png(table(spark, sf_dir, "documents")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "range_no", "place")


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_boilerplate(table(spark, sf_dir, "documents"), SITES)
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op5_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_from_tables(docs, table(spark, sf_dir, "labels"), MAX_TRAIN)
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 4)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), 1024, 2)


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.even_tree(SHARDS))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.calls_from_conversations(table(spark, sf_dir, "conversations"))
    linked = toolcalls.link_tool_calls(calls, results, toolcalls.SCHEMAS)
    return linked.select("conv_id", "call_id", "name", F.col("level").cast("long").alias("level"), "place", "n_results", "valid", "errors", "canonical", "result_position")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_png_media, op2_byte_bpe, op3_warc_index, op4_line_spread, op5_embedding_lsh, op6_toxicity, op7_simhash_grid, op8_best_fit, op9_hash_tree, op10_tool_calls, op11_prefix_trie, op12_divergence_cube, op13_license_scan, pipeline)}

_LINES = "select doc_id, source, pos, line from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)"


#: CRC-32 of a decimal number, a bit at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_WORD = "[a-z\\x{80}-\\x{10FFFF}]+"
_SMALL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op11_prefix_trie": """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(r)::varchar, ':', r, x))) - 1 as i, concat(length(r)::varchar, ':', r, x) as s, strlen(x) as b
  from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null)),
c as (select conv_id, count(*) as n, conv_id - conv_id % 5 as donor, {crc} % 9 as h from t group by conv_id),
g as (select c.conv_id, c.h, least(c.h, coalesce(d.n, 0)) as given from c left join c d on c.donor = d.conv_id),
re as (select c.conv_id, t.i as pos, t.s, t.b from c join t on t.conv_id = c.donor and t.i < c.h
  union all select g.conv_id, g.given + t.i - g.h, t.s, t.b from g join t on t.conv_id = g.conv_id and t.i >= g.h),
pre as (select conv_id, pos + 1 as depth, list(s) over w as k, b from re window w as (partition by conv_id order by pos rows unbounded preceding) union all select conv_id, 0, [], 0 from c),
full_ as (select conv_id, max_by(k, depth) as k from pre group by conv_id),
ends as (select k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as e from full_ group by k),
node as (select depth, k, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(b) as saved from pre group by depth, k),
kid as (select k[:-2] as k, count(*) as n from node where depth > 0 group by 1),
under as (select a.k, sum(n.saved)::bigint as saved, count(*) filter (where kid.n is null) as leaves from (select distinct a.k, b.k as low from pre a join pre b on a.conv_id = b.conv_id and a.depth <= b.depth) a join node n on n.k = a.low left join kid on kid.k = n.k group by a.k)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(kid.n, 0) as n_children, under.leaves as n_leaves, under.saved as saved_tokens, coalesce(ends.e, sha256('')) as ends_sha256, q.n as n_sequences
from node n left join node up on n.depth > 0 and up.k = n.k[:-2] left join kid on kid.k = n.k join under on under.k = n.k left join ends on ends.k = n.k
join (select p.k, count(distinct f.k) as n from pre p join full_ f using (conv_id) group by p.k) q on q.k = n.k""".replace("{crc}", _CRC),
    "op12_divergence_cube": f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_SMALL.format("text")}, '{_WORD}') as w from documents),
t as (select doc_id, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct doc_id) >= 10),
gs as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(n) as n from kept group by lang),
cnt as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
tot as (select lang, source, coalesce(sum(cnt.n), 0) as n from gs left join cnt using (lang, source) group by all),
p as (select tot.lang, tot.source, kept.term, coalesce(cnt.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(cnt.n, 0) + 2)) // (tot.n + 2 * v.v) as p, 1 + (1000000000::hugeint * (kept.n + 2)) // (v.n + 2 * v.v) as q from tot join v using (lang) join kept using (lang) left join cnt on cnt.lang = tot.lang and cnt.source = tot.source and cnt.term = kept.term),
pairs as (select a.lang, a.source, b.source as item, coalesce((select sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value from gs a join gs b on a.lang = b.lang and a.source <> b.source),
terms as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all select lang, source, 'term', item, value::bigint, r::int from (select *, row_number() over (partition by lang, source order by value desc, item) as r from terms) where r <= 10""",
    "op4_line_spread": f"""
with l as ({_LINES}),
spread as (select line, first(doc_id order by doc_id, pos) as keep_id, first(pos order by doc_id, pos) as keep_at from l where length(trim(line)) > 0 group by line having count(distinct source) >= {SITES}),
m as (select l.doc_id, l.pos, l.line, s.line is not null and not (l.doc_id = s.keep_id and l.pos = s.keep_at) as gone from l left join spread s on l.line = s.line),
t as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept from m group by doc_id)
select doc_id, n_lines, n_removed, length(kept) as n_chars_kept, md5(kept) as text_md5 from t""",
}
