"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, license, merkle, minhash, packing, sharding, simhash, sstable, topk, urlrules, variants, warc
from .common import table

# Host and path rules of op9.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"), public_tokenizers.path("piece_bpe_32k.model"))
    told = langid.predict(docs, model)
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), decontam.Params(unnamed=True))


def op7_token_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.drop("ids")


def op9_url_rule_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


def op10_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.verified(docs, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], cut, tampered)


def op13_edit_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_license_index": op2_license_index,
    "op3_threshold_topk": op3_threshold_topk,
    "op4_segmentation_langid": op4_segmentation_langid,
    "op5_bounded_ring_shards": op5_bounded_ring_shards,
    "op6_edit_decontamination": op6_edit_decontamination,
    "op7_token_sstables": op7_token_sstables,
    "op8_concatenate_and_cut": op8_concatenate_and_cut,
    "op9_url_rule_sweep": op9_url_rule_sweep,
    "op10_minmax_near_duplicates": op10_minmax_near_duplicates,
    "op11_simhash_pigeonring": op11_simhash_pigeonring,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_edit_neighbourhoods": op13_edit_neighbourhoods,
}

ORACLE_SQL = {
    "op1_warc_chunks": """
        with p as (
          select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(encode(coalesce(html, ''))) as h from pages
        ), g as (
          select *, case when count(*) over w > 1 then max(page_id) over w end as response from p window w as (partition by h, payload_bytes)
        )
        select page_id, payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
          case when response is null or response = page_id then 'response' else 'revisit' end as record_type,
          case when response <> page_id then response end as refers_to,
          coalesce(url, 'urn:page:' || page_id) as target_uri,
          case when response <> page_id then 1 else greatest(1, ceil(payload_bytes / 262144.0)) end::bigint as chunks
        from g""",
    "op3_threshold_topk": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
        ), s as (
          select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
          from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
        )
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
        from s qualify rank <= 5""",
    "op9_url_rule_sweep": """
        with rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
          ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), u as (
          select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages
        ), f as (
          select page_id, host, path, h || p as rule, v from u left join rules
            on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        )
        select page_id, any_value(host) as host, any_value(path) as path, arg_max(rule, length(rule)) as rule,
          coalesce(arg_max(v, length(rule)), 'allow') as verdict
        from f group by page_id""",
    "op10_minmax_near_duplicates": r"""
        with recursive w as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), s as (
          select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w
        ), u as (select doc_id, unnest(s) as x from s),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
        links as (
          select a, b from pairs join s x on x.doc_id = a join s y on y.doc_id = b where 100 * k >= 85 * (len(x.s) + len(y.s) - k)
        ), both_ways as (select a, b from links union all select b, a from links),
        reach(doc_id, r) as (
          select doc_id, doc_id from s union select e.b, reach.r from reach join both_ways e on e.a = reach.doc_id
        )
        select doc_id, any_value(len(s.s)) as n_shingles, min(r) as component_id, min(r) = doc_id as kept from reach join s using (doc_id) group by doc_id""",
    "op12_merkle_manifest": r"""
        with recursive crc(i, k, c) as (
          select i, 0, i from range(256) t(i) union all
          select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8
        ), codes as (select list(c order by i) as t from crc where k = 8),
        d as (
          select doc_id, source, lang, n_chars, text, xor(4294967295, list_reduce(list_prepend(4294967295,
            list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
            lambda a, b: xor(a >> 8, codes.t[1 + (xor(a, b) & 255)]))) % 2 = 0 as tampered from documents, codes
        ), f as (
          select doc_id, source, text, replace(text, chr(10), '') as cut, tampered, concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head from d
        ), l as (
          select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
            case when tampered then sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) end as other from f
        ), leaves as (
          select doc_id, dense_rank() over (order by source is not null, encode(source)) - 1 as tree,
            row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, leaf, coalesce(other, leaf) as shown from l
        ), nodes(tree, level, idx, digest, n) as (
          select tree, 0, idx, leaf, count(*) over (partition by tree) from leaves union all
          select tree, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (n + 2) // 3 from nodes where n > 1 group by tree, level, idx // 3, n
        ), crown(level, idx, digest, n) as (
          select 0, tree, digest, count(*) over () from nodes where n = 1 union all
          select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (n + 2) // 3 from crown where n > 1 group by level, idx // 3, n
        ), steps as (
          select tree, level, idx, list(idx order by idx) over w as places, list(digest order by idx) over w as run from nodes where n > 1 window w as (partition by tree, level, idx // 3)
        ), crown_steps as (
          select level, idx, list(idx order by idx) over w as places, list(digest order by idx) over w as run from crown where n > 1 window w as (partition by level, idx // 3)
        ), around as (
          select tree, level, idx, array_to_string(list_filter(run, lambda x, i: places[i] < idx), '') as before, array_to_string(list_filter(run, lambda x, i: places[i] > idx), '') as after from steps
        ), crown_around as (
          select level, idx, array_to_string(list_filter(run, lambda x, i: places[i] < idx), '') as before, array_to_string(list_filter(run, lambda x, i: places[i] > idx), '') as after from crown_steps
        ), way(id, tree, level, idx, h, proof) as (
          select tree * 1000000000 + idx, tree, 0, idx, shown, '' from leaves union all
          select id, tree, level + 1, idx // 3, sha256(before || h || after), proof || before || after from way join around using (tree, level, idx)
        ), done as (select id, tree, arg_max(h, level) as h, arg_max(proof, level) as proof from way group by id, tree),
        rise(id, level, idx, h, proof) as (
          select id, 0, tree, h, proof from done union all
          select id, level + 1, idx // 3, sha256(before || h || after), proof || before || after from rise join crown_around using (level, idx)
        ), last as (select id, arg_max(h, level) as folded_root, sha256(arg_max(proof, level)) as proof_sha256 from rise group by id),
        numbered as (select tree * 1000000000 + idx as id, * from leaves)
        select doc_id, leaf, s.digest as subroot, r.digest as root, proof_sha256, folded_root, folded_root = r.digest as verified
        from numbered join last using (id) join (select tree, digest from nodes where n = 1) s using (tree), (select digest from crown where n = 1) r""",
    "op13_edit_neighbourhoods": r"""
        with recursive crc(i, k, c) as (
          select i, 0, i from range(256) t(i) union all
          select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8
        ), codes as (select list(c order by i) as t from crc where k = 8),
        runs as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
        low as (
          select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs where length(run) >= 7 group by all
        ), points as (
          select doc_id, run, n, list_transform(range(1, length(s) + 1), lambda i: unicode(substr(s, i::int, 1))::bigint) as p
          from (select *, coalesce(doc_id::varchar, '') || ':' || run as s from low)
        ), hashed as (
          select run, n, xor(4294967295, list_reduce(list_prepend(4294967295,
            flatten(list_transform(p, lambda c: case when c < 128 then [c] else [192 | (c >> 6), 128 | (c & 63)] end))),
            lambda a, b: xor(a >> 8, codes.t[1 + (xor(a, b) & 255)]))) as h from points, codes
        ), kept as (
          select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
        ), v as (select word, sum(n)::bigint as n from kept where length(word) >= 7 group by word having sum(n) >= 2),
        cut as (select distinct word, left(word, i::int - 1) || substr(word, i::int + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from v)),
        holes as (select word, left(word, i::int - 1) || '.' || substr(word, i::int + 1) as hole from (select word, unnest(range(1, length(word) + 1)) as i from v)),
        near as (
          select a.word, b.word as near from holes a join holes b on a.hole = b.hole and a.word <> b.word
          union select cut.word, v.word from cut join v on v.word = rest
          union select v.word, cut.word from cut join v on v.word = rest
        ), best as (
          select near.word, count(*) as n_near, first(near.near order by v.n desc, near.near) as form, max(v.n) as form_n from near join v on v.word = near.near group by near.word
        ), forms as (
          select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * v.n then form end as form, case when form_n >= 10 * v.n then form_n end as form_n from v left join best using (word)
        ), follow(word, root, step) as (
          select word, word, 0 from forms union all select f.word, g.form, step + 1 from follow f join forms g on g.word = f.root where g.form is not null
        )
        select word, n, n_near, form, form_n, root from forms join (select word, arg_max(root, step) as root from follow group by word) using (word)""",
}
