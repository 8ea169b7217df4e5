"""Overlay clocks, captions, lookup and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captions as cap
from ..functions.overlay import DMY, YMD, parsed_seconds, plausible_year
from ..operators import retrieval
from ..sources import domain as d
from . import query

OVERLAYS = """overlays as (
      select event_id as id, case event_id % 7 when 0 then strftime(t, '%d-%m-%Y %H:%M:%S') when 1 then 'CAM3 ' || strftime(t, '%Y-%m-%d %H:%M:%S') when 2 then strftime(t, '%d/%m/%Y  %I:%M:%S %p')
        when 3 then strftime(t, '%d%m%Y%H%M%S') when 4 then strftime(t, '%d1%m1%Y%H%M%S') when 5 then 'camera ' || event_id else (event_id % 40)::varchar || '-' || strftime(t, '%m-%Y %H:%M:%S') end as text
      from (select event_id, ts + interval 2 year as t from events)
    )"""


def overlays(spark, sf_dir):
    e = d.raw(spark, sf_dir, "events").select("event_id", F.expr("cast(ts as timestamp) + interval 2 years").alias("t"), F.col("event_id").alias("id"))
    k = F.col("event_id") % 7
    text = (
        F.when(k == 0, F.date_format("t", "dd-MM-yyyy HH:mm:ss"))
        .when(k == 1, F.concat(F.lit("CAM3 "), F.date_format("t", "yyyy-MM-dd HH:mm:ss")))
        .when(k == 2, F.date_format("t", "dd/MM/yyyy  hh:mm:ss a"))
        .when(k == 3, F.date_format("t", "ddMMyyyyHHmmss"))
        .when(k == 4, F.date_format("t", "dd1MM1yyyyHHmmss"))
        .when(k == 5, F.concat(F.lit("camera "), "event_id"))
        .otherwise(F.concat((F.col("event_id") % 40).cast("string"), F.lit("-"), F.date_format("t", "MM-yyyy HH:mm:ss")))
    )
    return e.select("id", text.alias("text"))


PARSE = rf"""{OVERLAYS}, c as (select id, upper(trim(text)) as s from overlays), p as (
      select id, s, case when regexp_matches(s, '{DMY}') then regexp_extract(s, '{DMY}', ['d', 'm', 'y', 'h', 'i', 's'])
        when regexp_matches(s, '{YMD}') then (select struct_pack(d := x.d, m := x.m, y := x.y, h := x.h, i := x.i, s := x.s) from (select regexp_extract(s, '{YMD}', ['y', 'm', 'd', 'h', 'i', 's']) as x))
        when length(regexp_replace(s, '\D', '', 'g')) = 14 then struct_pack(d := substr(n, 1, 2), m := substr(n, 3, 2), y := substr(n, 5, 4), h := substr(n, 9, 2), i := substr(n, 11, 2), s := substr(n, 13, 2))
        when length(regexp_replace(s, '\D', '', 'g')) = 16 then struct_pack(d := substr(n, 1, 2), m := substr(n, 4, 2), y := substr(n, 7, 4), h := substr(n, 11, 2), i := substr(n, 13, 2), s := substr(n, 15, 2)) end as f,
        regexp_matches(s, '{DMY}') or regexp_matches(s, '{YMD}') as formed
      from (select *, regexp_replace(s, '\D', '', 'g') as n from c)
    ), parsed as (
      select id, (epoch_us(try_strptime(f.y || '-' || f.m || '-' || f.d || ' ' || case when formed and contains(s, 'PM') and f.h::int < 12 then (f.h::int + 12)::varchar when formed and contains(s, 'AM') and f.h = '12' then '00' else f.h end
        || ':' || f.i || ':' || f.s, '%Y-%m-%d %H:%M:%S')) // 1000000) as seconds from p
    )"""


@query(f"with {PARSE} select id, seconds from parsed")
def overlay_parse(spark, sf_dir):
    return overlays(spark, sf_dir).select("id", parsed_seconds(F.col("text")).alias("seconds"))


@query(f"with {PARSE} select coalesce(year(make_timestamp(seconds * 1000000)) between 2025 and 2027, false) as plausible, count(*) as n, coalesce(sum(seconds), 0)::bigint as checksum from parsed group by 1")
def overlay_plausible(spark, sf_dir):
    s = overlays(spark, sf_dir).select(parsed_seconds(F.col("text")).alias("seconds"))
    return s.groupBy(plausible_year(F.col("seconds")).alias("plausible")).agg(F.count("*").alias("n"), F.coalesce(F.sum("seconds"), F.lit(0).cast("long")).alias("checksum"))


# Fragments of made-up captions.
SUBJECTS = ["A white SUV", "the black pick-up truck", "A black and white photo of a red bus", "an auto-rickshaw", "A dark grey sedan", "two people", "A vehicle that is not blue, a green van", "a Silver hatchback parked behind a truck"]
DETAILS = ["with tinted windows", "the windows are not tinted", "with alloy wheels and a roof rack", "without a roof rack", "showing ''Cafe'' on the side", "with a dent and no scratch", "with hubcaps and a logo", "on a road"]


def captions(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v.replace("''", "'")) for v in values]), F.expr(f"cast({k} % 8 + 1 as int)"))
    e = d.raw(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat_ws(" ", pick(SUBJECTS, "event_id"), pick(DETAILS, "(event_id div 8)"), pick(DETAILS, "(event_id div 64)"), F.lit(".")).alias("caption"))


def _rows(values) -> str:
    return ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))


def _vocabulary(name: str, vocabulary: list[tuple[str, str]]) -> str:
    longest = sorted(vocabulary, key=lambda x: -len(x[0]))
    return f"{name}(rank, phrase, value) as (values " + ", ".join(f"({i}, '{p}', '{v}')" for i, (p, v) in enumerate(longest)) + ")"


def _phrases() -> str:
    lists = {"tint": cap.TINT, "alloy": cap.ALLOY, "stock": cap.STOCK, "rack": cap.RACK, "mark": cap.MARKINGS, "damage": cap.DAMAGE}
    return "phrases(kind, rank, phrase) as (values " + ", ".join(f"('{k}', {i}, '{p}')" for k, ps in lists.items() for i, p in enumerate(ps)) + ")"


NEG = r"\b(" + "|".join(n.replace("'", "''") for n in cap.NEGATIONS) + r")\b"
WINDOW = "substr({t}, greatest({a} - 40, 1)::bigint, ({a} - greatest({a} - 40, 1))::bigint)"
CAPTIONS = rf"""caps as (
      select event_id as id, [{', '.join(f"'{s}'" for s in SUBJECTS)}][(event_id % 8 + 1)::int] || ' ' || [{', '.join(f"'{s}'" for s in DETAILS)}][(event_id // 8 % 8 + 1)::int]
        || ' ' || [{', '.join(f"'{s}'" for s in DETAILS)}][(event_id // 64 % 8 + 1)::int] || ' .' as caption from events
    ), texts as (select distinct caption, trim(regexp_replace(lower(caption), '\s+', ' ', 'g')) as t from caps),
    {_vocabulary('body', cap.BODY)}, {_vocabulary('hue', cap.COLOURS)}, {_phrases()},
    b as (
      select caption, arg_min(value, a * 1000 + rank) as body_type from (select caption, t, value, rank, length(regexp_extract(t, '^(.*?)\b' || replace(phrase, '-', '\-') || '\b', 1)) + 1 as a from texts, body where regexp_matches(t, '\b' || replace(phrase, '-', '\-') || '\b'))
      where not regexp_matches({WINDOW.format(t='t', a='a')}, '{NEG}') group by 1
    ), m as (select caption, replace(replace(replace(t, 'black and white', repeat(' ', 15)), 'white and black', repeat(' ', 15)), 'black-and-white', repeat(' ', 15)) as t from texts),
    h as (
      select caption, arg_min(value, a * 1000 + rank) as colour from (select caption, t, value, rank, length(regexp_extract(t, '^(.*?)\b' || replace(phrase, '-', '\-') || '\b', 1)) + 1 as a from m, hue where regexp_matches(t, '\b' || replace(phrase, '-', '\-') || '\b'))
      where not regexp_matches({WINDOW.format(t='t', a='a')}, '{NEG}') group by 1
    ), occ as (
      select caption, kind, rank, phrase, i, regexp_matches({WINDOW.format(t='t', a='a')}, '{NEG}') as neg from (
        select caption, t, kind, rank, phrase, i, 1 + list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase) as a
        from (select caption, t, kind, rank, phrase, string_split_regex(t, '\b' || replace(phrase, '-', '\-')) as parts from texts, phrases), unnest(range(1, len(parts))) as g(i))
    ), st as (select caption, bool_or(not neg) filter (kind = 'tint') as tinted_windows, bool_or(not neg) filter (kind = 'alloy') as alloy, bool_or(not neg) filter (kind = 'stock') as stock,
        bool_or(not neg) filter (kind = 'rack') as roof_rack, string_agg(phrase, ',' order by rank) filter (kind = 'mark' and i = 1 and not neg) as words,
        string_agg(phrase, ',' order by rank) filter (kind = 'damage' and i = 1 and not neg) as damage from occ group by 1
    ), fields as (
      select caption, coalesce(body_type, 'unknown') as body_type, colour, tinted_windows, case when alloy then 'alloy' when stock then 'stock' else 'unknown' end as wheels, roof_rack,
        case when contains(caption, '''Cafe''') then array_to_string(list_transform(range((length(caption) - length(replace(caption, '''Cafe''', ''))) // 6), lambda i: 'Cafe'), ',') else coalesce(words, '') end as markings, coalesce(damage, '') as damage
      from texts left join b using (caption) left join h using (caption) left join st using (caption)
    )"""


@query(f"with {CAPTIONS} select id, body_type, colour, tinted_windows, wheels, roof_rack, markings, damage from caps join fields using (caption)")
def caption_parse(spark, sf_dir):
    p = cap.with_attributes(captions(spark, sf_dir))
    return p.select("id", "body_type", "colour", "tinted_windows", "wheels", "roof_rack", F.array_join("markings", ",").alias("markings"), F.array_join("damage", ",").alias("damage"))


@query(
    f"""with {CAPTIONS} select id, floor(least(0.9::double, ((body_type <> 'unknown')::int + (colour is not null)::int + (tinted_windows is not null)::int + (wheels <> 'unknown')::int
      + (roof_rack is not null)::int + (markings <> '')::int + (damage <> '')::int)::double / 7) * 1000 + 0.5::double) / 1000::double as confidence from caps join fields using (caption)"""
)
def caption_confidence(spark, sf_dir):
    return cap.with_attributes(captions(spark, sf_dir)).select("id", F.col("attribute_confidence").alias("confidence"))


STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
ENTITIES = f"""entities as (
      select 'part-' || p_partkey as doc_id, p_name || ' ' || p_brand || ' ' || p_type as text from part union all select 'supplier-' || s_suppkey, s_name || ' ' || n_name from supplier join nation on s_nationkey = n_nationkey
    ), tok as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t not in ({STOP})) as t from entities),
    post as (select doc_id, term, count(*) as tf, any_value(len(t)) as dl from tok, unnest(t) as u(term) group by all),
    df as (select term, count(*) as df from post group by 1), stats as (select count(*) as n, avg(len(t)) as mean from tok)"""


def entities(spark, sf_dir):
    part = d.raw(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    s = d.raw(spark, sf_dir, "supplier").join(F.broadcast(d.raw(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return part.union(s.select(F.concat(F.lit("supplier-"), "s_suppkey").alias("doc_id"), F.concat_ws(" ", "s_name", "n_name").alias("text")))


# Questions to look up.
ASKED = [(1, "show me part 7 brand"), (2, "the supplier in nation"), (3, "suplier nat"), (4, "brand economy steel"), (5, "part-3"), (6, "zzz qqq"), (7, "small plated tin"), (8, "the camera")]
ASKED_SQL = "asked(query_id, query) as (values " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ")"


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


@query(f"with {ENTITIES} select term, df from df union all select '#documents', n from stats union all select '#terms', (n * mean)::bigint from stats")
def bm25_stats(spark, sf_dir):
    post = retrieval.postings(entities(spark, sf_dir))
    n, mean = retrieval.corpus(entities(spark, sf_dir))
    totals = spark.createDataFrame([("#documents", n), ("#terms", round(n * mean))], "term string, df long")
    return post.groupBy("term").agg(F.count("*").alias("df")).union(totals)


RANKED = f"""{ENTITIES}, {ASKED_SQL}, q as (
      select query_id, term, count(*) as qf from (select query_id, unnest(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: t not in ({STOP}))) as term from asked) group by all
    ), qi as (select q.*, ln(1 + (n - coalesce(df, 0) + 0.5::double) / (coalesce(df, 0) + 0.5::double)) as idf from q cross join stats left join df using (term)),
    wanted as (select query_id, sum(idf) as wanted from qi group by 1),
    ranked as (
      select query_id, doc_id, sum(qf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * greatest(dl, 1) / mean))) as score, sum(idf) as matched, any_value(wanted) as wanted
      from qi join post using (term) join wanted using (query_id) cross join stats group by query_id, doc_id
    )"""


@query(f"with {RANKED} select query_id, doc_id, round(score, 6) as score, round(matched, 6) as matched, round(wanted, 6) as wanted from ranked")
def bm25_rank(spark, sf_dir):
    out = retrieval.rank(entities(spark, sf_dir), asked(spark))
    return out.select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("score", "matched", "wanted")])


GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
NAMES = f"""pieces as (
      select query_id, list_aggregate(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: t not in ({STOP})), 'string_agg', '') as piece from asked
      union select query_id, term from q where term not in (select term from df)
    ), names as (select doc_id, {GRAMS.format("regexp_replace(lower(text), '[^a-z0-9]', '', 'g')")} as g from entities),
    named as (
      select query_id, doc_id, max(len(list_intersect({GRAMS.format('piece')}, g))::double / len({GRAMS.format('piece')})) as score from pieces, names where length(piece) >= 4 group by all having score >= 0.7::double
    )"""


@query(f"with {RANKED}, {NAMES} select query_id, doc_id, round(score, 6) as score from named")
def trigram_fallback(spark, sf_dir):
    return retrieval.similar_names(entities(spark, sf_dir), asked(spark)).withColumn("score", F.round("score", 6))


INTENT = ", ".join(f"'{w}'" for w in retrieval.intent_words())
HEARD = f"""heard as (
      select query_id, coalesce(list_aggregate(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: t not in ({INTENT}) or list_contains(known, t)), 'string_agg', ' '), '') as query from asked, (select coalesce(list(term), []) as known from df)
    )"""
RANKED_HEARD = RANKED[RANKED.index("q as (") :].replace("from asked", "from heard")  # the same rules on what is left of the queries
NAMES_HEARD = NAMES.replace("from asked", "from heard")


@query(
    f"""with {ENTITIES}, {ASKED_SQL}, {HEARD}, {RANKED_HEARD}, {NAMES_HEARD}, hits as (
      select r.query_id, r.doc_id, score, len(list_intersect(list_distinct(regexp_extract_all(lower(r.doc_id), '[a-z0-9]+')), terms)) = len(list_distinct(regexp_extract_all(lower(r.doc_id), '[a-z0-9]+'))) as named, 'bm25' as how
      from ranked r join (select query_id, list(term) as terms from q group by 1) using (query_id) where matched >= 1 and matched / wanted >= 0.5::double
    ), every as (select * from hits union all select query_id, doc_id, score, false, 'trigram' from named where query_id not in (select query_id from hits))
    select query_id, doc_id, round(score, 6) as score, how, (row_number() over (partition by query_id order by named desc, round(score, 9) desc, doc_id))::int as place from every qualify place <= 5"""
)
def entity_resolve(spark, sf_dir):
    return retrieval.resolve(entities(spark, sf_dir), asked(spark)).withColumn("score", F.round("score", 6))


def _intent_sql() -> str:
    cases = " ".join(f"when {' or '.join(f'''contains(q, '{w}')''' for w in words)} then '{name}'" for name, words in retrieval.INTENTS)
    return f"case when q = '' then 'help' when regexp_matches(text, '{retrieval.REGISTRATION}') then 'find_plate' {cases} end"


QUESTIONS = "questions as (select conv_id, turn, text, lower(trim(text)) as q from conversations)"


@query(f"with {QUESTIONS} select {_intent_sql()} as intent, count(*) as n from questions group by 1")
def intent_route(spark, sf_dir):
    c = d.raw(spark, sf_dir, "conversations")
    return c.groupBy(retrieval.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


# -- how questions are answered: each fifth supplier is asked after in one of ten ways; suppliers are cameras, parts zones

TO_ASK = """questions as (
      select s_suppkey as query_id, case s_suppkey // 5 % 10 when 0 then 'is ' || s_name || ' down' when 1 then 'camera health for ' || n_name when 2 then s_name when 3 then 'look up ' || s_name
        when 4 then 'weather tomorrow' when 5 then 'coverage in ' || n_name || ' of ' || s_name when 6 then 'search for zebra crossings' when 7 then 'status of the system' when 8 then 'any health of part-' || s_suppkey else '' end as text
      from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 5 = 0
    ), routed as (select *, trim(lower(text)) as q from questions)"""


def to_ask(spark, sf_dir):
    s = d.raw(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").join(F.broadcast(d.raw(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.selectExpr(
        "s_suppkey as query_id",
        "case s_suppkey div 5 % 10 when 0 then concat('is ', s_name, ' down') when 1 then concat('camera health for ', n_name) when 2 then s_name when 3 then concat('look up ', s_name)"
        " when 4 then 'weather tomorrow' when 5 then concat('coverage in ', n_name, ' of ', s_name) when 6 then 'search for zebra crossings' when 7 then 'status of the system'"
        " when 8 then concat('any health of part-', s_suppkey) else '' end as query",
    )


@query(
    f"""with {ENTITIES}, {TO_ASK}, told as (select query_id, text, {_intent_sql()} as intent from routed),
    asked as (select query_id, case when intent = 'search' and trim(regexp_replace(text, '^\\s*(search|look\\s*(up|for)|lookup)\\b(\\s+for)?[:\\s]*', '', 'i')) <> ''
        then trim(regexp_replace(text, '^\\s*(search|look\\s*(up|for)|lookup)\\b(\\s+for)?[:\\s]*', '', 'i')) else text end as query from told),
    {HEARD}, {RANKED_HEARD}, {NAMES_HEARD}, kinds as (select doc_id, case when starts_with(doc_id, 'supplier-') then 'camera' else 'zone' end as kind from entities),
    pools as (select doc_id, kind as pool from kinds union all select doc_id, 'any' from kinds),
    hits as (
      select pool, r.query_id, r.doc_id, score, len(list_intersect(list_distinct(regexp_extract_all(lower(r.doc_id), '[a-z0-9]+')), terms)) = len(list_distinct(regexp_extract_all(lower(r.doc_id), '[a-z0-9]+'))) as named
      from ranked r join pools using (doc_id) join (select query_id, list(term) as terms from q group by 1) using (query_id) where matched >= 1 and matched / wanted >= 0.5::double
    ), every as (
      select * from hits union all
      select pool, n.query_id, n.doc_id, score, false from named n join pools p using (doc_id) where (pool, n.query_id) not in (select pool, query_id from hits)
    ), placed as (select *, row_number() over (partition by pool, query_id order by named desc, round(score, 9) desc, doc_id) as place from every),
    best as (select pool, query_id, max(doc_id) filter (place = 1) as doc, max(score) filter (place = 1) as score, max(score) filter (place = 2) as second from placed group by all),
    picked as (select t.query_id, t.intent, c.doc as camera, coalesce(c.doc, z.doc) as doc, case when c.doc is not null then c.score else z.score end as score, case when c.doc is not null then c.second else z.second end as second, a.doc as hit
      from told t left join best c on c.pool = 'camera' and c.query_id = t.query_id left join best z on z.pool = 'zone' and z.query_id = t.query_id left join best a on a.pool = 'any' and a.query_id = t.query_id),
    judged as (select *, intent in ('camera_health', 'coverage') and doc is not null and (second is null or round(second, 9) < round(0.9::double * score, 9)) as ok from picked)
    select query_id, intent, case when ok then 'scoped' when (intent is null or intent = 'search') and hit is not null then 'search' when intent = 'search' then 'nothing' when intent is null then 'decline' else 'broad' end as action,
      case when ok then doc when intent is null or intent = 'search' then hit end as doc_id from judged"""
)
def question_scope(spark, sf_dir):
    docs = entities(spark, sf_dir).withColumn("kind", F.when(F.startswith("doc_id", F.lit("supplier-")), "camera").otherwise("zone"))
    return retrieval.decided(docs, to_ask(spark, sf_dir))
