"""Tolerant plate matching against a watchlist, with a join that loses no alert."""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_plate, grams, half_up, substrings
from ..params import Match
from ..sources.storage import stored


def plate_score(obs: Column, tgt: Column) -> Column:
    """Score of two folded plates: equality, then containment, then agreement place by place."""
    n, m = F.length(obs), F.length(tgt)
    span = F.least(n, m)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(span, F.lit(1))), lambda i: F.substring(obs, i, F.lit(1)) == F.substring(tgt, i, F.lit(1))))
    share = same / span
    return (
        F.when((n == 0) | (m == 0), 0.0)
        .when(obs == tgt, 1.0)
        .when((n >= 4) & F.contains(tgt, obs), 0.55 + 0.35 * (n / m))
        .when(span < 4, 0.0)
        .when(share < 0.6, 0.0)
        .otherwise(0.9 * (share - 0.6) / 0.4)
    )


def appearance_score(det_class: Column, det_colour: Column, want_class: Column, want_colour: Column) -> Column:
    """Share of the entry's attributes that the sighting has; 0 if the entry has none."""
    hit = lambda want, got: F.when(want.isNotNull() & (want == got), 1.0).otherwise(0.0)
    asked = want_class.isNotNull().cast("int") + want_colour.isNotNull().cast("int")
    return F.when(asked > 0, (hit(want_class, det_class) + hit(want_colour, det_colour)) / asked).otherwise(0.0)


def with_score(pairs: DataFrame, params: Match = Match()) -> DataFrame:
    """Adds plate_score, appearance_score, score, match_type, is_alert and reasons to pairs of a read and an entry."""
    p, a = F.col("plate_score"), F.col("appearance_score")
    fused = params.plate_weight * p + params.appearance_weight * a
    fused = F.when(p >= 0.999, F.greatest(fused, F.lit(0.95))).when(p == 0, F.least(fused, F.lit(0.35))).otherwise(fused)
    kind = F.when(p >= 0.999, "exact").when((p > 0) & (a == 0), "partial").when(p > 0, "fused").otherwise("appearance")
    note = F.when((p >= 0.999) & (a < 0.5), "exact plate outranks appearance").when(p == 0, "appearance alone raises no alert")
    out = pairs.withColumn("plate_score", plate_score(F.col("read_fold"), F.col("entry_fold")))
    out = out.withColumn("appearance_score", appearance_score(F.col("vehicle_class"), F.col("colour"), F.col("entry_class"), F.col("entry_colour")))
    out = out.withColumn("score", fused).withColumn("match_type", kind).withColumn("is_alert", F.col("score") >= params.alert_threshold)
    # the verdict is taken on the exact score, which is shown at three places
    out = out.withColumn("score", half_up(F.col("score"), 3))
    why = F.struct(
        F.struct(half_up(p, 3).alias("score"), plate_detail().alias("detail")).alias("plate"),
        F.struct(half_up(a, 3).alias("score"), appearance_detail().alias("detail")).alias("appearance"),
        note.alias("policy"),
    )
    return out.withColumn("reasons", why)


def plate_detail() -> Column:
    """Which of the rules of plate_score spoke."""
    obs, tgt, p = F.col("read_fold"), F.col("entry_fold"), F.col("plate_score")
    n, m = F.length(obs), F.length(tgt)
    return (
        F.when((n == 0) | (m == 0), "no plate read")
        .when(obs == tgt, "the plates are equal")
        .when((n >= 4) & F.contains(tgt, obs), F.concat(n, F.lit(" of "), m, F.lit(" characters read, all within the plate")))
        .when(F.least(n, m) < 4, "too few characters to compare")
        .when(p == 0, "too few characters agree")
        .otherwise("characters agree place by place")
    )


def appearance_detail() -> Column:
    """What was asked of class and colour, and what the sighting has of it."""
    part = lambda name, want, got: F.when(F.col(want).isNotNull(), F.concat(F.lit(f"{name} "), F.when(F.col(want) == F.col(got), "agrees").otherwise("differs")))
    both = F.concat_ws(", ", part("class", "entry_class", "vehicle_class"), part("colour", "entry_colour", "colour"))
    return F.when(both == "", "nothing asked of the appearance").otherwise(both)


def least_alerting_share(params: Match = Match()) -> float:
    """Least agreement place by place that can still alert with full appearance."""
    need = max(0.0, (params.alert_threshold - params.appearance_weight) / params.plate_weight)
    return 1.0 if need >= 0.9 else 0.6 + 0.4 * need / 0.9


def gram_is_safe(span: int, q: int, params: Match = Match()) -> bool:
    """Whether two plates that alert over `span` places must share a run of q characters."""
    misses = span - math.ceil(least_alerting_share(params) * span - 1e-9)
    return span >= q and span > q * misses + q - 1


def unsafe_spans(params: Match = Match(), longest: int = 64) -> list[int]:
    return [n for n in range(params.min_chars, longest) if not gram_is_safe(n, params.gram, params)]


SALTS = 16


def salted(mark: str) -> Column:
    return F.array(*[F.lit(f"{mark}{i}") for i in range(SALTS)])


def candidates(reads: DataFrame, entries: DataFrame, params: Match = Match()) -> DataFrame:
    """Distinct pairs (id, entry_id, read_fold, entry_fold) that could alert; every pair left out cannot.

    reads (id, plate_text), entries (entry_id, plate). An equi-join on q-character windows, of the fallback size for
    reads of a length at which the usual size proves nothing; short and unsafe entries hang on marks of their own, which
    every read carries: such entries stand under SALTS copies of their mark, of which a read carries one.
    """
    unsafe = unsafe_spans(params)
    n = F.length("fold")
    e = entries.select("entry_id", fold_plate(F.col("plate")).alias("fold"))
    marks = F.concat(
        F.when(n < params.min_chars, salted("#short")).otherwise(
            F.concat(
                F.transform(grams(F.col("fold"), params.gram), lambda g: F.concat(F.lit("p:"), g)),
                F.transform(grams(F.col("fold"), params.fallback_gram), lambda g: F.concat(F.lit("f:"), g)),
                F.when(n.isin(unsafe), salted("#forced")).otherwise(F.array().cast("array<string>")),
            )
        )
    )
    e = e.select("entry_id", F.col("fold").alias("entry_fold"), F.explode(marks).alias("mark"))
    r = reads.select("id", fold_plate(F.col("plate_text")).alias("fold"))
    salt = F.pmod(F.xxhash64("id", "fold"), F.lit(SALTS)).cast("string")
    short, forced = F.concat(F.lit("#short"), salt), F.concat(F.lit("#forced"), salt)
    looks = (
        F.when(n < params.min_chars, F.array(short))
        .when(
            n.isin(unsafe),
            F.concat(F.array(short), F.transform(grams(F.col("fold"), params.fallback_gram), lambda g: F.concat(F.lit("f:"), g))),
        )
        .otherwise(
            F.concat(F.array(short, forced), F.transform(grams(F.col("fold"), params.gram), lambda g: F.concat(F.lit("p:"), g)))
        )
    )
    r = r.select("id", F.col("fold").alias("read_fold"), F.explode(looks).alias("mark"))
    return r.join(e, "mark").select("id", "entry_id", "read_fold", "entry_fold").distinct()


MOST_GRAMS = 10  # windows of a plate whose sets are listed: 1,023 of them


def subsets(c: Column, mark: str) -> Column:
    """Every set of the strings of an array but the empty one, as `mark` and its strings in order, which are all of a length."""
    every = F.aggregate(F.array_sort(c), F.array(F.lit(mark)), lambda sets, g: F.concat(sets, F.transform(sets, lambda s: F.concat(s, g))))
    return F.filter(every, lambda s: s != mark)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, written once, in as many parts as the session has for shuffles: rows are few and short, but much is made of each."""
    return stored(df, "windows").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def candidate_counts(folds: DataFrame, entries: DataFrame, params: Match = Match()) -> DataFrame:
    """Rows (fold, entries, first_entry) of distinct folds (fold): how many entries (entry_id, plate) are its candidates
    and the smallest of them; folds without any are left out. The same as to count `candidates`, whose pairs grow with
    the square of the plates, but no pair is made: the entries that share a window with a read are counted by inclusion and exclusion
    over the sets of its windows, so the work grows with the plates. Plates of more than MOST_GRAMS windows meet pair by pair.
    No join is broadcast: what meets grows with the plates and would pass through the driver.
    """
    unsafe = unsafe_spans(params)
    n = F.length("fold")
    e = entries.select("entry_id", fold_plate(F.col("plate")).alias("fold")).distinct()
    short, forced = n < params.min_chars, n.isin(unsafe)
    whole = e.agg(  # one row
        *[x for name, some in (("short", short), ("forced", ~short & forced))
          for x in (F.count(F.when(some, 1)).alias(name), F.min(F.when(some, F.col("entry_id"))).alias(f"{name}_first"))]
    )
    # a safe read looks by the usual windows, another one by the smaller; entries that every safe read meets anyway have the smaller alone
    usual, small = (grams(F.col("fold"), q) for q in (params.gram, params.fallback_gram))
    r = folds.where(~short).select("fold", F.when(forced, "f").otherwise("p").alias("mark"), F.when(forced, small).otherwise(usual).alias("grams"))
    both = F.array(F.struct(F.lit("f").alias("mark"), small.alias("grams")), F.struct(F.when(~forced, "p").alias("mark"), usual.alias("grams")))
    held = e.where(~short).select("entry_id", F.inline(both)).where("mark is not null")
    r, held = dealt(r, "fold"), dealt(held, "entry_id")
    few = F.size("grams") <= MOST_GRAMS
    sets = F.when(F.col("mark") == "p", subsets(F.col("grams"), "p")).otherwise(subsets(F.col("grams"), "f"))
    known = held.where(few).select("entry_id", F.explode(sets).alias("key")).groupBy("key").agg(F.count("*").alias("many"), F.min("entry_id").alias("first"))
    size = F.when(F.col("key").startswith("p"), params.gram).otherwise(params.fallback_gram)
    odd = F.expr("length(key) - 1") / size % 2 == 1
    asked = r.where(few).select("fold", F.explode(sets).alias("key")).join(known.hint("merge"), "key")
    met = asked.select("fold", F.when(odd, F.col("many")).otherwise(-F.col("many")).alias("many"), "first")

    each = lambda df, *columns: df.select(*columns, "mark", F.explode("grams").alias("gram"))
    for a, b in ((r.where(~few), held), (r.where(few), held.where(~few))):
        pairs = each(a, "fold").join(each(b, "entry_id").hint("merge"), ["mark", "gram"]).select("fold", "entry_id").distinct()
        met = met.union(pairs.select("fold", F.lit(1).cast("long"), "entry_id"))
    shared = met.groupBy("fold").agg(F.sum("many").alias("many"), F.min("first").alias("first"))
    out = folds.join(shared.hint("merge"), "fold", "left").crossJoin(F.broadcast(whole))
    safe = ~short & ~forced
    return out.select(
        "fold",
        (F.coalesce("many", F.lit(0)) + F.col("short") + F.when(safe, F.col("forced")).otherwise(0)).alias("entries"),
        F.least("first", "short_first", F.when(safe, F.col("forced_first"))).alias("first_entry"),
    ).where("entries > 0")


KEYS = 64  # keys of a plate and span at most


@cache
def place_keys(span: int, misses: int) -> list[list[int]]:
    """Sets of places (from 0) of which two strings of `span` that differ in at most `misses` places agree on one at
    least. The places are cut into misses + r parts, of which r agree; r is the largest with at most KEYS choices."""
    r = 1
    while misses + r < span and math.comb(misses + r + 1, r + 1) <= KEYS:
        r += 1
    n = misses + r
    parts = [list(range(i * span // n, (i + 1) * span // n)) for i in range(n)]
    return [[i for part in chosen for i in part] for chosen in combinations(parts, r)]


def by_place(folds: DataFrame, lengths: DataFrame, name: str, params: Match) -> DataFrame:
    """Rows (key, name) of distinct folds, for each span that they can be compared over with plates of `lengths`."""
    share = least_alerting_share(params)

    @F.udf("array<string>")
    def keys(fold: str, span: int) -> list[str]:
        misses = span - math.ceil(share * span - 1e-9)
        return [f"{span} {k} " + "".join([fold[i] for i in places]) for k, places in enumerate(place_keys(span, misses))]

    spans = folds.join(F.broadcast(lengths)).select(name, F.least(F.length(name), "length").alias("span")).where("span >= 4").distinct()
    return spans.select(name, F.explode(keys(F.col(name), F.col("span"))).alias("key")).select(F.xxhash64("key").alias("key"), name)


def plate_pairs(reads: DataFrame, plates: DataFrame, params: Match = Match()) -> DataFrame:
    """Pairs (read_fold, entry_fold) of distinct folded plates, empty ones left out, whose plate evidence can alert.

    What plate_score asks for is the key of an equi-join: equality and containment by substrings of the plate, agreement
    place by place by sets of places, of which one agrees throughout. So few pairs meet that don't count, however many
    plates begin alike."""
    r, e = reads.where("read_fold <> ''"), plates.where("entry_fold <> ''")
    held = e.select("entry_fold", F.explode(F.array_distinct(F.concat(F.array("entry_fold"), substrings(F.col("entry_fold"), 4)))).alias("read_fold"))
    lengths = lambda df, c: df.select(F.length(c).alias("length")).distinct()
    a = by_place(r, lengths(e, "entry_fold"), "read_fold", params)
    b = by_place(e, lengths(r, "read_fold"), "entry_fold", params)
    met = r.join(held, "read_fold").select("read_fold", "entry_fold").union(a.join(b, "key").select("read_fold", "entry_fold"))
    least = (params.alert_threshold - params.appearance_weight) / params.plate_weight - 1e-9
    score = plate_score(F.col("read_fold"), F.col("entry_fold"))
    return met.where((score > 0) & (score >= least)).distinct()


def alerts(sightings: DataFrame, entries: DataFrame, params: Match = Match()) -> DataFrame:
    """Scored pairs that alert. Plates and looks repeat far more often than they differ, so pairs are found once for each
    distinct plate and judged once for each distinct read, class and colour; pairs without any plate evidence can't
    alert, and only those that do meet the sightings."""
    look = ["read_fold", "vehicle_class", "colour"]
    s = sightings.withColumn("read_fold", fold_plate(F.col("plate_text")))
    s = s.select("id", "camera_id", "plate_text", "wall_us", *look)
    e = entries.withColumn("entry_fold", fold_plate(F.col("plate")))
    if params.alert_threshold > 0.35:
        pairs = plate_pairs(s.select("read_fold").distinct(), e.select("entry_fold").distinct(), params)
    else:
        reads = s.select(F.col("read_fold").alias("id"), F.col("read_fold").alias("plate_text")).distinct()
        pairs = candidates(reads, entries, params).select("read_fold", "entry_fold").distinct()
    looks = s.select(*look).distinct().join(pairs, "read_fold").join(e, "entry_fold")
    judged = with_score(looks, params).where("is_alert")
    met = judged.select(*[F.col(c).alias(f"_{c}") if c in look else c for c in judged.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in look[1:]]
    return s.join(met, (F.col("read_fold") == F.col("_read_fold")) & same[0] & same[1]).drop(*[f"_{c}" for c in look])
