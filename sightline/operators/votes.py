"""Several reads of one plate voted into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_plate
from ..params import CONFUSED, FOLDED, Vote


def held_reads(reads: DataFrame, by: list[str], params: Vote = Vote()) -> DataFrame:
    """The newest reads of each track, cleaned, by arrival `seq`; reads of too few characters don't count."""
    r = reads.withColumn("text", clean_plate(F.col("plate_text"))).where(F.length("text") >= params.min_chars)
    newest = Window.partitionBy(*by).orderBy(F.desc("seq"))
    return r.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= params.max_reads).drop("rn")


def consensus(reads: DataFrame, by: list[str], params: Vote = Vote()) -> DataFrame:
    """Per track: plate, confidence, voters.

    One read stands alone. Else the length with most reads, then most confidence, then the first seen, is the cohort;
    a cohort of one gives way to the most confident read of all. At each place the confidences are summed by folded
    character; the best sum wins, shown as its most confident raw character. All ties go to the earlier read.
    """
    r = held_reads(reads, by, params).withColumn("n", F.length("text"))
    lengths = r.groupBy(*by, "n").agg(F.count("*").alias("k"), F.sum("conf").alias("weight"), F.min("seq").alias("first"))
    best_length = lengths.groupBy(*by).agg(
        F.max_by(F.struct("n", "k"), F.struct("k", "weight", (-F.col("first")).alias("f"))).alias("c"), F.sum("k").alias("reads")
    )
    single = r.groupBy(*by).agg(F.max_by(F.struct("text", "conf"), F.struct("conf", (-F.col("seq")).alias("s"))).alias("one"))
    cohort = r.join(best_length, by).where((F.col("n") == F.col("c.n")) & (F.col("c.k") >= params.min_voters))
    cells = cohort.select(*by, "seq", "conf", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    cells = cells.withColumn("folded", F.translate("ch", CONFUSED, FOLDED))
    groups = cells.groupBy(*by, "pos", "folded").agg(
        F.sum("conf").alias("weight"), F.min("seq").alias("first"), F.max_by("ch", F.struct("conf", (-F.col("seq")).alias("s"))).alias("ch")
    )
    places = groups.groupBy(*by, "pos").agg(
        F.max_by(F.struct("ch", "weight"), F.struct("weight", (-F.col("first")).alias("f"))).alias("w"), F.sum("weight").alias("total")
    )
    voted = places.groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w.ch"))), lambda x: x["ch"]), "").alias("text"),
        F.avg(F.when(F.col("total") > 0, F.col("w.weight") / F.col("total")).otherwise(0.0)).alias("share"),
    )
    out = best_length.join(single, by).join(voted, by, "left")
    return out.select(
        *by,
        F.coalesce("text", "one.text").alias("plate"),
        F.coalesce("share", "one.conf").alias("confidence"),
        F.when(F.col("text").isNotNull(), F.col("c.k")).otherwise(1).alias("voters"),
    )
