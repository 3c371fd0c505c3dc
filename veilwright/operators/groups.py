"""Value groups: what is replaced together, in review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.functions.pseudonyms import suggestion
from veilwright.functions.text import collapsed, finding_key
from veilwright.sources.shared import spread, stash
from veilwright.fixed import REPORT_ORDER, SHOWN_LOCATIONS


def report_order(entity: Column) -> Column:
    out = F.lit(99)
    for name, order in REPORT_ORDER.items():
        out = F.when(entity == name, order).otherwise(out)
    return out


def keyed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("key", finding_key(F.col("entity_type"), F.col("text"), F.col("file"), F.col("line_no"), F.col("col_no")))


def group_findings(findings: DataFrame) -> DataFrame:
    """entity_type, key, original, hits, locations, first_file, first_start.

    ``original`` is the first occurrence's text; ``locations`` the first eight places. A task sends at most
    eight places of a value (a limit inside the window, before its shuffle) and one count, however often
    the value occurs. The narrow rows are written once, so texts are not scanned for each of the two.
    """
    place = F.struct("file", "start", F.col("line_no").alias("line"), "text")
    rows = stash(keyed(findings).select("entity_type", "key", place.alias("at")), "places")
    rank = F.row_number().over(Window.partitionBy("entity_type", "key").orderBy("at"))
    first_ones = rows.withColumn("n", rank).filter(F.col("n") <= SHOWN_LOCATIONS)
    places = first_ones.groupBy("entity_type", "key").agg(F.array_sort(F.collect_list("at")).alias("places"))
    whole = rows.groupBy("entity_type", "key").agg(F.count(F.lit(1)).alias("hits")).join(places, ["entity_type", "key"])
    shown = F.array_join(F.transform("places", lambda p: F.concat(p["file"], F.lit(":"), p["line"].cast("string"))), ", ")
    more = F.when(F.col("hits") > SHOWN_LOCATIONS, F.concat(F.lit(" +"), (F.col("hits") - SHOWN_LOCATIONS).cast("string"), F.lit(" more"))).otherwise("")
    first = F.get("places", F.lit(0))
    return whole.select("entity_type", "key", collapsed(first["text"]).alias("original"), "hits", F.concat(shown, more).alias("locations"), first["file"].alias("first_file"), first["start"].alias("first_start"))


def ranked(groups: DataFrame) -> DataFrame:
    """With ``index``, the 1-based place in review order: by entity, then value, then first place.

    The order is global; it is numbered range by range, so no task gets all groups.
    """
    order = [report_order(F.col("entity_type")), F.upper("original"), F.col("first_file"), F.col("first_start"), F.col("key")]
    dealt = groups.withColumn("kind", order[0]).withColumn("name", order[1])
    keys = ["kind", "name", "first_file", "first_start", "key"]
    # written once: read by two branches that Spark might partition differently
    placed = stash(dealt.repartitionByRange(spread(groups.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("part", F.shiftright("place", 33)).withColumn("row", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    base = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))  # a row a partition
    return placed.join(F.broadcast(base), "part").withColumn("index", (F.col("base") + F.col("row") + 1).cast("int")).drop("part", "row", "base", "kind", "name", "place")


def replacement_map(groups: DataFrame, salt: str, chosen: DataFrame | None = None, auto: bool = False) -> DataFrame:
    """The review table: index, entity_type, key, original, suggested_replacement, replacement, hits, locations.

    ``chosen`` (entity_type, key, replacement) are decisions of a review; ``auto`` accepts the suggestion
    wherever there is none. An empty replacement leaves a value unchanged.
    """
    own = ranked(groups).withColumn("suggested_replacement", suggestion(F.col("entity_type"), F.col("original"), F.col("key"), F.col("index"), salt))
    if chosen is None:
        own = own.withColumn("replacement", F.lit(""))
    else:
        own = own.join(chosen.select("entity_type", "key", "replacement"), ["entity_type", "key"], "left").withColumn("replacement", F.coalesce("replacement", F.lit("")))
    if auto:
        own = own.withColumn("replacement", F.when(F.col("replacement") == "", F.col("suggested_replacement")).otherwise(F.col("replacement")))
    return own.select("index", "entity_type", "key", "original", "suggested_replacement", "replacement", "hits", "locations")
