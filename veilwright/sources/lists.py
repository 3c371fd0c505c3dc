"""Watchlists, employee rosters and reviewed maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwright.fixed import EMAIL, NON_LINKABLE, ROSTER_STOPWORDS, ROSTER_TOKEN
from veilwright.functions.text import collapsed, decoded, normalized, stripped
from veilwright.operators.detectors import FOLD, STAFF_NUMBER


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """line, of files that exist, decoded as sources are."""
    kept = [p for p in paths if _exists(spark, p)]
    if not kept:
        return spark.createDataFrame([], "line string")
    files = spark.read.format("binaryFile").load(kept)
    return files.select(F.explode(F.split(decoded(F.col("content")), "\n")).alias("line"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def watchlist_names(lines: DataFrame) -> DataFrame:
    """name: distinct entries; blank lines and comments are no entries."""
    own = lines.select(collapsed(F.col("line")).alias("name"))
    return own.filter((F.col("name") != "") & ~F.col("name").startswith("#")).distinct()


def name_variants(tokens: Column) -> Column:
    """The forms of one person: as written, two words swapped, and the first word as an initial."""
    n, head = F.size(tokens), F.element_at(tokens, 1)
    joined = F.array_join(tokens, " ")
    swapped = F.when(n == 2, F.concat_ws(" ", F.try_element_at(tokens, F.lit(2)), head))
    initial = F.when(F.length(head) > 2, F.concat_ws(" ", F.concat(F.array(F.substring(head, 1, 1)), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))))))
    many = F.array_compact(F.array(joined, swapped, initial))
    one = F.when(F.length(head) >= 2, F.array(head)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(n == 0, F.array().cast("array<string>")).when(n == 1, one).otherwise(many))


def parsed_roster(lines: DataFrame) -> DataFrame:
    """names, matriculas (arrays) of each roster line, whatever its delimiter."""
    line = F.col("line")
    live = (stripped(line) != "") & ~stripped(line).startswith("#")
    bare = F.regexp_replace(F.regexp_replace(line, STAFF_NUMBER, " "), FOLD + EMAIL, " ")
    tokens = F.regexp_extract_all(bare, F.lit("(?U)" + ROSTER_TOKEN), F.lit(0))
    tokens = F.filter(tokens, lambda t: ~F.replace(F.upper(t), F.lit("-"), F.lit("")).isin(*ROSTER_STOPWORDS))
    return lines.filter(live).select(line, name_variants(tokens).alias("names"), F.array_distinct(F.regexp_extract_all(line, F.lit(STAFF_NUMBER), F.lit(0))).alias("matriculas"))


def load_names(spark: SparkSession, paths: list[str]) -> tuple[str, ...]:
    """Entries of watchlist files, longest first; files that do not exist count as empty."""
    rows = watchlist_names(_lines(spark, paths)).orderBy(-F.length("name"), F.upper("name"), "name").collect()  # a hand-kept list
    return tuple(r.name for r in rows)


def load_rosters(spark: SparkSession, paths: list[str]) -> tuple[tuple[str, ...], DataFrame]:
    """Name variants of roster files, longest first, and a table (matricula) of their distinct staff numbers."""
    parsed = parsed_roster(_lines(spark, paths))
    rows = parsed.select(F.explode("names").alias("name")).distinct().collect()  # they become patterns: a company's staff
    names = sorted((r.name for r in rows), key=lambda n: (-len(n), n.upper(), n))
    return tuple(names), parsed.select(F.explode("matriculas").alias("matricula")).distinct()


def chosen_replacements(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """entity_type, key, replacement of a reviewed map; of rows with one key the last wins.

    A row without a key counts by its ``original`` where the entity's values are linked; rows without
    an entity or a replacement do not count.
    """
    have = {c: stripped(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("") for c in ("entity_type", "key", "original", "replacement")}
    at = order if order is not None else F.monotonically_increasing_id()
    own = rows.select(*(c.alias(n) for n, c in have.items()), at.alias("at"))
    derived = F.when((F.col("original") != "") & ~F.col("entity_type").isin(*NON_LINKABLE), normalized(F.col("original")))
    own = own.filter("entity_type <> '' and replacement <> ''").withColumn("key", F.when(F.col("key") != "", F.col("key")).otherwise(derived)).filter("key is not null")
    return own.groupBy("entity_type", "key").agg(F.max_by("replacement", "at").alias("replacement"))


def load_map(spark: SparkSession, path: str | None) -> DataFrame:
    """A reviewed map file (CSV with a header; a byte-order mark is skipped); none: an empty table."""
    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_type", "key", "replacement")])
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], kind)
    # one partition: row order decides, and a map is a hand-kept file
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).coalesce(1)
    return chosen_replacements(rows)
