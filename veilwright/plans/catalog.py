"""The query catalog: each operator over the shared tables, and the same in SQL for another engine.

Texts come from ``documents`` and from the corpus of :mod:`veilwright.plans.corpus`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.fixed import PRIORITY, REPORT_ORDER, ROSTER_STOPWORDS, TAX_CODE_ODD
from veilwright.functions import pseudonyms
from veilwright.functions.spans import matches
from veilwright.functions.text import decoded, with_pages
from veilwright.operators import detectors, groups, overlaps, ranges, replace
from veilwright.options import FOUND, ScanOptions
from veilwright.plans import corpus
from veilwright.plans.scan import scan
from veilwright.sources import lists, reports
from veilwright.sources.shared import spread, stash

Query = Callable[[SparkSession, str], DataFrame]
SALT = "catalog"
ROSTER = ("Giulia Bianchi", "Bianchi Giulia", "G Bianchi", "Luca Conti", "Conti Luca", "L Conti")
WATCHLIST = ("Mario", "Luca", "Giulia", "Francesca", "Rossi", "Bianchi", "Esposito", "De Luca", "Conti")
_CHARS = {"EMAIL": "[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (the id), text of the table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), "text")


def _only(*entities: str, **more) -> ScanOptions:
    return ScanOptions(entities=frozenset(entities), **more)


def _found(texts: DataFrame, options: ScanOptions) -> DataFrame:
    return scan(texts, options).select("file", "entity_type", "text", "start", "end", "line_no", "col_no", "confidence", "source")


def email_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), _only("EMAIL"))


def email_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_findings(email_findings(spark, sf_dir)).select("entity_type", "key", "original", "hits", "locations")


def findings_of(*entities: str) -> Query:
    return lambda spark, sf_dir: _found(corpus.files(spark, sf_dir), _only(*entities))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matricula: of every other customer."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 3 = 0")
    return rows.select(F.expr("'5' || lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0')").alias("matricula")).distinct()


def matricola_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(corpus.files(spark, sf_dir), _only("MATRICOLA", roster=roster(spark, sf_dir)))
    return found.select("file", "entity_type", "text", "start", "end", "confidence", "source")


def _lines(spark: SparkSession, sf_dir: str, rule: Callable[[Column], Column]) -> DataFrame:
    texts, body = with_pages(corpus.files(spark, sf_dir))
    line = lambda r: F.struct(body.line_no(r["start"]).alias("line_no"), body.part(r["start"], r["end"]).alias("line"))
    own = texts.select("file", F.explode(F.transform(ranges.lines(body.text), line)).alias("x")).select("file", "x.*")
    return own.filter(rule(F.col("line"))).select("file", "line_no", F.rtrim("line", F.lit("\n")).alias("line"))


def scan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.files(spark, sf_dir).select("file", F.explode(ranges.name_ranges(F.col("text"), "context")).alias("r"))
    return rows.select("file", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def watchlist_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(corpus.files(spark, sf_dir), _only("NAME", names=WATCHLIST))


def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(corpus.files(spark, sf_dir), _only("NAME", unknown_names=True)).select("file", "line_no", "text", "confidence")


_ROSTER_LINE = "(case cast(c_custkey % 5 as int) when 0 then '5' || lpad(cast(c_custkey as varchar(20)), 6, '0') || ';Mario;Rossi' when 1 then 'Petra;Van Ness,6' || lpad(cast(c_custkey as varchar(20)), 6, '0') when 2 then 'Wu' when 3 then '# note' else 'matricola;nome;cognome' end)"


def roster_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr(_ROSTER_LINE).alias("line"))
    parsed = lists.parsed_roster(rows)
    both = parsed.select(F.lit("name").alias("kind"), F.explode("names").alias("value")).unionByName(parsed.select(F.lit("matricula").alias("kind"), F.explode("matriculas").alias("value")))
    return both.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


_SPAN_ROWS = ("cast(l_orderkey as varchar(20)) AS file", "l_linenumber AS ord", "cast(l_partkey % 40 as int) AS s", "cast(l_partkey % 40 + 1 + l_suppkey % 12 as int) AS e", "cast(l_linenumber % 7 as int) AS kind")
_KINDS = tuple(PRIORITY)


def overlaps_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_SPAN_ROWS)
    name = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("kind") + 1)
    span = F.struct("ord", F.struct(name.alias("entity_type"), F.col("s").alias("start"), F.col("e").alias("end"), F.lit(1.0).alias("confidence"), F.lit("x").alias("source")).alias("x"))
    found = F.transform(F.array_sort(F.collect_list(span)), lambda y: y["x"]).cast(FOUND)
    kept = rows.groupBy("file").agg(overlaps.resolved(found).alias("kept")).select("file", F.explode("kept").alias("x"))
    return kept.select("file", F.col("x.entity_type").alias("entity_type"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def all_findings(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return scan(corpus.files(spark, sf_dir), ScanOptions(names=WATCHLIST), fields or None)


def value_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scan(corpus.files(spark, sf_dir), _only("IBAN", "CODICE_FISCALE", "EMAIL", "PHONE"))
    return groups.ranked(groups.group_findings(own)).select("index", "entity_type", "key", "original", "hits", "locations")


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for some e-mail addresses; of two for one address the later order's counts."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_custkey % 3 = 0")
    own = rows.selectExpr("'EMAIL' AS entity_type", "'' AS key", "'luca.bianchi' || cast(o_custkey % 50 as varchar(20)) || '@example.com' AS original", "'chosen' || cast(o_orderkey as varchar(20)) AS replacement", "o_orderkey")
    return lists.chosen_replacements(own, F.col("o_orderkey"))


def replacement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scan(corpus.files(spark, sf_dir), _only("EMAIL", "PHONE"))
    return groups.replacement_map(groups.group_findings(own), SALT, _chosen(spark, sf_dir)).select("index", "entity_type", "key", "original", "suggested_replacement", "replacement", "hits")


def _pseudonyms(spark: SparkSession, sf_dir: str, *entities: str) -> DataFrame:
    """entity_type, key, original, suggested_replacement. These entities' pseudonyms do not depend on a group's number."""
    own = groups.group_findings(scan(corpus.files(spark, sf_dir), _only(*entities))).select("entity_type", "key", "original")
    return own.repartition(spread(spark)).withColumn("suggested_replacement", pseudonyms.suggestion(F.col("entity_type"), F.col("original"), F.col("key"), F.lit(0), SALT, entities))


def pseudonyms_of(entity: str) -> Query:
    return lambda spark, sf_dir: _pseudonyms(spark, sf_dir, entity).select("key", "original", "suggested_replacement")


def pseudonym_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every account and tax code pseudonym: whether its check digits are right."""
    own = _pseudonyms(spark, sf_dir, "IBAN", "CODICE_FISCALE").withColumnRenamed("suggested_replacement", "p")
    account = pseudonyms.mod97(F.concat(F.substring("p", 5, 99), F.substring("p", 1, 4))) == 1
    code = (pseudonyms.tax_code_check(F.substring("p", 1, 15)) == F.substring("p", 16, 1)) & F.col("p").rlike("^[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]$")
    return own.select("entity_type", "key", F.length("p").alias("size"), F.when(F.col("entity_type") == "IBAN", account).otherwise(code).alias("valid"))


def roster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a watchlist and of a roster together: where both find one, the longer or the first stays."""
    return _found(corpus.files(spark, sf_dir), _only("NAME", names=WATCHLIST[:2], roster_names=ROSTER))


def occurrence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of entities that are not linked: a group an occurrence."""
    own = scan(corpus.files(spark, sf_dir), _only("NAME", "MATRICOLA", names=WATCHLIST), ("file", "entity_type", "text", "start", "line_no", "col_no"))
    return groups.group_findings(own).select("entity_type", "key", "original", "hits", "locations")


_JOINT = ("o_orderkey AS id", "'MARIO' || (case cast(o_orderkey % 6 as int) when 0 then ' ' when 1 then '   ' when 2 then chr(9) when 3 then chr(10) when 4 then ', ' else '' end) || 'ROSSI' AS text", "o_orderkey % 5 = 0 AS alike")


def names_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names side by side, of one source or of two: joined where only blanks of one line stand between them."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_JOINT)
    own = "array(struct('NAME', 0, 5, 0.7D, 'watchlist'), struct('NAME', length(text) - 5, length(text), 0.92D, if(alike, 'watchlist', 'employee_roster')))"
    texts, body = with_pages(rows.withColumn("found", F.expr(own).cast(FOUND)))
    joined = texts.select("id", F.explode(overlaps.joined_names(body, F.col("found"))).alias("x"))
    return joined.select("id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.confidence").alias("confidence"), F.col("x.source").alias("source"))


_RAW = "c_name || chr(13) || chr(10) || (case cast(c_custkey % 3 as int) when 0 then 'caff' || chr(233) when 1 then 'a' || chr(13) || 'b' else '' end) || chr(10) || c_mktsegment"


def texts_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in UTF-8 or else Latin-1, with all sorts of newlines, as texts."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr(_RAW).alias("raw"))
    content = F.when(F.col("c_custkey") % 2 == 0, F.encode("raw", "ISO-8859-1")).otherwise(F.encode("raw", "UTF-8"))
    return rows.select("c_custkey", decoded(content).alias("text"))


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the order of reports, each file's numbered."""
    own = scan(corpus.files(spark, sf_dir), _only("IBAN", "EMAIL", "PHONE")).withColumns({"folder": reports.folder_of(F.col("file"))})
    place = F.row_number().over(Window.partitionBy("file").orderBy("start", "end"))
    return own.select("folder", "file", place.alias("place"), "entity_type", "text")


_SEVERAL = "'       MOVE ''5' || lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0') || chr(39) || ' TO WS-MATRICOLA. MATR: ' || lpad(cast(o_custkey % 1000000 as varchar(20)), 6, '0') || chr(13) || chr(10) || chr(9) || 'tel: 02' || lpad(cast(o_orderkey % 100000000 as varchar(20)), 8, '0') || ' a@b' || cast(o_custkey % 9 as varchar(20)) || '.it,c.d@e.org'"


def several_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with Windows newlines, tabs, and several hits a line."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("file"), decoded(F.encode(F.expr(_SEVERAL), "UTF-8")).alias("text"))
    return scan(rows, _only("EMAIL", "PHONE", "MATRICOLA")).select("file", "entity_type", "text", "start", "end", "line_no", "col_no", "context")


def anonymized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir)
    own = scan(texts, _only("EMAIL"))
    mapping = groups.replacement_map(groups.group_findings(own), SALT, auto=True)
    return replace.apply_map(texts, own, mapping).filter("replacements > 0")


def detector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("lang", "source", F.size(matches(F.col("text"), detectors.FOLD + detectors.EMAIL)).alias("n"))
    return own.rollup("lang", "source").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("emails"), F.grouping_id().cast("int").alias("level"))


def names_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("file", "entity_type", "text", "start", "end", "line_no", "col_no", "confidence", "source")
    return reports.name_rows(stash(all_findings(spark, sf_dir, *fields).filter("entity_type = 'NAME'"), "findings")).select("name", "folder", "file", "line", "column", "confidence", "source")


def finding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_findings(spark, sf_dir, "file", "entity_type", "source").groupBy("entity_type", "source").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("file").alias("files"))


def queries() -> dict[str, Query]:
    return {
        "email_findings": email_findings,
        "email_groups": email_groups,
        "iban_findings": findings_of("IBAN"),
        "cf_findings": findings_of("CODICE_FISCALE"),
        "matricola_labelled": findings_of("MATRICOLA"),
        "matricola_roster": matricola_roster,
        "phone_findings": findings_of("PHONE"),
        "name_context_lines": lambda s, d: _lines(s, d, ranges.name_line),
        "comment_lines": lambda s, d: _lines(s, d, ranges.comment_line),
        "scan_ranges_merged": scan_ranges,
        "watchlist_names": watchlist_names,
        "roster_variants": roster_variants,
        "unknown_name_candidates": unknown_names,
        "overlaps_resolved": overlaps_resolved,
        "value_groups_ranked": value_groups,
        "map_last_wins": _chosen,
        "replacement_map": replacement_map,
        "pseudonym_iban": pseudonyms_of("IBAN"),
        "pseudonym_cf": pseudonyms_of("CODICE_FISCALE"),
        "pseudonym_matricola": pseudonyms_of("MATRICOLA"),
        "pseudonym_checks": pseudonym_checks,
        "roster_names": roster_names,
        "occurrence_keys": occurrence_keys,
        "names_joined": names_joined,
        "texts_decoded": texts_decoded,
        "report_order": report_order,
        "several_hits": several_hits,
        "anonymized_text": anonymized_text,
        "detector_coverage": detector_coverage,
        "names_report": names_report,
        "finding_totals": finding_totals,
    }


# --- The same in SQL ---------------------------------------------------------------------------------------

_WORD_EMAIL = f"\\b{_CHARS['EMAIL']}\\b"


def _spans(table: str, key: str, pattern: str) -> str:
    """hits: key, text, value, start; pieces between matches give the offsets."""
    return f"""cut AS (SELECT {key} AS file, text, regexp_extract_all(text, '{pattern}', 0, 'i') AS m, regexp_split_to_array(text, '{pattern}', 'i') AS g FROM {table}),
each AS (SELECT file, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0),
hits AS (SELECT file, text, m[i] AS value, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS INTEGER) AS s FROM each)"""


def _placed(entity: str, confidence: float, source: str = "regex") -> str:
    return f"""placed AS (SELECT file, text AS body, value, s, CAST(s + length(value) AS INTEGER) AS e, CAST(1 + length(text[1:s]) - length(replace(text[1:s], chr(10), '')) AS INTEGER) AS line_no,
    CAST(1 + length(list_extract(string_split(text[1:s], chr(10)), -1)) AS INTEGER) AS col_no FROM hits),
found AS (SELECT file, '{entity}' AS entity_type, value AS text, s AS start, e AS "end", line_no, col_no, CAST({confidence} AS DOUBLE) AS confidence, '{source}' AS source, body FROM placed)"""


_COLUMNS = 'file, entity_type, text, start, "end", line_no, col_no, confidence, source'
_DOCS_EMAIL = f"WITH {_spans('documents', 'CAST(doc_id AS VARCHAR)', _WORD_EMAIL)}, {_placed('EMAIL', 0.98)}"


def _files(pattern: str, entity: str, confidence: float) -> str:
    return f"WITH {corpus.FILES_SQL}, {_spans('files', 'file', pattern)}, {_placed(entity, confidence)}"


def _by_line(hit: str, entity: str, confidence: str, source: str, where: str) -> str:
    """At most one hit a line."""
    return f"""WITH {corpus.LINES_SQL}, one AS (SELECT file, line, line_no, line_start, {hit} AS value FROM lines WHERE {where})
SELECT file, {entity} AS entity_type, value AS text, CAST(line_start + strpos(line, value) - 1 AS INTEGER) AS start, CAST(line_start + strpos(line, value) - 1 + length(value) AS INTEGER) AS "end",
    CAST(line_no AS INTEGER) AS line_no, CAST(strpos(line, value) AS INTEGER) AS col_no, CAST({confidence} AS DOUBLE) AS confidence, {source} AS source FROM one WHERE value <> ''"""


def _group(found: str) -> str:
    """keyed: entity_type, key, original, hits, locations of linkable findings in the table ``found``."""
    return f"""seen AS (SELECT *, row_number() OVER (PARTITION BY entity_type, upper(text) ORDER BY file, start) AS n FROM {found}),
keyed AS (SELECT entity_type, upper(text) AS key, max(CASE WHEN n = 1 THEN text END) AS original, count(*) AS hits,
    string_agg(CASE WHEN n <= 8 THEN file || ':' || line_no END, ', ' ORDER BY n) || CASE WHEN count(*) > 8 THEN ' +' || (count(*) - 8) || ' more' ELSE '' END AS locations FROM seen GROUP BY entity_type, upper(text))"""


_RANK = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REPORT_ORDER.items()) + " END"
_ANY_NAME = "(?:De Luca|" + "|".join(n for n in WATCHLIST if " " not in n) + ")"
_NAMES_SQL = f"""SELECT file, 'NAME' AS entity_type, value AS text, CAST(line_start + strpos(line, value) - 1 AS INTEGER) AS start, CAST(line_start + strpos(line, value) - 1 + length(value) AS INTEGER) AS "end",
    CAST(line_no AS INTEGER) AS line_no, CAST(strpos(line, value) AS INTEGER) AS col_no, CAST(0.7 AS DOUBLE) AS confidence, 'watchlist' AS source
FROM (SELECT *, regexp_extract(split_part(line, ' MAIL ', 1), '\\b{_ANY_NAME}(?:\\s+{_ANY_NAME})*\\b', 0, 'i') AS value FROM lines WHERE line LIKE '      * %' OR line LIKE '%''%') WHERE value <> ''"""
_STAFF_SQL = _by_line("coalesce(nullif(regexp_extract(line, 'VALUE ''(5[0-9]{6})''', 1), ''), nullif(regexp_extract(line, 'MOVE (6[0-9]{6}) TO', 1), ''), nullif(regexp_extract(line, 'MATRICOLA: ([0-9]{6}) ', 1), ''), '')", "'MATRICOLA'", "0.84", "'regex'", "true")
_PHONE_SQL = _by_line("regexp_extract(line, 'TEL ([0-9]+)', 1)", "'PHONE'", "0.78", "'regex'", "true")
_IBAN, _CF = "\\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\\b", "\\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\\b"
_CHOSEN_SQL = """SELECT 'EMAIL' AS entity_type, upper('luca.bianchi' || cast(o_custkey % 50 as varchar) || '@example.com') AS key, arg_max('chosen' || cast(o_orderkey as varchar), o_orderkey) AS replacement FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey % 50"""
_LINKABLE_SQL = f"""WITH {corpus.LINES_SQL}, hit AS (SELECT file, line, line_no, line_start, unnest([
    {{'entity_type': 'IBAN', 'value': regexp_extract(line, '{_IBAN}', 0)}}, {{'entity_type': 'CODICE_FISCALE', 'value': regexp_extract(line, '{_CF}', 0)}},
    {{'entity_type': 'EMAIL', 'value': regexp_extract(line, '{_WORD_EMAIL}', 0, 'i')}}, {{'entity_type': 'PHONE', 'value': regexp_extract(line, 'TEL ([0-9]+)', 1)}}]) AS x FROM lines),
found AS (SELECT file, x.entity_type AS entity_type, x.value AS text, line_no, line_start + strpos(line, x.value) AS start FROM hit WHERE x.value <> '')"""


def _lines_sql(markers: bool) -> str:
    from veilwright.fixed import NAME_LINE_MARKERS

    said = " OR ".join(f"contains(upper(line), '{m}')" for m in NAME_LINE_MARKERS)
    rule = "(ltrim(line) LIKE '*%' OR ltrim(line) LIKE '//*%' OR substr(line, 7, 1) = '*'" + (f" OR {said})" if markers else ")")
    return f"WITH {corpus.LINES_SQL} SELECT file, CAST(line_no AS INTEGER) AS line_no, line FROM lines WHERE {rule}"


def _ranges_sql() -> str:
    chosen = _lines_sql(True).replace("SELECT file, CAST(line_no AS INTEGER) AS line_no, line FROM", "SELECT file, line_start AS s, line_start + length(line) + CASE WHEN line_no < max(line_no) OVER (PARTITION BY file) THEN 1 ELSE 0 END AS e, line_no FROM").removeprefix(f"WITH {corpus.LINES_SQL} ")
    # the end of the text has no newline: the last line is told before the rule is applied
    chosen = chosen.replace("FROM lines WHERE", "FROM (SELECT *, max(line_no) OVER (PARTITION BY file) AS last FROM lines) WHERE").replace("max(line_no) OVER (PARTITION BY file) THEN", "last THEN")
    return f"""WITH {corpus.LINES_SQL}, quoted AS (SELECT file, line_start + strpos(line, q) - 1 AS s, line_start + strpos(line, q) - 1 + length(q) AS e FROM (SELECT *, regexp_extract(line, '''[^'']{{2,160}}''', 0) AS q FROM lines) WHERE q <> ''),
spans AS (SELECT file, s, e FROM ({chosen}) UNION ALL SELECT file, s, e FROM quoted),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
island AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT file, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end" FROM island GROUP BY file, k"""


def _unknown_sql() -> str:
    from veilwright.fixed import COMMON_ENDINGS, NAME_CONTEXT_WORDS, NAME_STOPWORDS, UNKNOWN_NAME_PREFIXES, UNKNOWN_NAME_STOPWORDS

    quote = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    said = " OR ".join(f"contains(upper(line), '{w}')" for w in NAME_CONTEXT_WORDS)
    return f"""WITH {corpus.LINES_SQL}, segment AS (SELECT file, line_no, line, ltrim(line) LIKE '*%' AS noted, CASE WHEN ltrim(line) LIKE '*%' THEN split_part(line, ' MAIL ', 1) ELSE regexp_extract(line, '''[^'']{{2,160}}''', 0) END AS seg FROM lines),
token AS (SELECT file, line_no, line, noted, unnest(regexp_split_to_array(seg, '[^A-Za-z0-9_'']+')) AS t FROM segment),
word AS (SELECT file, line_no, line, noted, trim(t, '''') AS w FROM token WHERE regexp_full_match(t, '[A-Z][A-Z'']{{2,}}'))
SELECT file, CAST(line_no AS INTEGER) AS line_no, w AS text, CAST(CASE WHEN contains(w, '''') THEN 0.72 WHEN {said} THEN 0.68 ELSE 0.58 END AS DOUBLE) AS confidence FROM word
WHERE length(replace(w, '''', '')) >= 4 AND w NOT IN ({quote(NAME_STOPWORDS + UNKNOWN_NAME_STOPWORDS + NAME_CONTEXT_WORDS)}) AND NOT regexp_matches(w, '^({"|".join(UNKNOWN_NAME_PREFIXES)})')
    AND (contains(w, '''') OR {said} OR (noted AND length(w) BETWEEN 4 AND 18 AND NOT regexp_matches(w, '({"|".join(COMMON_ENDINGS)})$')))"""


def _overlaps_sql() -> str:
    kinds = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
    ranks = "[" + ", ".join(str(PRIORITY[k]) for k in _KINDS) + "]"
    return f"""WITH RECURSIVE spans AS (SELECT {', '.join(_SPAN_ROWS)} FROM lineitem),
sorted AS (SELECT *, {ranks}[kind + 1] AS p, row_number() OVER (PARTITION BY file ORDER BY s, -{ranks}[kind + 1], s - e, ord) AS n FROM spans),
step AS (SELECT file, n, e AS last_e, p AS last_p, e - s AS last_l, 'keep' AS act FROM sorted WHERE n = 1
    UNION ALL SELECT x.file, x.n, CASE WHEN f OR b THEN x.e ELSE t.last_e END, CASE WHEN f OR b THEN x.p ELSE t.last_p END, CASE WHEN f OR b THEN x.e - x.s ELSE t.last_l END, CASE WHEN f THEN 'keep' WHEN b THEN 'swap' ELSE 'drop' END
    FROM step t JOIN sorted x ON x.file = t.file AND x.n = t.n + 1, LATERAL (SELECT x.s >= t.last_e AS f, x.p > t.last_p OR (x.p = t.last_p AND x.e - x.s > t.last_l) AS b)),
acts AS (SELECT file, n, lead(act) OVER (PARTITION BY file ORDER BY n) AS later FROM step WHERE act <> 'drop')
SELECT s.file, {kinds}[s.kind + 1] AS entity_type, s.s AS start, s.e AS "end" FROM acts a JOIN sorted s ON s.file = a.file AND s.n = a.n WHERE coalesce(a.later, 'keep') <> 'swap'"""


_BIG, _TWO32 = 10**27, 1 << 32
#: By entity: parts of the pseudonym as (suffix of the salt, kind, characters), and whether the group's key belongs to the hashed text.
_PARTS = {
    "IBAN": ((":iban-cin", "letters", 1), (":iban-bank", "digits", 10), (":iban-account", "digits", 12)),
    "CODICE_FISCALE": ((":cf1", "letters", 6), (":cf2", "digits", 2), (":cf3", "letters", 1), (":cf4", "digits", 2), (":cf5", "letters", 1), (":cf6", "digits", 3)),
    "MATRICOLA": ((":matricola", "digits", 6), (":matricola-prefix", "third", 1)),
}


def _divided(limbs: list[str], by: int, name: str) -> str:
    """Columns of a long division of 32-bit limbs: remainders ``name`` r0 .. r7 and quotients ``name`` q0 .. q7."""
    out, rest = [], "0::HUGEINT"
    for k, limb in enumerate(limbs):
        now = f"({rest} * {_TWO32}::HUGEINT + {limb})"
        out += [f"{now} % {by}::HUGEINT AS {name}r{k}", f"{now} // {by}::HUGEINT AS {name}q{k}"]
        rest = f"{name}r{k}"
    return ", ".join(out)


def _pseudonym_sql(groups_sql: str, entities: tuple[str, ...]) -> str:
    """made: entity_type, key, original, p; ``groups_sql`` makes the table ``g`` (entity_type, key, original)."""
    parts = [(e, k, *x) for e in entities for k, x in enumerate(_PARTS[e])]
    values = ", ".join(f"('{e}', {k}, '{suffix}', '{kind}', {n})" for e, k, suffix, kind, n in parts)
    limbs = ", ".join(f"CAST('0x' || h[{8 * k + 1}:{8 * k + 8}] AS HUGEINT) AS l{k}" for k in range(8))
    top = "t0"
    for k in range(1, 8):
        top = f"({top} * {_TWO32}::HUGEINT + bq{k})" if k > 1 else f"(bq0 * {_TWO32}::HUGEINT + bq1)"
    fold = lambda by: "".join("(" for _ in range(8)) + "0::HUGEINT" + "".join(f" * {_TWO32} + l{k}) % {by}" for k in range(8))
    letters = " || ".join(f"chr(CAST((({fold(26**6)}) // {26**k}) % 26 + 65 AS INTEGER))" for k in range(6))
    odd = ", ".join(map(str, TAX_CODE_ODD))
    place = "CASE WHEN f[i] BETWEEN '0' AND '9' THEN ascii(f[i]) - 48 ELSE ascii(f[i]) - 65 END"
    weights = f"list_sum([CASE WHEN i % 2 = 1 THEN [{odd}][({place}) + 1] ELSE {place} END FOR i IN range(1, 16)])"
    to_digits = lambda x: f"list_aggregate([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END FOR c IN string_split({x}, '')], 'string_agg', '')"
    return f"""{groups_sql},
part(entity_type, k, suffix, kind, n) AS (VALUES {values}),
hashed AS (SELECT g.entity_type, key, original, k, kind, n, sha256('{SALT}' || suffix || ':' || upper(CASE WHEN g.entity_type = 'MATRICOLA' THEN original || ':' || key ELSE original END)) AS h FROM g JOIN part USING (entity_type)),
limbs AS (SELECT *, {limbs} FROM hashed),
once AS (SELECT *, {_divided([f"l{k}" for k in range(8)], _BIG, "a")} FROM limbs),
twice AS (SELECT *, {_divided([f"aq{k}" for k in range(8)], _BIG, "b")} FROM once),
number AS (SELECT *, ltrim(CAST({top.replace("t0", "bq0")} AS VARCHAR) || lpad(CAST(br7 AS VARCHAR), 27, '0') || lpad(CAST(ar7 AS VARCHAR), 27, '0'), '0') AS d, {letters} AS w, {fold(3)} AS third FROM twice),
field AS (SELECT entity_type, key, original, k, CASE kind WHEN 'digits' THEN repeat(d, n)[1:n] WHEN 'letters' THEN w[1:n] ELSE '567'[CAST(third AS INTEGER) + 1] END AS v FROM number),
bare AS (SELECT entity_type, key, original, max(CASE WHEN k = 0 THEN v END) AS v0, max(CASE WHEN k = 1 THEN v END) AS v1, string_agg(v, '' ORDER BY k) AS f FROM field GROUP BY entity_type, key, original),
made AS (SELECT entity_type, key, original, CASE entity_type WHEN 'IBAN' THEN 'IT' || lpad(CAST(98 - CAST({to_digits("f || 'IT00'")} AS HUGEINT) % 97 AS VARCHAR), 2, '0') || f
    WHEN 'CODICE_FISCALE' THEN f || chr(CAST({weights} % 26 + 65 AS INTEGER)) WHEN 'MATRICOLA' THEN CASE WHEN length(original) = 7 THEN v1 ELSE '' END || v0 END AS p FROM bare),
checked AS (SELECT *, CASE entity_type WHEN 'IBAN' THEN CAST({to_digits("p[5:] || p[1:4]")} AS HUGEINT) % 97 = 1 ELSE regexp_full_match(p, '[A-Z]{{6}}[0-9]{{2}}[A-Z][0-9]{{2}}[A-Z][0-9]{{3}}[A-Z]') END AS valid FROM made)"""


_LINKED = f"{_LINKABLE_SQL}, g AS (SELECT DISTINCT entity_type, upper(text) AS key, upper(text) AS original FROM found WHERE entity_type IN ('IBAN', 'CODICE_FISCALE'))"
_STAFF_GROUPS = f"WITH s AS ({_STAFF_SQL}), g AS (SELECT entity_type, 'OCCURRENCE:' || file || ':' || line_no || ':' || col_no || ':' || text AS key, text AS original FROM s)"
_PEOPLE = "(?:MARIO|LUCA)"
_ROSTER_SQL = f"""SELECT file, 'NAME' AS entity_type, value AS text, CAST(line_start + strpos(line, value) - 1 AS INTEGER) AS start, CAST(line_start + strpos(line, value) - 1 + length(value) AS INTEGER) AS "end",
    CAST(line_no AS INTEGER) AS line_no, CAST(strpos(line, value) AS INTEGER) AS col_no, CAST(CASE WHEN contains(value, ' ') THEN 0.92 ELSE 0.7 END AS DOUBLE) AS confidence, CASE WHEN contains(value, ' ') THEN 'employee_roster' ELSE 'watchlist' END AS source
FROM (SELECT *, unnest(regexp_extract_all(split_part(line, ' MAIL ', 1), '\\b(?:GIULIA BIANCHI|LUCA CONTI|{_PEOPLE})\\b', 0, 'i')) AS value FROM lines WHERE line LIKE '      * %' OR line LIKE '%''%') WHERE value <> ''"""
_TOKENS = "[t FOR t IN regexp_extract_all(regexp_replace(line, '[567]?[0-9]{6}', ' ', 'g'), '[A-Za-z][A-Za-z''-]*', 0) IF upper(t) NOT IN (" + ", ".join(f"'{w}'" for w in ROSTER_STOPWORDS) + ")]"


def oracle_sql() -> dict[str, str]:
    shown = "coalesce(nullif(c.replacement, ''), '')"
    mapped = f"""{_LINKABLE_SQL}, {_group("(SELECT * FROM found WHERE entity_type IN ('EMAIL', 'PHONE'))")},
numbered AS (SELECT *, row_number() OVER (ORDER BY {_RANK}, upper(original)) AS i FROM keyed)"""
    totals = f"""WITH {corpus.LINES_SQL}, hit AS (SELECT file, unnest([{{'t': 'IBAN', 's': 'regex', 'v': regexp_extract(line, '{_IBAN}', 0)}}, {{'t': 'CODICE_FISCALE', 's': 'regex', 'v': regexp_extract(line, '{_CF}', 0)}},
    {{'t': 'EMAIL', 's': 'regex', 'v': regexp_extract(line, '{_WORD_EMAIL}', 0, 'i')}}, {{'t': 'PHONE', 's': 'regex', 'v': regexp_extract(line, 'TEL ([0-9]+)', 1)}},
    {{'t': 'MATRICOLA', 's': 'regex', 'v': regexp_extract(line, '(VALUE ''5[0-9]{{6}}''|MOVE 6[0-9]{{6}} TO|MATRICOLA: [0-9]{{6}} )', 0)}},
    {{'t': 'NAME', 's': 'watchlist', 'v': CASE WHEN line LIKE '      * %' OR line LIKE '%''%' THEN regexp_extract(split_part(line, ' MAIL ', 1), '\\b{_ANY_NAME}\\b', 0, 'i') ELSE '' END}}]) AS x FROM lines)
SELECT x.t AS entity_type, x.s AS source, count(*) AS hits, count(DISTINCT file) AS files FROM hit WHERE x.v <> '' GROUP BY x.t, x.s"""
    return {
        "email_findings": f"{_DOCS_EMAIL} SELECT {_COLUMNS}, body[greatest(start - 75, 0) + 1:start] || '[[' || text || ']]' || body[\"end\" + 1:\"end\" + 75] AS context FROM found",
        "email_groups": f"{_DOCS_EMAIL}, {_group('found')} SELECT * FROM keyed",
        "iban_findings": f"{_files(_IBAN, 'IBAN', 0.96)} SELECT {_COLUMNS} FROM found",
        "cf_findings": f"{_files(_CF, 'CODICE_FISCALE', 0.96)} SELECT {_COLUMNS} FROM found",
        "matricola_labelled": _STAFF_SQL,
        "matricola_roster": f"""WITH roster AS (SELECT DISTINCT '5' || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') AS m FROM orders WHERE o_orderkey % 3 = 0), {corpus.LINES_SQL},
one AS (SELECT *, regexp_extract(line, '(?:^|[^A-Za-z0-9])([567]?[0-9]{{6}})(?:[^A-Za-z0-9]|$)', 1) AS value FROM lines)
SELECT file, CASE WHEN m IS NULL THEN 'SUSPECTED_MATRICOLA' ELSE 'MATRICOLA' END AS entity_type, value AS text, CAST(line_start + strpos(line, value) - 1 AS INTEGER) AS start, CAST(line_start + strpos(line, value) - 1 + length(value) AS INTEGER) AS "end",
    CAST(CASE WHEN m IS NULL THEN 0.68 ELSE 0.99 END AS DOUBLE) AS confidence, CASE WHEN m IS NULL THEN 'not_in_employee_roster' ELSE 'employee_roster' END AS source FROM one LEFT JOIN roster ON m = value WHERE value <> ''""",
        "phone_findings": _PHONE_SQL,
        "name_context_lines": _lines_sql(True),
        "comment_lines": _lines_sql(False),
        "scan_ranges_merged": _ranges_sql(),
        "watchlist_names": f"WITH {corpus.LINES_SQL} {_NAMES_SQL}",
        "roster_variants": f"""WITH r AS (SELECT {_ROSTER_LINE} AS line FROM customer), v AS (
SELECT 'matricula' AS kind, regexp_extract(line, '[567][0-9]{{6}}', 0) AS value FROM r
UNION ALL SELECT 'name', unnest(list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN CASE WHEN length(t[1]) >= 2 THEN t ELSE [] END
    ELSE [x FOR x IN [array_to_string(t, ' '), CASE WHEN len(t) = 2 THEN t[2] || ' ' || t[1] END, CASE WHEN length(t[1]) > 2 THEN t[1][1] || ' ' || array_to_string(t[2:], ' ') END] IF x IS NOT NULL] END)) FROM (SELECT {_TOKENS} AS t FROM r WHERE line NOT LIKE '#%'))
SELECT kind, value, count(*) AS n FROM v WHERE value <> '' GROUP BY kind, value""",
        "unknown_name_candidates": _unknown_sql(),
        "overlaps_resolved": _overlaps_sql(),
        "value_groups_ranked": f"{_LINKABLE_SQL}, {_group('found')} SELECT CAST(row_number() OVER (ORDER BY {_RANK}, upper(original)) AS INTEGER) AS index, entity_type, key, original, hits, locations FROM keyed",
        "map_last_wins": _CHOSEN_SQL,
        "replacement_map": f"""{mapped} SELECT CAST(n.i AS INTEGER) AS index, n.entity_type, n.key, original, CASE n.entity_type WHEN 'EMAIL' THEN 'user' || CASE WHEN i < 1000 THEN lpad(cast(i as varchar), 3, '0') ELSE cast(i as varchar) END || '@example.invalid' ELSE repeat('0', greatest(length(original), 8)) END AS suggested_replacement,
{shown} AS replacement, hits FROM numbered n LEFT JOIN ({_CHOSEN_SQL}) c ON c.entity_type = n.entity_type AND c.key = n.key""",
        "pseudonym_iban": f"{_pseudonym_sql(_LINKED, ('IBAN',))} SELECT key, original, p AS suggested_replacement FROM made WHERE entity_type = 'IBAN'",
        "pseudonym_cf": f"{_pseudonym_sql(_LINKED, ('CODICE_FISCALE',))} SELECT key, original, p AS suggested_replacement FROM made WHERE entity_type = 'CODICE_FISCALE'",
        "pseudonym_matricola": f"{_pseudonym_sql(_STAFF_GROUPS, ('MATRICOLA',))} SELECT key, original, p AS suggested_replacement FROM made",
        "pseudonym_checks": f"{_pseudonym_sql(_LINKED, ('IBAN', 'CODICE_FISCALE'))} SELECT entity_type, key, CAST(length(p) AS INTEGER) AS size, valid FROM checked",
        "roster_names": f"WITH {corpus.LINES_SQL} {_ROSTER_SQL}",
        "occurrence_keys": f"""WITH {corpus.LINES_SQL}, staff AS ({_STAFF_SQL}), every AS ({_NAMES_SQL} UNION ALL SELECT * FROM staff)
SELECT entity_type, 'OCCURRENCE:' || file || ':' || line_no || ':' || col_no || ':' || upper(text) AS key, text AS original, CAST(1 AS BIGINT) AS hits, file || ':' || line_no AS locations FROM every""",
        "names_joined": f"""WITH r AS (SELECT {', '.join(_JOINT)} FROM orders), j AS (SELECT *, regexp_full_match(text, 'MARIO[ \\t]+ROSSI') AS one FROM r)
SELECT id, CAST(0 AS INTEGER) AS start, CAST(CASE WHEN one THEN length(text) ELSE 5 END AS INTEGER) AS "end", CAST(CASE WHEN one THEN 0.92 ELSE 0.7 END AS DOUBLE) AS confidence, CASE WHEN one AND NOT alike THEN 'mixed' ELSE 'watchlist' END AS source FROM j
UNION ALL SELECT id, CAST(length(text) - 5 AS INTEGER), CAST(length(text) AS INTEGER), CAST(0.92 AS DOUBLE), CASE WHEN alike THEN 'watchlist' ELSE 'employee_roster' END FROM j WHERE NOT one""",
        "texts_decoded": f"SELECT c_custkey, replace(replace({_RAW}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM customer",
        "report_order": f"{_LINKABLE_SQL} SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder, file, CAST(row_number() OVER (PARTITION BY file ORDER BY start) AS INTEGER) AS place, entity_type, text FROM found WHERE entity_type <> 'CODICE_FISCALE'",
        "several_hits": f"""WITH t AS (SELECT cast(o_orderkey as varchar) AS file, replace({_SEVERAL}, chr(13) || chr(10), chr(10)) AS body FROM orders),
v AS (SELECT file, body, unnest([{{'e': 'MATRICOLA', 'p': 0, 'x': '5[0-9]{{6}}'}}, {{'e': 'MATRICOLA', 'p': 0, 'x': 'MATR: [0-9]{{6}}'}}, {{'e': 'PHONE', 'p': 5, 'x': 'tel: [0-9]+'}}, {{'e': 'EMAIL', 'p': 0, 'x': 'a@b[0-9][.]it'}}, {{'e': 'EMAIL', 'p': 0, 'x': 'c[.]d@e[.]org'}}]) AS w FROM t),
m AS (SELECT file, body, w.e AS entity_type, regexp_extract(body, w.x, 0) AS whole FROM v),
n AS (SELECT file, body, entity_type, regexp_replace(whole, '^(MATR: |tel: )', '') AS text, strpos(body, whole) - 1 + length(whole) AS "end" FROM m),
o AS (SELECT *, "end" - length(text) AS start FROM n)
SELECT file, entity_type, text, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(CASE WHEN start > strpos(body, chr(10)) THEN 2 ELSE 1 END AS INTEGER) AS line_no,
    CAST(CASE WHEN start > strpos(body, chr(10)) THEN start - strpos(body, chr(10)) ELSE start END + 1 AS INTEGER) AS col_no, body[greatest(start - 75, 0) + 1:start] || '[[' || text || ']]' || body["end" + 1:"end" + 75] AS context FROM o""",
        "anonymized_text": f"""{_DOCS_EMAIL}, {_group('found')}, numbered AS (SELECT key, row_number() OVER (ORDER BY upper(original)) AS i FROM keyed),
swap AS (SELECT f.file, f.body, f.start AS s, f."end" AS e, 'user' || CASE WHEN i < 1000 THEN lpad(cast(i as varchar), 3, '0') ELSE cast(i as varchar) END || '@example.invalid' AS r,
    coalesce(lag(f."end") OVER (PARTITION BY f.file ORDER BY f.start), 0) AS since, lead(f.start) OVER (PARTITION BY f.file ORDER BY f.start) IS NULL AS last FROM found f JOIN numbered n ON n.key = upper(f.text))
SELECT file, string_agg(body[since + 1:s] || r || CASE WHEN last THEN body[e + 1:] ELSE '' END, '' ORDER BY s) AS text, CAST(count(*) AS INTEGER) AS replacements FROM swap GROUP BY file""",
        "detector_coverage": f"""SELECT lang, source, count(*) AS texts, CAST(sum(coalesce(len(regexp_extract_all(text, '{_WORD_EMAIL}', 0, 'i')), 0)) AS BIGINT) AS emails, CAST(grouping(lang, source) AS INTEGER) AS level FROM documents GROUP BY ROLLUP (lang, source)""",
        "names_report": f"""WITH {corpus.LINES_SQL} SELECT text AS name, regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder, file, line_no AS line, col_no AS "column", printf('%.4f', confidence) AS confidence, source FROM ({_NAMES_SQL})""",
        "finding_totals": totals,
    }
