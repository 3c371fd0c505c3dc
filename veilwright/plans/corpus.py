"""A corpus of source files derived from the tables ``orders``, for queries: a file a customer, a line an order.

The lines are SQL text that Spark and other engines read alike. They hold what each detector looks for, and
lines that must not be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.sources.shared import spread

_KEY = "cast(o_orderkey as varchar(20))"
_SEVEN = "lpad(cast(o_orderkey % 1000000 as varchar(20)), 6, '0')"
FIRST, LAST = ("MARIO", "LUCA", "GIULIA", "Francesca"), ("ROSSI", "BIANCHI", "ESPOSITO", "De Luca", "CONTI")


def _pick(values: tuple[str, ...], by: str) -> str:
    own = " ".join(f"when {k} then '{v}'" for k, v in enumerate(values))
    return f"(case cast({by} % {len(values)} as int) {own} end)"


_NAME = f"{_pick(FIRST, 'o_orderkey')} || ' ' || {_pick(LAST, 'o_custkey')}"
LINES = (
    f"'       01 WS-MATRICOLA PIC X(7) VALUE ''5' || {_SEVEN} || '''.'",
    f"'       01 WS-IBAN PIC X(27) VALUE ''IT60X0542811101' || lpad({_KEY}, 12, '0') || '''.'",
    "'       MOVE ''RSSMRA80A01H' || lpad(cast(o_orderkey % 1000 as varchar(20)), 3, '0') || 'U'' TO WS-CF.'",
    f"'      * CONTATTARE ' || {_NAME} || ' TEL 02' || lpad(cast(o_orderkey % 100000000 as varchar(20)), 8, '0') || ' ORE'",
    f"'      * REFERENTE ' || {_NAME} || ' MAIL luca.bianchi' || cast(o_custkey % 50 as varchar(20)) || '@example.com'",
    f"'           DISPLAY ''' || {_NAME} || '''.'",
    f"'           MOVE 6' || {_SEVEN} || ' TO WS-MATR-DIP.'",
    "'           COMPUTE WS-TOT = WS-TOT + 1234567890.'",
    f"'      * MATRICOLA: ' || {_SEVEN} || ' NON MATCH'",
    f"'      * ' || upper({_pick(LAST, 'o_orderkey')})",
    "'           MOVE SPACES TO WS-ROSSI-X.'",
    "'      * SIG. D''ANGELO CHIAMARE VALIDAZIONE'",
)
LINE = "(case cast(o_orderkey % 12 as int) " + " ".join(f"when {k} then {x}" for k, x in enumerate(LINES)) + " end)"
FILE = "('SRC/C' || lpad(cast(o_custkey as varchar(20)), 7, '0') || '.CBL')"

#: For the oracle: file, text; and file, line_no, line, line_start.
FILES_SQL = f"files AS (SELECT {FILE} AS file, string_agg({LINE}, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey)"
LINES_SQL = f"""lines AS (SELECT {FILE} AS file, {LINE} AS line,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no,
    coalesce(sum(length({LINE}) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM orders)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.struct("o_orderkey", F.expr(LINE).alias("line")).alias("x"))
    texts = orders.repartition(spread(spark), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return texts.select(F.expr(FILE).alias("file"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("text"))
