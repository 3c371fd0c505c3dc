"""Options and schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from veilwright.fixed import PRIORITY, SCOPES

FINDING = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("col_no", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("context", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
SPAN = "array<struct<start:int,end:int>>"
FOUND = "array<struct<entity_type:string,start:int,end:int,confidence:double,source:string>>"


@dataclass(frozen=True)
class ScanOptions:
    """What to look for.

    ``names``: watchlist entries; ``roster_names``: name variants from employee rosters; ``roster``: a table
    (matricula) of staff numbers, of any size: with it, every number that stands alone is reported as known or suspected;
    ``scope``: ``context`` (comments, literals and lines that speak of people) or ``all``;
    ``salt``: of pseudonyms, to be kept secret: with a known salt short numbers can be guessed.
    """

    entities: frozenset[str] = frozenset(PRIORITY)
    names: tuple[str, ...] = ()
    roster_names: tuple[str, ...] = ()
    roster: object | None = field(default=None, compare=False)
    scope: str = "context"
    unknown_names: bool = False
    unknown_min_length: int = 4
    salt: str = ""
    recognizer: object | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.scope not in SCOPES:
            raise ValueError("scope is context or all")
        if unknown := set(self.entities) - set(PRIORITY):
            raise ValueError(f"unknown entities: {sorted(unknown)}")
