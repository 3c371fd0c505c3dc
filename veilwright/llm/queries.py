"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    from veilwright.llm import bpe, ctph, exact_dedup, html_extract, langid, packing, simhash, suffix_dedup, token_store, url_filter

    return {
        "op1_token_store": lambda s, d: token_store.op1(tokenizer_file("word_bpe_49k.json"), 2)(s, d),
        "op2_exact_dedup": exact_dedup.op2,
        "op3_url_filter": url_filter.op3,
        "op4_bpe_automaton": lambda s, d: bpe.op4(tokenizer_file("byte_bpe_50k.json"))(s, d),
        "op5_suffix_dedup": suffix_dedup.op5,
        "op6_main_text": html_extract.op6,
        "op7_packing": lambda s, d: packing.op7(tokenizer_file("byte_bpe_50k.json"), 1)(s, d),
        "op8_simhash": simhash.op8,
        "op9_piecewise_hash": ctph.op9,
        "op10_language_id": langid.op10,
    }


def oracle_sql() -> dict[str, str]:
    from veilwright.llm import exact_dedup, suffix_dedup, url_filter

    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op3_url_filter": url_filter.OP3_SQL, "op5_suffix_dedup": suffix_dedup.OP5_SQL}
