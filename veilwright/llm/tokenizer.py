"""Word tables over files of the ``tokenizers`` library, one for each worker process."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

from veilwright.llm.wordtable import WordTable

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BYTE_LEVEL = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
_BYTE_LEVEL |= {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE_TO_CHAR = [_BYTE_LEVEL[b] for b in range(256)]
CHAR_TO_BYTE = {c: b for b, c in enumerate(BYTE_TO_CHAR)}
_LATIN1 = str.maketrans({chr(b): c for b, c in enumerate(BYTE_TO_CHAR)})


def byte_level(raw: bytes) -> str:
    """Bytes in the printable alphabet of byte-level vocabularies."""
    return raw.decode("latin-1").translate(_LATIN1)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def word_table(path: str, spaced: bool) -> WordTable:
    """``spaced``: the vocabulary holds the white space before a word; else white space is dropped.

    Words made of letters alone go straight to the library's BPE model; others through its whole
    pipeline. Both give what the library gives for a whole text.
    """
    tok = load(path)
    pieces: dict[str, list[int]] = {}
    simple = re.compile(rf" ?[{_LETTERS}]+" if spaced else rf"[{_LETTERS}]+").fullmatch
    trailed = re.compile(rf"( ?[{_LETTERS}]+)([.,|]+)" if spaced else rf"([{_LETTERS}]+)([.,|]+)").fullmatch

    def piece(word: str) -> list[int]:
        word = word if spaced else word.lower()
        ids = pieces.get(word)
        if ids is None:
            if len(pieces) > 100_000:
                pieces.clear()
            ids = pieces[word] = [t.id for t in tok.model.tokenize(byte_level(word.encode()))]
        return ids

    def encode(raw: bytes) -> Sequence[int]:
        word = raw.decode()
        if simple(word):
            return piece(word)
        if m := trailed(word):
            return piece(m[1]) + piece(m[2])
        return tok.encode(word, add_special_tokens=False).ids

    return WordTable(encode, "<u2" if tok.get_vocab_size() <= 65536 else "<u4", keep_white=spaced)


def whole(path: str):
    tok = load(path)
    return lambda text: tok.encode(text, add_special_tokens=False).ids
