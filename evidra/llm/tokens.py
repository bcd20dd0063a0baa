"""Token counts of texts by a public byte-level tokenizer. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is, unless said otherwise; EVIDRA_TOKENIZER names another file of the same form.
VOCABULARY = os.environ.get("EVIDRA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in pieces of about so many characters, so that memory stays small. A piece ends where the pattern ends a match, so no count changes.
PIECE = 50_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters, each ending with a match of the pattern that is no white space: merges never
    cross such an end, and what the pattern sees of white space depends on what follows it, which then is in the piece too."""
    start = 0
    while len(text) - start > size:
        end = len(text)
        for m in _splitter().finditer(text, start):
            if m.end() - start >= size and not text[m.end() - 1].isspace():
                end = m.end()
                break
        yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    enc = _encoder(path)
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def token_counts(docs: DataFrame, text_col: str, keep: list[str], *, path: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of every non-blank text; null and blank texts drop out."""
    some = docs.where(F.col(text_col).rlike(r"[^\s\p{Z}]")).select(*keep, F.col(text_col).alias("__text"))
    schema = some.drop("__text").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(t, path) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, out])

    return some.mapInArrow(count, f"{fields}, `{out}` bigint")
