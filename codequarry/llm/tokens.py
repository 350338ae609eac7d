"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie by default; the path is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are split by the pattern here and encoded piece by piece, as the encoder's own matcher overflows on them.
WHOLE = 20_000


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SPLIT = regex.compile(PATTERN)


def n_tokens(enc, text: str) -> int:  # noqa: ANN001
    """Exactly the number of tokens of the whole text, however long it is and whatever it holds."""
    if len(text) <= WHOLE:
        return len(enc.encode_ordinary(text))
    return sum(len(enc._core_bpe.encode_single_piece(m.group().encode("utf-8", "replace"))) for m in _SPLIT.finditer(text))


def count_tokens(df: DataFrame, *, key: str, text: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, keep..., n_tokens); null and empty texts have 0. The vocabulary is read once and travels with the tasks."""
    with open(vocabulary, "rb") as f:
        vocab = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocab.value)
        for pdf in batches:
            n = [n_tokens(enc, t) if t else 0 for t in pdf["__t"]]
            yield pdf.drop(columns="__t").assign(n_tokens=pd.array(n, dtype="int64"))

    src = df.select(key, *keep, F.col(text).alias("__t"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in (key, *keep)) + ", n_tokens long"
    return src.mapInPandas(run, schema)
