"""Token counts of texts by a public tokenizer whose file is named by a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: File of the tokenizer's ranks (tiktoken form); the variable overrides it.
VOCABULARY = os.environ.get("THICKET_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How a text is divided before merging; fixed value of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The encoding of the file at ``path``, built once per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text (int); null and empty texts have none. Special-token strings count as ordinary text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
