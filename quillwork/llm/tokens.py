"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import os

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary file is on the driver, which sends it to the workers; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("QUILLWORK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Size of a vocabulary file, at most.
MOST_BYTES = 64 * 1024 * 1024
_loaded: dict = {}


def encoder(vocabulary: str, content: bytes | None = None):
    """The byte-level encoder of a rank file (its content, or what is at its path), loaded once a worker."""
    if vocabulary not in _loaded:
        import tiktoken

        if content is None:
            with open(vocabulary, "rb") as f:
                content = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        _loaded[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for NULL and empty texts. The vocabulary (about a megabyte) is broadcast."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    if len(content) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes")
    name, held = hashlib.sha256(content).hexdigest(), SparkSession.active().sparkContext.broadcast(content)

    @F.pandas_udf(T.LongType())
    def sizes(s: pd.Series) -> pd.Series:
        encode = encoder(name, held.value).encode_ordinary
        return s.map(lambda x: len(encode(x)) if x else 0).astype("int64")

    return sizes(text)
