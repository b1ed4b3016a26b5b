"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, on every machine of the cluster.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this tokenizer parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a file of ranks; read once per Python worker."""
    lines = Path(vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The tokens of a text; strings of special tokens are ordinary text."""
    return encoder(vocabulary).encode_to_numpy(text, disallowed_special=())


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            counts = [len(encode(t, disallowed_special=())) if t else 0 for t in (x.as_py() for x in batch.column("text"))]
            yield pa.record_batch([batch.column("id"), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row; null and empty texts have 0. Whole texts are encoded."""
    held = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return held.mapInArrow(_count(vocabulary), "id long, n_tokens long")
