"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed  # noqa: F401

#: The folder of the public tokenizers' files.
TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))

#: Byte table that lower-cases A-Z and leaves every other byte (UTF-8 parts included) alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by its folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, which is counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def numbered_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(words, numbers, lengths): the distinct words of texts, A-Z lower-cased and parted at ASCII white space; all texts' word numbers one after another; words a text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    values, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    some = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty piece
    coded = values.filter(pa.array(some)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.bincount(of[some], minlength=len(texts))


def pieces(batches, size: int):
    """(keys, texts) of a task's rows (key, text), about ``size`` bytes of texts at a time, unless one text is longer."""
    keys, texts, have = [], [], 0
    for b in batches:
        n = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).tolist()
        at = 0
        for i, k in enumerate(n):
            if have and have + k > size:
                yield pa.concat_arrays([*keys, b.column(0).slice(at, i - at)]), pa.concat_arrays([*texts, b.column(1).slice(at, i - at)])
                keys, texts, have, at = [], [], 0, i
            have += k + 1
        if at < b.num_rows:
            keys.append(b.column(0).slice(at))
            texts.append(b.column(1).slice(at))
    if keys:
        yield pa.concat_arrays(keys), pa.concat_arrays(texts)
