"""Shared pieces: intermediate tables in the shared folder, slices of long batches, token counters."""

from __future__ import annotations

import base64
import functools
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Characters handled at once by the vectorised text kernels: bounds their memory whatever the batch holds.
SLICE_CHARS = 1 << 20


class Scratch:
    """Intermediate Parquet tables under ``spark.checkpoint.dir``.

    A written table cuts the lineage: executors that are lost later only
    re-read files that every machine sees.  Each call writes a table of its own
    (nothing is kept by name, so no stale result can be read); ``drop`` deletes
    a table that a later one has replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Pruned scan of one table, read afresh (new files at the same path are seen)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def slices(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of consecutive items whose sizes sum to at most ``limit`` (a larger item is alone)."""
    i, held = 0, 0
    for j, n in enumerate(sizes):
        if j > i and held + n > limit:
            yield i, j
            i, held = j, 0
        held += n
    if i < len(sizes):
        yield i, len(sizes)


def rows(batches: Iterator, at_once: int = 256) -> Iterator:
    """The batches in pieces of few rows: what is made of a piece, not of a batch, is held at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            yield batch.slice(i, at_once)


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (it is installed on every machine and never copied)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str):
    """tiktoken encoder over a rank file; one per Python worker."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space of the tokenizers' splitting rule, by the Unicode property.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: From this length on, runs of white space in a text are cut out before the encoder's own splitting, which can't take long ones.
_LONG = 10_000
_long_runs = re.compile(f"[{SPACE}]{{{_LONG},}}")


def count_tokens(encoder, text: str) -> int:
    """Tokens of the whole text, however long it is.

    A run of white space is one piece, but for its last character where
    something follows: that one starts the next piece.
    """
    n = at = 0
    for run in _long_runs.finditer(text) if len(text) >= 10 * _LONG else ():
        end = run.end() - (run.end() < len(text))
        n += len(encoder.encode_ordinary(text[at:run.start()])) + len(encoder._encode_single_piece(text[run.start():end]))
        at = end
    return n + len(encoder.encode_ordinary(text[at:]))


def token_counter(path: str | None = None):
    """Column function: number of tokens of the whole text (null: 0)."""
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = rank_encoder(path)
        for texts in batches:
            yield pd.Series([count_tokens(encoder, t) if t else 0 for t in texts], dtype="int64")

    return n_tokens
