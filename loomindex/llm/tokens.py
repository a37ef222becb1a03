"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; any file of base64 tokens and ranks for the pattern below will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are split before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.encode("utf-8", "replace").decode("utf-8"))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), one row per document with a text.

    Null ids and texts give no row; an empty text has 0 tokens. Of rows with the same id, the largest counts.
    The vocabulary is a file of the driver's machine; Spark sends it to the executors.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "source", "text")
    sized = texts.mapInArrow(_count(os.path.basename(vocabulary)), "doc_id bigint, source string, tokens bigint")
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("row")).select("doc_id", "row.source", "row.tokens")
