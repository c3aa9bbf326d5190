"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter and never part of this package."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

DEFAULT_TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the public split pattern that goes with the .tiktoken vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to numbers of tokens, by the kind of file: .model, .tiktoken or .json. No special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coding.encode_ordinary(x)) for x in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def with_token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each whole text; a null text has none. Executors get the vocabulary file from
    the driver; where the driver has none, the path must be one of theirs."""
    fields = documents.select(*keep).schema
    if shipped := os.path.isfile(tokenizer):
        documents.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(SparkFiles.get(os.path.basename(tokenizer)) if shipped else tokenizer)
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            n = np.array([m for i in range(0, len(texts), 256) for m in count(texts[i : i + 256])], "int64")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n)], [*keep, "n_tokens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return documents.select(*keep, "text").mapInArrow(run, schema)
