"""Text sizes in tokens of a public tokenizer, whose vocabulary file is a parameter.

The file is read on the driver and sent to the executors, which need not have it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> tuple[bytes, str]:
    """The file of ranks and the pattern that cuts texts into words."""
    import public_tokenizers

    with open(path, "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """A byte-level BPE encoding from the content of a file of ranks."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of the documents with a text; whole texts are encoded."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))  # a vocabulary is a file of fixed size

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(*sent.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    return documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source", "text").mapInPandas(measure, "doc_id bigint, source string, tokens bigint")
