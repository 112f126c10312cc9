"""Encoding of whole texts with a public tokenizer, on Spark."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.bpe import PrefixEncoder, load_ranks
from tablelens.shared import exact, ship

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
_FLUSH = 2_000_000  # ids held before they are handed on

_encoders: dict[str, PrefixEncoder] = {}


def _vocabulary(spark: SparkSession, name: str, folder: str) -> Broadcast:
    """The rank file's bytes, which a vocabulary's size bounds (about 1 MB)."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        data = file.read()
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


def _encoder(shared: Broadcast) -> PrefixEncoder:
    """One encoder per worker process; it keeps what it learned for later tasks."""
    digest, data = shared.value
    if digest not in _encoders:
        _encoders[digest] = PrefixEncoder(load_ranks(data))
    return _encoders[digest]


def _encode(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    encode = _encoder(shared).encode
    for batch in batches:
        ids: list[int] = []
        ends, first = [0], 0
        for row, text in enumerate(batch["text"], 1):
            ids += encode(text.as_py())
            ends.append(len(ids))
            if len(ids) >= _FLUSH or row == batch.num_rows:
                out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, row - first), out], ["doc_id", "ids"])
                ids, ends, first = [], [0], row


def _count(batches: Iterator[pa.RecordBatch], shared: Broadcast, keep: list[str]) -> Iterator[pa.RecordBatch]:
    count = _encoder(shared).count
    for batch in batches:
        tokens = pa.array([count(text.as_py()) for text in batch["text"]], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), tokens], [*keep, "tokens"])


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every document: the ids of its whole text, without special
    tokens, whose spelling in a text is plain text. Null and empty texts have an
    empty list. Rows stay where they are; a row per row, repeated ones too."""
    ship(docs.sparkSession)
    shared = _vocabulary(docs.sparkSession, tokenizer, folder)
    return exact(docs, "doc_id", "text").mapInArrow(lambda b: _encode(b, shared), "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns keep of docs, and tokens: the length of each text's encoding."""
    ship(docs.sparkSession)
    shared = _vocabulary(docs.sparkSession, tokenizer, folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", tokens bigint"
    return docs.select(*keep, "text").mapInArrow(lambda b: _count(b, shared, keep), schema)
