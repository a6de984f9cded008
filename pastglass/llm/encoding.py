"""Encoding a corpus with a public tokenizer, as Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pastglass.llm.automaton import Automaton, compile_tables

#: Where the public vocabularies are; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

_sent: dict[tuple[str, str], Broadcast] = {}
_built: dict[str, Automaton] = {}


def tables(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The compiled automaton of a vocabulary, broadcast once for each session: its size is bounded by the vocabulary.

    The file is read on the driver only, so the executors need no copy of it.
    """
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(compile_tables(path))
    return _sent[key]


def automaton(sent: Broadcast, path: str) -> Automaton:
    """The automaton of a Python worker, built from the broadcast tables at its first use."""
    if path not in _built:
        _built[path] = Automaton(sent.value)
    return _built[path]


def _function(spark: SparkSession, path: str, kind: str, work: Callable[[Automaton, pa.Array], pa.Array]) -> Callable[..., Any]:
    sent = tables(spark, path)

    def run(values: pa.Array) -> pa.Array:
        return work(automaton(sent, path), values)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def _encode(a: Automaton, texts: pa.Array) -> pa.Array:
    offsets, ids = [0], []
    for t in texts:
        ids += a.encode(t.as_py())
        offsets.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(ids, np.int32), pa.int32()))


def encode(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """array<int>: the ids of each text without special tokens. Empty and null texts have the empty list.

    No shuffle and no limit on a text's length; strings that look like special tokens are ordinary text.
    """
    return _function(spark, path, "array<int>", _encode)(text)


def token_count(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """bigint: the number of ids of each text; 0 for empty and null texts."""
    return _function(spark, path, "bigint", lambda a, texts: pa.array([a.count(t.as_py()) for t in texts], pa.int64()))(text)


def decode(spark: SparkSession, ids: Column, path: str = VOCABULARY) -> Column:
    """string: the text of each list of ids; empty for none or null. Bytes that are no text become U+FFFD."""
    return _function(spark, path, "string", lambda a, lists: pa.array([a.decode(x.as_py()) for x in lists], pa.string()))(ids)
