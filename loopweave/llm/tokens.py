"""Token counts (operator 7): whole-token shortcut over byte-level BPE."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, proven

#: Rows of an Arrow batch that are Python objects at the same time.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept_by_worker(kind: str, key: str, make):
    """What ``make`` returned when this Python worker first asked for ``key``: workers serve many tasks, and an encoder's memory
    need not be made anew for each. A worker keeps one object of a kind, that of the latest key."""
    store = sys.modules.setdefault("_loopweave_worker", types.ModuleType("_loopweave_worker")).__dict__
    if store.get(kind, (None,))[0] != key:
        store.pop(kind, None)
        store[kind] = (key, make())
    return store[kind][1]


def content_key(content: str | bytes) -> str:
    return hashlib.sha256(content.encode() if isinstance(content, str) else content).hexdigest()


def tokenizer_file(path: str) -> tuple[str, object]:
    """Kind and content of a vocabulary file, read once on the driver; tasks get the content, not the path."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return "json", f.read()
    if path.endswith(".model"):
        with open(path, "rb") as f:
            return "model", f.read()
    raise ValueError(f"neither .json nor .model: {path}")


def _counter(kind: str, content, whole: dict[str, int] | None):
    if kind == "json":
        return Encoder(content, len, sum, whole)
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
    return lambda text: len(pieces.encode(text, num_threads=1))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``; other columns are left out, so none can clash.

    ``n_bytes`` is the text's length in UTF-8 and ``n_tokens`` what the tokenizer's library returns without begin, end or
    padding; strings of special tokens inside a text are handled as the library does by default. A null text counts as
    empty: 0 and 0. Repeated rows stay, each with its own result; an empty table gives an empty one. No shuffle: the
    texts never leave their task, and the vocabulary (a bounded file) and its proven strings are broadcast.
    """
    kind, content = tokenizer_file(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((kind, content, proven(content) if kind == "json" else None))
    name = content_key(content)

    def run(batches):
        count = kept_by_worker("counter", name, lambda: _counter(*shared.value))
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            sizes = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
