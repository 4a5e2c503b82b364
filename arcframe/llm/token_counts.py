"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_bytes, map_arrow, texts_of
from ._pieces import BYTE_LEVEL, PieceTokens, load_tokenizer, pieces_of


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text: str = "text", id_col: str = "doc_id", limit: int = 512, batch_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, for byte-level files of the ``tokenizers`` library.

    Rows go to the encoder in batches of about ``batch_bytes``; texts are split where no token can cross, so long
    ones need no long encoder call, and a piece met before is not encoded again. Only lengths leave the function.
    Null and empty texts count 0; repeated rows each get their row; columns other than the two named are not read;
    an empty table gives an empty result.
    """

    def make():
        known = PieceTokens(load_tokenizer(tokenizer_path), len)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "text")
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            counts = np.zeros(len(texts), np.int64)
            for a, b in by_bytes(sizes, batch_bytes):
                split = [pieces_of(x, BYTE_LEVEL, known.special) for x in texts[a:b]]
                for i in range(0, len(split[0]) if b - a == 1 else 1, 1 << 18):  # a huge text alone: part by part
                    part = [split[0][i : i + (1 << 18)]] if b - a == 1 else split
                    known.learn([p for pieces in part for p in pieces])
                    counts[a:b] += [sum(map(known.__getitem__, pieces)) for pieces in part]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), make, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
