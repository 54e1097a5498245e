"""Token counts of whole texts under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Vocabulary file; any tokenizer file of the ``tokenizers`` library will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core already
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    loaded.no_truncation()
    return loaded


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text, whole; null and empty texts have none."""
    tokenizer = _tokenizer(path)
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return [len(x.ids) for x in encode([t or "" for t in texts], add_special_tokens=False)]


def with_token_counts(df: DataFrame, text: str = "text", tokens: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """Replace column ``text`` by the number of its tokens, in column ``tokens``. No shuffle."""
    rest = [c for c in df.columns if c != text]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(count_tokens(batch.column(text).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [counts], [*rest, tokens])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text]
    return df.mapInArrow(work, ", ".join([*fields, f"`{tokens}` bigint"]))
