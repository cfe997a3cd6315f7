"""Token counts with a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Ranks of a public byte-level BPE; another file of the same form may be named instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern never joins what stands before a line break with the break and a sign right after it, so counts of
#: the parts add up to the count of the text.
_PART = re.compile(r"(?=\n\S)")
#: Parts whose counts a task remembers; they are forgotten together when there are more.
REMEMBER = 200_000


def _encoding(path: str):
    import tiktoken

    with Path(path).open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokens of each row's whole text: the columns ``keep`` and tokens (bigint); null and empty texts have 0.

    ``tokenizer`` is a file of byte-level BPE ranks that every executor can read. Texts are counted in parts that
    no token crosses, and a task counts a part that it has seen before only once (revisions of a page share most
    of their lines). One row comes out for each row that goes in; the texts themselves go no further.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        known: dict[str, int] = {}
        for batch in batches:
            totals = []
            for value in batch.column(0):
                total = 0
                for part in _PART.split(value.as_py() or ""):
                    n = known.get(part)
                    if n is None:
                        n = known[part] = len(encode(part))
                    total += n
                totals.append(total)
                if len(known) > REMEMBER:
                    known.clear()
            yield pa.record_batch([*batch.columns[1:], pa.array(totals, pa.int64())], names=[*keep, "tokens"])

    rows = documents.select(F.col(text).alias("_text"), *keep)
    return rows.mapInArrow(count, StructType([*rows.schema.fields[1:], StructField("tokens", LongType())]))
