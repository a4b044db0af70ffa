"""Operator 5: packing by power-of-two decomposition.

Method. A document's token ids (with the end id) are cut into pieces of `max_len` and
then into the binary digits of what is left, the largest first. A piece is a training
sequence of its own: its length is a power of two, so no sequence crosses documents
and none is padded. Sequences of equal length form a bucket (`length`), from which
`write_buckets` writes one folder per length for batches of equal shape.

Scale. One pass over the documents, without a shuffle: ids, pieces and digests of a
document depend on that document only, and sequence ids come from the position in the
input split, which a retried task reads in the same order.

Edge cases. A null text counts as empty and gives one piece with the end id alone.
Repeated rows and repeated or null doc_ids give pieces of their own. Very long texts
are encoded in one task, whole. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices, table

MAX_LEN = 2048
END_ID = 1
#: Runs of bytes of one kind beyond this length go to the reference tokenizer alone.
LONG_RUN = 20_000
#: Texts whose pieces are held at a time.
ROWS = 128


@lru_cache(maxsize=2)
def _encoders(vocabulary: str, ranks: str):
    """The tokenizer itself, and a faster encoder of the same ranks and pattern for plain texts."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return slow, fast, special


def _has_long_run(text: str) -> bool:
    """Whether a run of white space or of other characters is so long that the fast encoder may fail."""
    if len(text) <= LONG_RUN:
        return False
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cuts = np.flatnonzero(space[1:] != space[:-1])
    return int(np.diff(np.r_[-1, cuts, len(raw) - 1]).max()) > LONG_RUN


def encode(text: str, vocabulary: str, ranks: str) -> list[int]:
    """Token ids of a text, as the tokenizer in `vocabulary` gives them without special tokens added."""
    slow, fast, special = _encoders(vocabulary, ranks)
    if any(s in text for s in special) or _has_long_run(text):
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cuts(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of n ids: as many of max_len as fit, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(vocabulary: str, ranks: str, max_len: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                raw = np.asarray([*encode(text.as_py() or "", vocabulary, ranks), END_ID], dtype="<u4")
                body, at = memoryview(raw).cast("B"), 0
                for n in cuts(len(raw), max_len):
                    owner.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(body[4 * at : 4 * (at + n)]))
                    at += n
                    if with_ids:
                        ids.append(raw[at - n : at])
                    total.append(len(raw))
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                at = np.r_[0, np.cumsum(length)].astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str, max_len: int = MAX_LEN, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    max_len must be a power of two. length is the bucket.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    out = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, ranks, max_len, with_ids), schema)
    head = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return out.select(*head, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def write_buckets(packed: DataFrame, path: str, mode: str = "error") -> None:
    """Writes the sequences with their ids, one folder per length, so that a batch holds equal lengths."""
    packed.select("sequence_id", "doc_id", "start", "length", "ids").write.mode(mode).partitionBy("length").parquet(path)


def pack_into_buckets(docs: DataFrame, vocabulary: str, ranks: str, max_len: int = MAX_LEN) -> DataFrame:
    """pack(), written with one folder per length into the shared folder of the session and read from there."""
    path = Workspace(docs.sparkSession, "packing").path("buckets")
    packed = pack(docs, vocabulary, ranks, max_len)
    packed.write.partitionBy("length").parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path).select(*packed.columns)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *default_vocabulary(), with_ids=False)


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
