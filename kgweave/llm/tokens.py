"""Token counts by scanning flat token files for separators.

A token file is a run of token numbers, documents one behind the other, each followed by the
end-of-document number. It has no index of documents: it is stored in blocks of a fixed number of tokens
that begin and end anywhere. Every block is searched on its own with one vectorised comparison. What a
block cannot know is how much of its first document lies in earlier blocks, so that is a prefix scan over
the blocks of a file: the place of the last separator before each block. The scan runs in two steps, over
groups of blocks and inside each group, so the longest file is no more than a group to one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
BLOCK = 1 << 16
GROUP = 1 << 12  # blocks that are scanned together
TEXTS = 64  # documents that are tokenised before their blocks are cut


def encoder(vocabulary: bytes):
    """A byte-level BPE from lines of base64 token and rank."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_files(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, block: int = BLOCK) -> DataFrame:
    """``file, block, tokens, ids``: one flat file per input partition, cut into blocks.

    ``tokens`` are little-endian 16-bit numbers (32-bit if ``end`` does not fit). ``ids`` are those of the
    documents whose separators lie in the block, only to name results; the scan does not look at them.
    Null and empty texts have no tokens but a separator. Every row counts, repeated ones and null ids too;
    other columns are not read; an empty table gives no files. The vocabulary is read on the driver.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = _kind(end)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks.value).encode_ordinary
        file, number = TaskContext.get().partitionId(), 0
        rest, ids = np.empty(0, kind), []  # tokens not yet in a block, and the ids of the separators in them
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                texts, own = batch["text"].iloc[at:at + TEXTS], batch["doc_id"].iloc[at:at + TEXTS]
                rest = np.concatenate([rest, *[np.array(encode(t or "") + [end], kind) for t in texts]])
                ids += [None if i is None else int(i) for i in own]
                out = []
                while len(rest) >= block:
                    head, rest = rest[:block], rest[block:]
                    n = int((head == end).sum())
                    out.append((file, number, head.tobytes(), ids[:n]))
                    number, ids = number + 1, ids[n:]
                if out:
                    yield pd.DataFrame(out, columns=["file", "block", "tokens", "ids"])
        if len(rest):
            yield pd.DataFrame([(file, number, rest.tobytes(), ids)], columns=["file", "block", "tokens", "ids"])

    # as text, since a column of numbers with nulls would reach pandas as floating point
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(write, "file int, block long, tokens binary, ids array<long>")


def _kind(end: int) -> np.dtype:
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def _searched(end: int):
    kind = _kind(end)

    @F.pandas_udf("size long, spots array<int>")
    def search(blocks: pd.Series) -> pd.DataFrame:
        tokens = [np.frombuffer(b or b"", kind) for b in blocks]
        return pd.DataFrame({"size": [len(t) for t in tokens],
                             "spots": [np.flatnonzero(t == end).astype(np.int32) for t in tokens]})
    return search


def scan(files: DataFrame, end: int = END, group: int = GROUP, keep=()) -> DataFrame:
    """One row per document of the token files: ``file, ordinal, n_tokens, closed`` and the entries of ``keep``.

    ``files`` has ``file, block, tokens``; blocks of a file are numbered in order, from any number and with
    any gaps, and may have any size, also none. ``ordinal`` counts a file's documents from 0. Tokens behind
    the last separator of a file are a document with ``closed`` false; a file without tokens has no
    documents. ``keep`` names array columns with one entry per separator of the block.
    """
    found = files.select("file", "block", _searched(end)(F.col("tokens")).alias("s"), *keep).select(
        "file", "block", "s.size", "s.spots", F.floor(F.col("block") / group).alias("group"), *keep)
    n = F.size("spots")
    last = F.when(n > 0, F.element_at("spots", -1) + 1)  # where in the block its last separator ends
    inner = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = found.withColumn("before", F.coalesce(F.sum("size").over(inner), zero))
    placed = placed.withColumn("ended", F.max(F.col("before") + last).over(inner)).withColumn(
        "documents", F.coalesce(F.sum(n).over(inner), zero))
    groups = (
        placed.groupBy("file", "group")
        .agg(F.sum("size").alias("g_size"), F.sum(n).alias("g_documents"), F.max(F.col("before") + last).alias("g_ended"))
        .withColumn("g_before", F.coalesce(F.sum("g_size").over(outer), zero))
        .withColumn("g_first", F.coalesce(F.sum("g_documents").over(outer), zero))
        .withColumn("g_last", F.coalesce(F.max(F.col("g_before") + F.col("g_ended")).over(outer), zero))
        .select("file", "group", "g_before", "g_first", "g_last")
    )
    start = F.col("g_before") + F.col("before")
    carried = start - F.coalesce(F.col("g_before") + F.col("ended"), F.col("g_last"))
    known = placed.join(groups, ["file", "group"]).select(
        "file", "block", "size", "spots", (F.col("g_first") + F.col("documents")).alias("first"), carried.alias("carried"),
        start.alias("start"), *keep)
    at = lambda i: F.col("spots")[i]
    length = lambda i: F.when(i == 0, at(i) + F.col("carried")).otherwise(
        at(i) - at(F.greatest(i - 1, F.lit(0))) - 1)
    entry = lambda s, i: F.struct(
        (F.col("first") + i).alias("ordinal"), length(i).cast("long").alias("n_tokens"), F.lit(True).alias("closed"),
        *[F.col(k)[i].alias(k) for k in keep])
    closed = known.select("file", F.explode(F.transform("spots", entry)).alias("d")).select("file", "d.*")
    ends = known.groupBy("file").agg(
        F.max_by(F.struct(
            (F.col("first") + F.size("spots")).alias("ordinal"),
            F.when(F.size("spots") > 0, F.col("size") - F.element_at("spots", -1) - 1)
            .otherwise(F.col("carried") + F.col("size")).cast("long").alias("n_tokens")), "block").alias("d"))
    types = dict(known.dtypes)
    open_ = ends.where(F.col("d.n_tokens") > 0).select(
        "file", "d.*", F.lit(False).alias("closed"),
        *[F.lit(None).cast(types[k].removeprefix("array<").removesuffix(">")).alias(k) for k in keep])
    return closed.unionByName(open_)

