"""Training-order materialisation of token ids.

Texts are encoded with a given public vocabulary, cut into sequences of a fixed
length, and numbered.  A keyed Feistel network permutes the numbers; where the
next power of four is larger than their count, values beyond it walk the cycle
until they fall inside, so the permutation is exact.  The permuted number is the
sequence's slot in training order.  Shards hold a fixed number of slots and every
sequence takes the same bytes in its shard, so slot ``s`` is at byte
``(s % slots) * stride`` of shard ``s // slots``: a reader resumes anywhere.

Sequences are numbered in the order of id, text hash and place in the text: texts
are dealt by range, and a sequence's number is the count of those in earlier
ranges plus its place in its own.  So the training order follows from rows and
key, however the input is cut into files and tasks; rows that the order cannot
tell apart are equal, and any order of theirs gives the same shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.kernels import U, mix, text_blocks
from reportlake.llm.repeats import _cut, unpacked
from reportlake.llm.shared import bucket_count, discard, documents_of, named_id, release, scratch_path, write_table

#: Default vocabulary: byte-level BPE ranks; the id after the last ends a text.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such a vocabulary cuts text before merging. A fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a sequence; sequences of a shard; rounds of the permutation; bytes of tokens in a task.
LENGTH, SLOTS, ROUNDS, TASK_BYTES = 512, 2048, 6, 16 << 20
#: Bytes up to which a vocabulary's file is sent to the executors; MB of texts in a range.
VOCABULARY_BYTES, RANGE_MB = 64 << 20, 64

_PART = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("seq", pa.binary()), ("size", pa.binary()), ("tokens", pa.binary())])
PARTS = "part int, first long, n long, docs binary, seq binary, size binary, tokens binary"
SHARDS = "shard long, first_slot long, n long, stride long, docs array<long>, seq array<int>, size array<int>, payload binary"


def feistel(index: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of ``0 .. count - 1``."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(rounds, dtype=U) * U(0x9E3779B97F4A7C15) + U(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << U(half)) | right

    out = once(index.astype(U))
    walking = np.flatnonzero(out >= U(count))
    while len(walking):
        out[walking] = once(out[walking])
        walking = walking[out[walking] >= U(count)]
    return out.astype(np.int64)


def vocabulary_of(path: str) -> bytes:
    """A vocabulary's file, which only the driver has to reach."""
    with open(path, "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return data


def encoder(data: bytes):
    """``(encode(text) -> ids, end id)`` of a vocabulary's file; a text is cut and merged in one call of the library."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    end = max(ranks.values()) + 1
    kind = np.uint16 if end < 1 << 16 else np.uint32

    def encode(text: str) -> np.ndarray:
        return core.encode_to_numpy(text, disallowed_special=()).astype(kind)

    return encode, end


def _encoded(vocabulary, length: int):
    """One row per block: its sequences one after the other, numbered within the task. ``vocabulary`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary.value)
        kind = np.uint16 if end < 1 << 16 else np.uint32
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for i, j, buf, offs in text_blocks(batch):
                data = buf.tobytes()
                ids = [np.append(encode(data[a:b].decode()), kind(end)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                per = -(-sizes // length)
                seq = np.concatenate([np.arange(n) for n in per]).astype(np.int32)
                of = np.repeat(np.arange(j - i), per)
                size = np.minimum(sizes[of] - seq * length, length).astype(np.int32)
                one = lambda x: pa.array([x.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([made], pa.int64()), pa.array([len(seq)], pa.int64()), one(doc[i + of]), one(seq), one(size), one(np.concatenate(ids))],
                    schema=_PART,
                )
                made += len(seq)

    return run


_SENT = pa.schema([("target", pa.int32()), ("slots", pa.binary()), ("docs", pa.binary()), ("seq", pa.binary()), ("size", pa.binary()), ("raw", pa.int64()), ("tokens", pa.binary())])
SENT = "target int, slots binary, docs binary, seq binary, size binary, raw long, tokens binary"


def _sent(base: dict[int, int], count: int, key: int, slots: int, shards_each: int, width: int):
    """Sequences to the range of shards that their slot is in, one row per range and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if width == 2 else np.uint32
        for batch in batches:
            for b in range(batch.num_rows):
                get = lambda name, k, b=b, batch=batch: np.frombuffer(batch.column(name)[b].as_buffer(), dtype=k)
                n = batch.column("n")[b].as_py()
                slot = feistel(base[batch.column("part")[b].as_py()] + batch.column("first")[b].as_py() + np.arange(n), count, key)
                size = get("size", np.int32).astype(np.int64)
                tokens, ends = get("tokens", kind), np.cumsum(size)
                target = (slot // slots // shards_each).astype(np.int32)
                order = np.lexsort((slot, target))
                new = np.flatnonzero(np.concatenate([[True], target[order][1:] != target[order][:-1]]))
                cuts = np.append(new, n)
                raw, packed = [], []
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    own = b"".join([tokens[ends[s] - size[s] : ends[s]].tobytes() for s in order[lo:hi]])
                    raw.append(len(own))
                    packed.append(pa.compress(own, codec="zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(target[order][new], pa.int32()),
                        _cut(slot[order], cuts),
                        _cut(get("docs", np.int64)[order], cuts),
                        _cut(get("seq", np.int32)[order], cuts),
                        _cut(size[order].astype(np.int32), cuts),
                        pa.array(raw, pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    schema=_SENT,
                )

    return run


def _shards(slots: int, length: int, width: int, pad: int):
    """The shards of a range, in order."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.uint16 if width == 2 else np.uint32
        slot, docs = unpacked(table.column("slots"), np.int64), unpacked(table.column("docs"), np.int64)
        seq, size = unpacked(table.column("seq"), np.int32), unpacked(table.column("size"), np.int32).astype(np.int64)
        tokens = np.concatenate(
            [
                np.frombuffer(pa.decompress(t.as_buffer(), decompressed_size=r, codec="zstd"), dtype=kind)
                for t, r in zip(table.column("tokens"), table.column("raw").to_pylist(), strict=True)
            ]
        )
        ends = np.cumsum(size)
        order = np.argsort(slot)
        shard = slot[order] // slots
        new = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        out = []
        for lo, hi in zip(new, np.append(new[1:], len(order)), strict=True):
            rows = order[lo:hi]
            payload = np.full((hi - lo, length), pad, dtype=kind)
            for i, s in enumerate(rows):
                payload[i, : size[s]] = tokens[ends[s] - size[s] : ends[s]]
            out.append((int(shard[lo]), int(slot[rows[0]]), int(hi - lo), length * width, docs[rows], seq[rows], size[rows], payload.tobytes()))
        names = ["shard", "first_slot", "n", "stride", "docs", "seq", "size", "payload"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def write_shards(
    documents: DataFrame,
    path: str,
    *,
    key: int = 7,
    length: int = LENGTH,
    slots: int = SLOTS,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all texts as shards of token sequences in training order under ``path``; returns the shards.

    A row per shard: ``payload`` holds its sequences, ``stride`` bytes each, in
    slot order, the short end of a text's last sequence filled with the id that
    ends a text.  Every text ends with that id, so null and empty texts are one
    sequence of one token.  Repeated rows are repeated sequences, each with a
    slot of its own; null ids stay null; an empty table gives no shard; extra
    columns are ignored.  The same rows and key give the same shards, whatever the
    partitioning.  ``vocabulary`` is a path on the driver.
    """
    spark = documents.sparkSession
    data = vocabulary_of(vocabulary)
    shipped = spark.sparkContext.broadcast(data)
    # The last column splits a group of equal rows, however large, over ranges.
    order = ["doc", "tag", "at"]
    docs = documents_of(documents, id_col, text_col).withColumn("at", F.monotonically_increasing_id())
    ranged = docs.repartitionByRange(bucket_count(documents, RANGE_MB), *order).sortWithinPartitions(*order)
    held = scratch_path(spark, "encoded")
    write_table(ranged.select("doc", "text").mapInArrow(_encoded(shipped, length), PARTS), held)
    del docs, ranged
    release(spark)
    shipped.unpersist()
    parts = spark.read.schema(PARTS).parquet(held)
    counts = parts.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row per task that wrote
    base, count = {}, 0
    for r in sorted(counts, key=lambda r: r.part):
        base[r.part] = count
        count += r.n
    end = max(int(line.split()[1]) for line in data.splitlines()) + 1
    width = 2 if end < 1 << 16 else 4
    shards = -(-count // slots)
    each = max(1, min(TASK_BYTES // (slots * length * width), -(-shards // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    sent = parts.mapInArrow(_sent(base, max(count, 1), key, slots, each, width), SENT)
    made = sent.groupBy("target").applyInArrow(_shards(slots, length, width, end), SHARDS)
    write_table(made, path)
    release(spark)
    discard(spark, held)
    return spark.read.schema(SHARDS).parquet(path)


def read_from(spark, path: str, slot: int = 0, slots: int = SLOTS) -> DataFrame:
    """Sequences in training order from ``slot`` on: ``slot, doc_id, seq, tokens binary``."""
    rows = spark.read.schema(SHARDS).parquet(path).where(F.col("shard") >= slot // slots)
    rows = rows.select("first_slot", "stride", "payload", F.posexplode(F.arrays_zip("docs", "seq", "size")).alias("at", "one"))
    return (
        rows.withColumn("slot", F.col("first_slot") + F.col("at"))
        .where(F.col("slot") >= slot)
        .select("slot", named_id("one.docs").alias("doc_id"), F.col("one.seq").alias("seq"), F.col("one.size").alias("size"), F.expr("substring(payload, cast(at * stride + 1 as int), cast(stride as int))").alias("tokens"))
        .orderBy("slot")
    )


def index_of(shards: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, shard, byte_offset, doc_id, seq, n_tokens``: where each sequence is."""
    rows = shards.select("shard", "first_slot", "stride", F.posexplode(F.arrays_zip("docs", "seq", "size")).alias("at", "one"))
    return rows.select(
        (F.col("first_slot") + F.col("at")).alias("slot"),
        "shard",
        (F.col("at") * F.col("stride")).alias("byte_offset"),
        named_id("one.docs").alias("doc_id"),
        F.col("one.seq").cast("long").alias("seq"),
        F.col("one.size").cast("long").alias("n_tokens"),
    )
