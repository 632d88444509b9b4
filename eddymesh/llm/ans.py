"""Token ids in files, coded by a static range asymmetric numeral system (rANS).

A file set is a Parquet table of blocks. A block holds whole documents in ascending doc_id order, about
BLOCK_TOKENS ids together or one longer document, and can be decoded on its own. All blocks share one frequency
table, scaled to 2**SCALE_BITS. Inside a block, id number i belongs to lane i mod lanes; lanes are 64-bit coders
which renormalise by 32-bit words into one interleaved stream, so that a step of all lanes is one numpy operation.
Every CHECKPOINT_STEPS steps the lanes' states and the place in the stream are kept, so that decoding can also
begin inside a block; a checksum covers the block and another its ids.

Block layout (little-endian): magic "ERB1", then u32 scale bits, lanes, ids, documents, words, checkpoints, crc32 of
the frequency table; document ids (i64) with a validity byte each; ids per document (u32); checkpoints (u32 step,
u32 words read before it, u64 state per lane), the first at step 0; words (u32); u32 crc32 of the ids; u32 crc32 of
everything before.

Null and empty texts hold just the end id. Rows with the same doc_id stay rows of their own, in the order of a hash of
their texts, by which they are also dealt out, so that one doc_id is no one task's work; null doc_ids come first. An empty table gives no blocks. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import batch, column, scratch, stored, tidied
from eddymesh.llm.tokens import encoder

SCALE_BITS = 20
BLOCK_TOKENS = 1 << 17
LANES = 1024
CHECKPOINT_STEPS = 64
LEAST = np.uint64(1 << 31)
HEAD = struct.Struct("<4s7I")
LOW, WORD_BITS = np.uint64(0xFFFFFFFF), np.uint64(32)


class Table(NamedTuple):
    """Scaled frequency and start of each id, and the id at each of the 2**bits slots."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray
    crc: int


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to sum to 2**bits, at least 1 wherever the count is above 0."""
    total, room = int(counts.sum()), 1 << bits
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    seen = counts > 0
    if int(seen.sum()) > room:
        raise ValueError("more distinct ids than the scale has slots")
    freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * room / total).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - room
    at = 0
    while over > 0:  # takes from the largest, which lose least by it
        cut = min(over, int(freq[order[at]]) // 2)
        freq[order[at]] -= cut
        over, at = over - cut, (at + 1) % int(seen.sum())
    freq[order[0]] -= min(over, 0)
    return freq


def table_of(freq: np.ndarray, bits: int = SCALE_BITS) -> Table:
    start = np.cumsum(freq) - freq
    crc = zlib.crc32(freq.astype("<u4").tobytes())
    return Table(bits, freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq), crc)


def encode_ids(ids: np.ndarray, table: Table, lanes: int) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray]:
    """Checkpoints (step, words before it, states) and the words of one block."""
    bits, steps = np.uint64(table.bits), -(-len(ids) // lanes)
    state, out, sent, marks = np.full(lanes, LEAST), [], 0, []
    full = np.uint64(63 - table.bits)
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes : (step + 1) * lanes]
        f, x = table.freq[symbols], state[: len(symbols)]
        if (high := x >= f << full).any():
            out.append((x[high] & LOW).astype("<u4"))
            sent += len(out[-1])
            x = np.where(high, x >> WORD_BITS, x)
        q = x // f
        state[: len(symbols)] = (q << bits) + (x - q * f) + table.start[symbols]
        if step % CHECKPOINT_STEPS == 0:
            marks.append((step, sent, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    return [(step, sent - s, x) for step, s, x in marks[::-1]], words


def decode_ids(n: int, lanes: int, state: np.ndarray, words: np.ndarray, table: Table, step: int = 0, read: int = 0) -> np.ndarray:
    """The ids from a checkpoint to the end of the block."""
    bits, mask, at = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), read
    out, state, words = np.empty(n - step * lanes, np.uint32), state.copy(), words.astype(np.uint64)
    for first in range(0, len(out), lanes):
        part = out[first : first + lanes]
        x = state[: len(part)]
        slot = x & mask
        part[:] = symbols = table.slots[slot]
        x = table.freq[symbols] * (x >> bits) + slot - table.start[symbols]
        if (low := x < LEAST).any():
            k = int(low.sum())
            x[low] = (x[low] << WORD_BITS) | words[at : at + k]
            at += k
        state[: len(part)] = x
    return out


def pack_block(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, table: Table) -> bytes:
    lanes = max(1, min(LANES, len(ids) // 128))
    marks, words = encode_ids(ids, table, lanes)
    parts = [HEAD.pack(b"ERB1", table.bits, lanes, len(ids), len(doc_ids), len(words), len(marks), table.crc)]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids), lengths.astype("<u4").tobytes()]
    parts += [struct.pack("<2I", step, read) + x.astype("<u8").tobytes() for step, read, x in marks]
    parts += [words.tobytes(), struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))]
    whole = b"".join(parts)
    return whole + struct.pack("<I", zlib.crc32(whole))


class Block:
    """A block as read; ids(k) decodes from checkpoint k on."""

    def __init__(self, data: bytes, table: Table):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the block's checksum is wrong")
        magic, bits, self.lanes, self.n, docs, words, marks, crc = HEAD.unpack_from(data)
        if magic != b"ERB1" or (bits, crc) != (table.bits, table.crc):
            raise ValueError("the block needs another frequency table")
        self.table, at = table, HEAD.size
        known = data[at + 8 * docs : at + 9 * docs]
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(data, "<i8", docs, at).tolist(), known)]
        self.lengths = np.frombuffer(data, "<u4", docs, at := at + 9 * docs).astype(np.int64)
        at, self.marks = at + 4 * docs, []
        for _ in range(marks):
            step, read = struct.unpack_from("<2I", data, at)
            self.marks.append((step, read, np.frombuffer(data, "<u8", self.lanes, at + 8).astype(np.uint64)))
            at += 8 + 8 * self.lanes
        self.words = np.frombuffer(data, "<u4", words, at)
        self.crc = struct.unpack_from("<I", data, at + 4 * words)[0]

    def ids(self, mark: int = 0) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint32)
        step, read, state = self.marks[mark]
        found = decode_ids(self.n, self.lanes, state, self.words, self.table, step, read)
        if not mark and zlib.crc32(found.astype("<u4").tobytes()) != self.crc:
            raise ValueError("the ids' checksum is wrong")
        return found


RAW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])
RAW_DDL = "part int, block int, local_start long, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"


def raw_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, vocabulary: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of ids not yet coded, as the sorted partition has the documents; then a row with how often each id came."""
    encode, part, block, start, size = encoder(path).encode, TaskContext.get().partitionId(), 0, 0, 0
    seen = np.zeros(vocabulary, np.int64)
    kind = "<u4" if wide else "<u2"
    held: list[bytes] = []
    docs: list[int | None] = []
    lengths: list[int] = []

    def flushed() -> pa.RecordBatch:
        nonlocal block, start, size
        made = batch(RAW, part=[part], block=[block], local_start=[start], n_tokens=[size], doc_ids=[list(docs)], lengths=[list(lengths)], ids=[b"".join(held)], counts=pa.nulls(1))
        block, start, size = block + 1, start + size, 0
        for x in (held, docs, lengths):
            x.clear()
        return made

    end = np.array([end_id], kind).tobytes()
    for b in batches:
        names, at = column(b, "doc_id").to_pylist(), 0
        for ids, counts in encode(column(b, "text")):
            seen += np.bincount(ids, minlength=vocabulary)
            seen[end_id] += len(counts)
            data, past = ids.astype(kind).tobytes(), np.cumsum(counts) * int(kind[-1])
            for k, stop in enumerate(past.tolist()):
                held.append(data[past[k - 1] if k else 0 : stop] + end)
                docs.append(names[at + k])
                lengths.append(int(counts[k]) + 1)
                size += lengths[-1]
                if size >= BLOCK_TOKENS:
                    yield flushed()
            at += len(counts)
    if docs:
        yield flushed()
    if seen.any():
        none = pa.nulls(1)
        yield batch(RAW, part=[part], block=none, local_start=none, n_tokens=none, doc_ids=none, lengths=none, ids=none, counts=[seen.astype("<i8").tobytes()])


COUNTS = pa.schema([("id", pa.int32()), ("n", pa.int64())])


def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for counts in column(b, "counts"):
            held = np.frombuffer(counts.as_buffer(), "<i8")
            seen = np.flatnonzero(held)
            yield batch(COUNTS, id=seen, n=held[seen])


CODED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("local_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
CODED_DDL = "part int, block int, local_start long, n_docs long, n_tokens long, data binary"


def coded(batches: Iterator[pa.RecordBatch], freq: np.ndarray, wide: bool) -> Iterator[pa.RecordBatch]:
    table = table_of(freq)
    for b in batches:
        for row in b.to_pylist():
            ids = np.frombuffer(row["ids"], "<u4" if wide else "<u2")
            data = pack_block(ids, row["doc_ids"], np.array(row["lengths"], np.int64), table)
            yield batch(CODED, part=[row["part"]], block=[row["block"]], local_start=[row["local_start"]], n_docs=[len(row["doc_ids"])], n_tokens=[row["n_tokens"]], data=[data])


def write_tokens(docs: DataFrame, path: str, end_id: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Encodes documents(doc_id, text) and writes the blocks; they and the shared frequency table.

    The table has an entry for each id of the vocabulary, which doesn't grow with the input. It is the same for all
    blocks, so it is counted before any block is coded: ids wait in a written table of two bytes each.
    """
    from eddymesh.llm.tokens import load

    vocabulary = max(load(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    wide = vocabulary > 1 << 16
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("hash")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    with scratch() as kept:
        raw = stored(ordered.mapInArrow(lambda bs: tidied(raw_blocks(bs, path, end_id, vocabulary, wide), True), RAW_DDL), "token-ids", "none")
        found = raw.select("counts").where("counts is not null").mapInArrow(lambda bs: tidied(id_counts(bs)), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(vocabulary, np.int64)
        for row in found:
            counts[row["id"]] = row["n"]
        freq = scaled(counts)
        shared = docs.sparkSession.sparkContext.broadcast(freq)
        kept.append(blocks := stored(raw.where("ids is not null").drop("counts").mapInArrow(lambda bs: tidied(coded(bs, shared.value, wide)), CODED_DDL), "token-blocks", "none"))
    return blocks, freq


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def decoded(batches: Iterator[pa.RecordBatch], freq: np.ndarray, starts: dict[int, int], digest: bool) -> Iterator[pa.RecordBatch]:
    table = table_of(freq)
    schema = READ.set(3, pa.field("ids_crc32", pa.int64())) if digest else READ
    for b in batches:
        for row in b.to_pylist():
            block = Block(row["data"], table)
            data, past = block.ids().astype("<u4").tobytes(), np.cumsum(block.lengths)
            parts = [data[4 * (p - n) : 4 * p] for p, n in zip(past.tolist(), block.lengths.tolist())]
            last = {"ids_crc32": [zlib.crc32(x) for x in parts]} if digest else {"ids": parts}
            yield batch(schema, doc_id=block.doc_ids, start=past - block.lengths + row["local_start"] + starts[row["part"]], n_tokens=block.lengths, **last)


def read_tokens(blocks: DataFrame, freq: np.ndarray, digest: bool = False) -> DataFrame:
    """Reads blocks back: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, 32 bits),
    or with digest their crc32 instead. Part totals are one number for each written partition."""
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part], total = total, total + n
    shared = blocks.sparkSession.sparkContext.broadcast((freq, starts))
    last = "ids_crc32 long" if digest else "ids binary"
    return blocks.mapInArrow(lambda bs: tidied(decoded(bs, *shared.value, digest)), f"doc_id long, start long, n_tokens long, {last}")
