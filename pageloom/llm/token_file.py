"""Token-id files: static range asymmetric numeral system (rANS) over interleaved lanes.

A file is a folder of Parquet rows. A row is a segment: one frequency table and up to SEGMENT blocks
that share it. A block holds whole documents, in order, as one byte string:

    magic "RANS", version u8, scale bits u8, lanes u16, tokens u32, steps between checkpoints u32,
    number of checkpoints u32, words u32, crc32 u32 of everything behind the header,
    checkpoints (offset into the words u32, state of each lane u64), words (u32)

all little-endian. Token i of a block is in lane i % lanes at step i // lanes. Every lane has a 64-bit
state and takes 32-bit words from one common stream. A checkpoint is what a decoder needs to begin at
its step, so the stretches between checkpoints can be decoded in any order and in parallel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pageloom.llm.chunks import library_chunks
from pageloom.llm.text import SLICE, text_bytes

MAGIC, VERSION = b"RANS", 1
_HEAD = struct.Struct("<4sBBHIIIII")
SCALE_BITS, LANES, CHECK_STEPS = 20, 1024, 64
BLOCK_TOKENS, SEGMENT = 1 << 18, 12
END_ID = 2
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and a frequency of at least 1 for each; they sum to 2**SCALE_BITS."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.float64)
    total = 1 << SCALE_BITS
    if len(symbols) > total // 2:
        raise ValueError("more symbols than the scale allows")
    freqs = np.maximum(1, np.floor(counts * ((total - len(symbols)) / counts.sum()))).astype(np.int64)
    freqs[np.argmax(freqs)] += total - freqs.sum()
    return symbols, freqs


def _steps(n: int, lanes: int) -> range:
    return range(-(-n // lanes))


def encode_block(ids: np.ndarray, symbols: np.ndarray, freqs: np.ndarray, lanes: int = LANES) -> bytes:
    n, bits = len(ids), np.uint64(SCALE_BITS)
    lanes = max(1, min(lanes, n))
    freq = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, dtype=np.uint64)
    start = np.zeros_like(freq)
    freq[symbols], start[symbols] = freqs, np.cumsum(freqs) - freqs
    state = np.full(lanes, _LOW, dtype=np.uint64)
    words, checks, put = [], [], 0
    for step in reversed(_steps(n, lanes)):
        now = ids[step * lanes:(step + 1) * lanes]
        x, f = state[:len(now)], freq[now]
        full = x >= f << np.uint64(63 - SCALE_BITS)
        words.append(x[full].astype("<u4"))
        put += len(words[-1])
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[:len(now)] = (q << bits) + (x - q * f) + start[now]
        if step % CHECK_STEPS == 0:
            checks.append((put, state.astype("<u8").tobytes()))
    body = b"".join(struct.pack("<I", put - at) + states for at, states in reversed(checks))
    body += b"".join(w.tobytes() for w in reversed(words))
    return _HEAD.pack(MAGIC, VERSION, SCALE_BITS, lanes, n, CHECK_STEPS, len(checks), put, zlib.crc32(body)) + body


def decode_block(block: bytes, symbols: np.ndarray, freqs: np.ndarray, stretch: int | None = None,
                 lookup: np.ndarray | None = None) -> np.ndarray:
    """The ids of a block, or those from its checkpoint ``stretch`` to the next; damaged blocks raise ValueError."""
    if len(block) < _HEAD.size:
        raise ValueError("not a whole block")
    magic, version, scale, lanes, n, every, n_checks, n_words, crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size:]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != crc:
        raise ValueError("damaged block, or none of this format")
    size = 4 + 8 * lanes
    words = np.frombuffer(body, dtype="<u4", offset=n_checks * size, count=n_words)
    lookup = slots(freqs) if lookup is None else lookup
    f64, start = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
    mask, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    out = np.empty(n, dtype=np.int64)
    first, last = 0, n
    for check in range(n_checks) if stretch is None else [stretch]:
        at = struct.unpack_from("<I", body, check * size)[0]
        state = np.frombuffer(body, dtype="<u8", offset=check * size + 4, count=lanes).copy()
        first = check * every * lanes if stretch is not None else 0
        last = min(n, (check + 1) * every * lanes)
        for begin in range(check * every * lanes, last, lanes):
            count = min(lanes, n - begin)
            x = state[:count]
            slot = x & mask
            which = lookup[slot]
            out[begin:begin + count] = which
            x = f64[which] * (x >> bits) + slot - start[which]
            empty = x < _LOW
            need = int(empty.sum())
            x[empty] = (x[empty] << _WORD) | words[at:at + need]
            at += need
            state[:count] = x
    return symbols[out[first:last if stretch is not None else n]]


def slots(freqs: np.ndarray) -> np.ndarray:
    """The symbol number of each slot."""
    return np.repeat(np.arange(len(freqs)), freqs)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode the whole texts of ``docs`` (doc_id, text), append ``end_id`` to each, write the file ``path``.

    Documents stand in ascending doc_id (null first), rows with the same id in the order of a hash of
    their text. Null and empty texts give the end id alone; other columns are not read; an empty table
    gives a file without rows. Texts move once, by range of (doc_id, hash), so neither a hot source nor
    a repeated id gathers in one task, and are tokenized once, by the tokenizers library. A task holds
    one segment at a time (about SEGMENT * BLOCK_TOKENS ids, or one document if that is longer).
    """
    schema = ("part int, segment int, symbols binary, freqs binary, "
              "blocks array<struct<block: int, doc_ids: array<bigint>, sizes: array<bigint>, data: binary>>")

    def run(batches):
        chunks, number = library_chunks(tokenizer), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        blocks, docs_now, parts, held = [], [], [], 0

        def closed(part):
            ids = [np.frombuffer(b"".join(p), dtype="<u4").astype(np.int64) for _, p in blocks]
            symbols, freqs = frequencies(np.concatenate(ids))
            rows = [{"block": i, "doc_ids": [d for d, _ in told], "sizes": [s for _, s in told],
                     "data": encode_block(x, symbols, freqs)} for i, ((told, _), x) in enumerate(zip(blocks, ids))]
            table = [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                     pa.array([zlib.compress(symbols.astype("<u4").tobytes())]),
                     pa.array([zlib.compress(freqs.astype("<u4").tobytes())]),
                     pa.array([rows], pa.list_(pa.struct([
                         ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                         ("data", pa.binary())])))]
            return pa.RecordBatch.from_arrays(table, names=["part", "segment", "symbols", "freqs", "blocks"])

        part = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                part = rows.column(0)[0].as_py()
                for doc, ids in zip(rows.column(1).to_pylist(), chunks.encode(text_bytes(rows.column(2)))):
                    docs_now.append((doc, len(ids) // 4 + 1))
                    parts += [ids, end]
                    held += len(ids) // 4 + 1
                    if held >= BLOCK_TOKENS:
                        blocks.append((docs_now, parts))
                        docs_now, parts, held = [], [], 0
                    if len(blocks) == SEGMENT or blocks and sum(s for b in blocks for _, s in b[0]) > SEGMENT * BLOCK_TOKENS:
                        yield closed(part)
                        blocks, number = [], number + 1
        if docs_now:
            blocks.append((docs_now, parts))
        if blocks:
            yield closed(part)

    (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .withColumn("tie", F.xxhash64("text"))
     .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .select(F.spark_partition_id().alias("part"), "doc_id", "text")
     .mapInArrow(run, schema).write.parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed little-endian unsigned 32-bit integers) of a file's documents.

    start is the number of ids of all documents before. Blocks are decoded where they are read; only
    their sizes (one row a block) are summed up beforehand.
    """
    blocks = spark.read.parquet(path).select(
        "part", "segment", "symbols", "freqs", F.explode("blocks").alias("b"))
    sizes = blocks.select("part", "segment", F.col("b.block").alias("block"),
                          F.aggregate("b.sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    inside = Window.partitionBy("part").orderBy("segment", "block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that wrote
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = (
        sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts.select("part", "offset"), "part")
        .select("part", "segment", "block", (F.col("inside") + F.col("offset")).alias("start")))
    placed = blocks.select("part", "segment", F.col("b.block").alias("block"), "symbols", "freqs", "b.doc_ids",
                           "b.sizes", "b.data").join(starts, ["part", "segment", "block"])

    def run(batches):
        last, table = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                start, packed_symbols, packed_freqs, doc_ids, sizes, data = (
                    batch.column(i)[row].as_py() for i in range(6))
                if (packed_symbols, packed_freqs) != last:
                    last = packed_symbols, packed_freqs
                    symbols, freqs = (np.frombuffer(zlib.decompress(x), dtype="<u4").astype(np.int64) for x in last)
                    table = symbols, freqs, slots(freqs)
                ids = decode_block(data, table[0], table[1], lookup=table[2]).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array([ids[4 * a:4 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return placed.select("start", "symbols", "freqs", "doc_ids", "sizes", "data").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
