"""Token-id shards in training order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import as_frame, prepare, settled, slices, texts_of, tidied
from lamina.llm.text import VOCAB, encode_chunks, ranks

SEQUENCE, PER_SHARD, ROUNDS, KEY = 2048, 256, 6, 0x5EED


def _feistel(x: np.ndarray, half: int, key: int) -> np.ndarray:
    """A keyed permutation of [0, 4^half)."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    with np.errstate(over="ignore"):
        for r in range(ROUNDS):
            f = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
    return left << np.uint64(half) | right


def slot_of(seq: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slot of each sequence: a permutation of [0, total), walking cycles back into range."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    x = _feistel(seq.astype(np.uint64), half, key)
    out = np.flatnonzero(x >= np.uint64(total))
    while len(out):
        x[out] = _feistel(x[out], half, key)
        out = out[x[out] >= np.uint64(total)]
    return x.astype(np.int64)


def encoded(docs: DataFrame, *, vocab: str = VOCAB, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, start, n, ids): each document's ids with an end mark, little-endian, and where they
    begin in their part's token stream.  Written once; every later step reads what was written."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        table = ranks(vocab)
        end = max(table.values()) + 1 if end_id is None else end_id
        kind = np.uint16 if max(end, max(table.values())) < 65536 else np.uint32
        for b in batches:
            col = texts_of(b)
            for lo, hi in slices(col):
                code, off, ids = encode_chunks(col.slice(lo, hi - lo), vocab)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                first = np.concatenate([[0], np.cumsum(size)])
                flat = np.fromiter((x for w in ids for x in w), kind, int(first[-1]))
                n = size[code]
                total = np.concatenate([[0], np.cumsum(n)])
                gather = np.repeat(first[code] - total[:-1], n) + np.arange(total[-1])
                docs_n = total[off[1:]] - total[off[:-1]]
                out = np.full(int(total[-1]) + len(docs_n), end, kind)
                ends = np.cumsum(docs_n + 1) - 1
                body = np.ones(len(out), bool)
                body[ends] = False
                out[body] = flat[gather]
                bounds = np.concatenate([[0], ends + 1])
                raw = pa.Array.from_buffers(pa.binary(), len(docs_n), [None, pa.py_buffer((bounds * out.itemsize).astype(np.int32)), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs_n), part), pa.int32()), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)), raw], ["part", "start", "n", "ids"])
                at += int(bounds[-1])

    live = as_frame(docs, id_col, text_col).filter("text IS NOT NULL")
    return settled(live.mapInArrow(tidied(run), "part int, start bigint, n bigint, ids binary"), "encoded")


def token_shards(docs: DataFrame, *, vocab: str = VOCAB, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, first_slot, sequences, stride, checksum, payload): fixed-stride shards in training order.

    The documents' ids, each ended by an end mark, form one stream cut into sequences of
    ``sequence`` ids (the last padded with end marks).  A keyed permutation gives each sequence its
    slot; shard s holds slots s * per_shard ... in order, so slot t is at byte
    (t mod per_shard) * stride of its shard and a reader resumes anywhere by arithmetic alone.
    Null text has no ids and no mark; an empty text is its mark; equal rows repeat; no documents
    give no shards.  The stream follows the input's partitions, and is the same for the same input.
    """
    spark = docs.sparkSession
    rows = encoded(docs, vocab=vocab, id_col=id_col, text_col=text_col)
    # a number a partition of the input
    sizes = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = {}, 0
    for part, n in sizes:
        base[part] = total
        total += n
    sequences = -(-total // sequence)
    table = ranks(vocab)
    end = max(table.values()) + 1
    kind = np.uint16 if end < 65536 else np.uint32
    width = np.dtype(kind).itemsize
    shards = -(-sequences // per_shard)
    parts = int(max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, start, n = (b.column(k).to_numpy() for k in range(3))
            data = b.column(3)
            if not len(part):
                continue
            begin = start + np.array([base[p] for p in part.tolist()], np.int64)
            first, last = begin // sequence, (begin + n - 1) // sequence
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lo = np.maximum(seq * sequence, begin[row])
            hi = np.minimum((seq + 1) * sequence, begin[row] + n[row])
            slot = slot_of(seq, sequences, key)
            off = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            raw = data.buffers()[2]
            # pieces of consecutive rows are consecutive bytes: one set of offsets cuts them all
            bounds = np.concatenate([[off[0]], off[0] + np.cumsum((hi - lo) * width)]).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), raw])
            shard = slot // per_shard
            yield pa.RecordBatch.from_arrays([pa.array((shard * parts // max(shards, 1)).astype(np.int32)), pa.array(slot), pa.array((lo - seq * sequence).astype(np.int32)), pieces], ["range", "slot", "at", "piece"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, buf = None, None

        def done():
            n = min(per_shard, sequences - shard * per_shard)
            raw = buf[: n * sequence].tobytes()
            cols = [[shard], [shard * per_shard], [n], [sequence * width], [xxhash.xxh3_64_intdigest(raw) >> 1], [raw]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["shard", "first_slot", "sequences", "stride", "checksum", "payload"])

        for b in batches:
            slots, at = b.column(1).to_numpy(), b.column(2).to_numpy()
            where = (slots % per_shard) * sequence + at
            for s, w, piece in zip((slots // per_shard).tolist(), where.tolist(), b.column(3)):
                if s != shard:
                    if shard is not None:
                        yield done()
                    shard, buf = s, np.full(per_shard * sequence, end, kind)
                ids = np.frombuffer(piece.as_buffer(), kind)
                buf[w : w + len(ids)] = ids
        if shard is not None:
            yield done()

    pieces = rows.mapInArrow(tidied(cut), "range int, slot bigint, at int, piece binary")
    ranged = pieces.repartitionById(parts, F.col("range")).sortWithinPartitions("slot", "at")
    return ranged.mapInArrow(tidied(build), "shard bigint, first_slot bigint, sequences int, stride int, checksum bigint, payload binary")


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as ``folder``/shard-N.bin (to a name of its own, then renamed, so that a
    retried task replaces what it wrote) and return the manifest without the payloads.

    A folder that holds shards already raises ``FileExistsError``: two runs never mix.  No shards
    write none.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    if any(x.base_name.startswith("shard-") for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))):
        raise FileExistsError(f"{folder} holds shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(5)):
                own = f"{root}/.{n}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(own) as f:
                    f.write(raw.as_buffer())
                fs.move(own, f"{root}/shard-{n:08d}.bin")
            yield b.select(range(5))

    return shards.mapInArrow(tidied(run), "shard bigint, first_slot bigint, sequences int, stride int, checksum bigint")


def read_slots(folder: str, begin: int, end: int, *, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, kind=np.uint16) -> Iterator[np.ndarray]:
    """Sequences of slots ``begin`` ... ``end`` - 1, by seeking: resumes at any slot.

    An empty range gives none; a slot before 0 or past the last raises ``IndexError``.
    """
    if begin < 0:
        raise IndexError(f"slot {begin}")
    fs, root = pafs.FileSystem.from_uri(folder)
    stride = sequence * np.dtype(kind).itemsize
    for shard in range(begin // per_shard, -(-end // per_shard) if end > begin else 0):
        lo, hi = max(begin, shard * per_shard), min(end, (shard + 1) * per_shard)
        path = f"{root}/shard-{shard:08d}.bin"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise IndexError(f"slot {lo}")
        with fs.open_input_file(path) as f:
            f.seek(min((lo % per_shard) * stride, f.size()))
            for slot in range(lo, hi):
                raw = f.read(stride)
                if len(raw) < stride:
                    raise IndexError(f"slot {slot}")
                yield np.frombuffer(raw, kind)
