"""Token ids in binary files, coded by a static range asymmetric numeral system.

One table of frequencies, counted over all ids, is shared by all blocks. A block
is a run of ids that is coded by itself on ``LANES`` interleaved states, lane ``j``
taking the ids ``j, j + LANES, ...``, so that numpy advances all lanes of many
blocks at once. Every ``SEGMENT`` ids a block keeps a checkpoint: the states, the
place in its words and a checksum. A reader may start at any of them, and here
all segments of a task's blocks are decoded side by side.

A block is bytes, all integers little-endian:

    4 bytes  magic ``SRA1``
    u32      checksum of the frequency table
    u32      ids in the block
    u32      segments
    segments x (u32 first word, u32 words, u32 crc32 of the segment's states and words)
    segments x LANES x u64 states
    words    u32 each

Blocks stand in Parquet files beside the documents that they hold, so that Spark's
commit protocol decides which task's files count when executors are lost.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_folder, release, slices, sum_rows, text_column, tied, tree_sum
from .packing import ByteLevelEncoder

MAGIC = b"SRA1"
SCALE_BITS = 20  # frequencies of a table add up to 2**20
LANES = 32
SEGMENT = 1 << 14
BLOCK = 1 << 16
GROUP = 32  # blocks that one numpy step advances together
SLICE_BYTES = 12 << 20  # of text that is encoded at once, each distinct word of it once
_LOW = np.uint64(1 << 31)  # states lie from here up to 2**63
_WORD = np.uint64(32)
_SHARE_BITS, _ID_BITS, _SHARE = np.uint64(SCALE_BITS + 1), np.uint64(2 * SCALE_BITS + 2), np.uint64((2 << SCALE_BITS) - 1)


class FrequencyTable:
    """What coder and decoder share: the ids that occur, and their shares of ``2**SCALE_BITS``."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        self.ids, self.shares = ids.astype(np.uint32), shares.astype(np.uint64)
        if len(shares) and (int(self.shares.sum()) != 1 << SCALE_BITS or int(self.shares.min()) < 1):
            raise ValueError("shares must be positive and add up to the scale")
        self.starts = np.cumsum(self.shares) - self.shares
        self.crc = zlib.crc32(self.to_bytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> FrequencyTable:
        """A share of one at least for each id that occurs, the rest in proportion; what rounding leaves goes to the most frequent."""
        ids = np.flatnonzero(counts)
        if len(ids) > 1 << SCALE_BITS:
            raise ValueError(f"more than 2**{SCALE_BITS} different ids")
        total, spare = int(counts.sum()), (1 << SCALE_BITS) - len(ids)
        shares = np.array([1 + int(c) * spare // total for c in counts[ids].tolist()], np.int64)
        if len(ids):
            shares[np.argmax(counts[ids])] += (1 << SCALE_BITS) - shares.sum()
        return cls(ids, shares)

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.ids)) + self.ids.astype("<u4").tobytes() + self.shares.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FrequencyTable:
        (n,) = struct.unpack_from("<I", raw)
        return cls(np.frombuffer(raw, "<u4", n, 4), np.frombuffer(raw, "<u4", n, 4 + 4 * n))

    def coder(self) -> np.ndarray:
        """By id, the start of its share in the high bits and the share in the low 21."""
        found = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, np.uint64)
        found[self.ids] = self.starts << _SHARE_BITS | self.shares
        return found

    def slots(self) -> np.ndarray:
        """By the low bits of a state, the id from bit 42 on, its share in 21 bits and the offset in the share in the low 21."""
        n = self.shares.astype(np.int64)
        offset = np.arange(int(n.sum()), dtype=np.uint64) - np.repeat(self.starts, n)
        return np.repeat(self.ids.astype(np.uint64) << _ID_BITS | self.shares << _SHARE_BITS, n) | offset


def encode_blocks(blocks: list[np.ndarray], table: FrequencyTable, by_id: np.ndarray) -> list[bytes]:
    """Each block's bytes; all blocks are coded side by side, from the last id to the first. ``by_id`` is the table's ``coder``."""
    sizes = np.array([len(b) for b in blocks])
    steps = -(-int(sizes.max()) // LANES)
    ids = np.zeros((len(blocks), steps * LANES), np.int64)
    for row, block in zip(ids, blocks, strict=True):
        row[: len(block)] = block
    ids = np.ascontiguousarray(ids.reshape(len(blocks), steps, LANES).transpose(1, 0, 2))
    state = np.full((len(blocks), LANES), _LOW)
    words = np.empty(ids.shape, np.uint32)
    sent = np.zeros(ids.shape, bool)
    kept: dict[int, np.ndarray] = {}
    lane = np.arange(LANES)
    ceiling, whole, five = np.uint64(63 - SCALE_BITS), np.uint64(1 << SCALE_BITS), np.uint64(5)
    per_segment = SEGMENT // LANES
    full = int(sizes.min()) // LANES  # steps that every lane of every block takes
    for t in range(steps - 1, -1, -1):
        entry = by_id.take(ids[t])
        share = entry & _SHARE
        on = None
        if t >= full:
            on = t * LANES + lane < sizes[:, None]
            share = np.where(on, share, np.uint64(1))
        out = state >= share << ceiling
        if on is not None:
            out &= on
        words[t] = state
        sent[t] = out
        low = state >> (out.astype(np.uint64) << five)
        # The quotient's multiple of the whole, the remainder and the start, at once.
        after = low + (low // share) * (whole - share) + (entry >> _SHARE_BITS)
        state = after if on is None else np.where(on, after, state)
        if t % per_segment == 0:
            kept[t // per_segment] = state.copy()
    found = []
    for b, n in enumerate(sizes):
        segments = max(1, -(-int(n) // SEGMENT))
        chosen = sent[:, b]
        own = words[:, b][chosen]
        before = np.concatenate([[0], np.cumsum(chosen.sum(1))])
        cuts = [int(before[min(s * per_segment, steps)]) for s in range(segments)] + [len(own)]
        states = [kept[s][b].astype("<u8").tobytes() for s in range(segments)] if n else [np.full(LANES, _LOW).astype("<u8").tobytes()]
        raw = own.astype("<u4")
        heads = [struct.pack("<III", cuts[s], cuts[s + 1] - cuts[s], zlib.crc32(raw[cuts[s] : cuts[s + 1]].tobytes(), zlib.crc32(states[s]))) for s in range(segments)]
        found.append(b"".join([MAGIC, struct.pack("<III", table.crc, int(n), segments), *heads, *states, raw.tobytes()]))
    return found


def read_header(raw: bytes) -> tuple[int, int, list[tuple[int, int, int]]]:
    """The table's checksum, the number of ids and each segment's ``first word, words, crc32``."""
    if raw[:4] != MAGIC:
        raise ValueError("not a block of ids")
    crc, n, segments = struct.unpack_from("<III", raw, 4)
    return crc, n, [struct.unpack_from("<III", raw, 16 + 12 * s) for s in range(segments)]


def decode_blocks(blocks: list[bytes], table: FrequencyTable, slots: np.ndarray) -> list[np.ndarray]:
    """Each block's ids. Segments are checked and then decoded side by side, whatever block they are of. ``slots`` is the table's."""
    states, words, sizes, first, owner = [], [], [], [], []
    at = 0
    for b, raw in enumerate(blocks):
        crc, n, heads = read_header(raw)
        if crc != table.crc:
            raise ValueError("a block was coded with another table")
        body = 16 + 12 * len(heads)
        own = np.frombuffer(raw, "<u4", offset=body + 8 * LANES * len(heads))
        for s, (begin, count, check) in enumerate(heads):
            state = raw[body + 8 * LANES * s : body + 8 * LANES * (s + 1)]
            part = own[begin : begin + count]
            if len(part) != count or zlib.crc32(part.tobytes(), zlib.crc32(state)) != check:
                raise ValueError(f"segment {s} of a block is damaged")
            states.append(np.frombuffer(state, "<u8"))
            words.append(part)
            sizes.append(min(SEGMENT, n - s * SEGMENT))
            first.append(at)
            owner.append(b)
            at += count
    if not blocks:
        return []
    words.append(np.zeros(1, np.uint32))
    flat = np.concatenate(words).astype(np.uint64)
    # Longest first, so that the segments that still go on are always the leading ones.
    order = np.argsort(-np.array(sizes), kind="stable")
    size = np.array(sizes)[order]
    last = np.array(first)[order][:, None] - 1  # the word that was taken last
    state = np.array(states, np.uint64)[order]
    steps = -(-int(size[0]) // LANES)
    ids = np.zeros((steps, len(size), LANES), np.uint32)
    lane = np.arange(LANES)
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for t in range(steps):
        going = int(np.searchsorted(-size, -t * LANES, side="left"))
        now = state[:going]
        entry = slots.take((now & mask).view(np.int64))
        ids[t, :going] = entry >> _ID_BITS
        after = (now >> bits) * (entry >> _SHARE_BITS & _SHARE) + (entry & _SHARE)
        need = after < _LOW
        if size[going - 1] < (t + 1) * LANES:
            on = t * LANES + lane < size[:going, None]
            need &= on
            after = np.where(on, after, now)
        # A lane that needs a word takes the next one after those of the lanes before it.
        rank = need.cumsum(1)
        rank += last[:going]
        np.copyto(after, after << _WORD | flat.take(rank), where=need)
        state[:going] = after
        last[:going] = rank[:, -1:]
    if np.any(state != _LOW) and not _ends_match(state, order, sizes, states, owner):
        raise ValueError("a block does not decode to its end")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    found: list[list[np.ndarray]] = [[] for _ in blocks]
    for s, b in enumerate(owner):
        found[b].append(ids[:, back[s]].ravel()[: sizes[s]])
    return [np.concatenate(x) for x in found]


def _ends_match(state: np.ndarray, order: np.ndarray, sizes: list[int], states: list[np.ndarray], owner: list[int]) -> bool:
    """Whether each segment ends in the states that the next one of its block starts from, the last one in the initial states."""
    end = np.empty_like(state)
    end[order] = state
    for s, b in enumerate(owner):
        goal = states[s + 1] if s + 1 < len(owner) and owner[s + 1] == b else _LOW
        if np.any(end[s] != goal):
            return False
    return True


_ENCODERS: dict[int, ByteLevelEncoder] = {}


def _tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """``part, local_start, doc, ids`` of each row, by ascending id, nulls first, written down.

    Rows of one id are ordered by their text's hash. A number for each row comes
    last, so that even one row that is repeated without end is dealt to several parts.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    text = text_column(text_col)
    rows = df.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("doc", "hash", "row").sortWithinPartitions("doc", "hash", "row").select("doc", "text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("doc", rows.schema["doc"].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(hash(sent.value)) or _ENCODERS.setdefault(hash(sent.value), ByteLevelEncoder(sent.value))
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", limit=SLICE_BYTES):
            docs = encoder.encode(batch.column("text"), end_id)
            n = np.array([len(x) for x in docs], np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            # The two low bytes of each id, then the two high ones, which are mostly zero: small once compressed.
            halves = [b"".join([(x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype("<u2").tobytes()]) for x in docs]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), part, np.int32)), pa.array(starts), batch.column("doc"), pa.array(n), pa.array(halves, pa.binary())], names=schema.names)

    return materialize(rows.mapInArrow(run, schema), "ids")


def _ids_of(raw: bytes) -> np.ndarray:
    halves = np.frombuffer(raw, "<u2").reshape(2, -1)
    return halves[0] | halves[1].astype(np.uint32) << np.uint32(16)


def _id_bound(vocabulary: str, end_id: int) -> int:
    """One more than the highest id that the file or ``end_id`` has."""
    with open(vocabulary, encoding="utf-8") as file:
        found = json.load(file)
    return 1 + max(end_id, *found["model"]["vocab"].values(), *(x["id"] for x in found["added_tokens"]))


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs, added up in a tree of tasks: ``size`` integers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "ids"):
            total += np.bincount(np.concatenate([_ids_of(raw) for raw in batch.column("ids").to_pylist()]), minlength=size)
        yield from sum_rows("ids", TaskContext.get().partitionId(), total)

    rows = tokens.select("ids").mapInArrow(run, "name string, block int, part int, sums binary")
    found = tree_sum(rows, tokens.rdd.getNumPartitions())
    return found.get("ids", np.zeros(size, np.int64))


def write_ids(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str, end_id: int = 2) -> None:
    """Write every document's ids, with ``end_id`` after them, under ``path`` in ascending order of ``id_col``.

    ``path/table`` has the frequency table, ``path/blocks`` a row for each block:
    ``start`` (ids before it in the whole table), ``docs`` (``doc``, ``start`` of the
    document, ``piece`` its ids before this block, ``length`` here, ``n_tokens``) and
    ``block``, the bytes that the module describes. A null text counts as empty, a
    null id comes first, rows that repeat an id are documents of their own; other
    columns are not read. An empty table gives an empty frequency table and no blocks.
    """
    spark = df.sparkSession
    tokens = _tokens(df, id_col, text_col, vocabulary, end_id)
    # One total for each part of the range shuffle, whose number the session sets.
    totals = sorted(tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("n")).collect())
    before = dict(zip((r.part for r in totals), np.concatenate([[0], np.cumsum([r.n for r in totals])]).astype(int).tolist()))
    table = FrequencyTable.of_counts(count_ids(tokens, _id_bound(vocabulary, end_id)))
    spark.createDataFrame([(bytearray(table.to_bytes()), table.crc)], "content binary, crc32 long").coalesce(1).write.parquet(f"{path}/table")
    sent = spark.sparkContext.broadcast((table, before))
    kind = tokens.schema["doc"].dataType
    piece = T.StructType([T.StructField("doc", kind), T.StructField("start", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("length", T.LongType()), T.StructField("n_tokens", T.LongType())])
    schema = T.StructType([T.StructField("start", T.LongType()), T.StructField("docs", T.ArrayType(piece)), T.StructField("block", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = sent.value
        by_id = table.coder()
        kind = None
        ready: list[tuple[int, list, np.ndarray]] = []
        held: list[np.ndarray] = []
        docs: list = []
        first = at = 0

        def close() -> None:
            nonlocal held, docs, first
            if docs:
                ready.append((first, docs, np.concatenate(held)))
            held, docs, first = [], [], at

        def rows() -> pa.RecordBatch:
            coded = encode_blocks([x for _, _, x in ready], table, by_id)
            fields = pa.list_(pa.struct([("doc", kind), *[(f, pa.int64()) for f in ("start", "piece", "length", "n_tokens")]]))
            out = pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in ready], pa.int64()), pa.array([d for _, d, _ in ready], fields), pa.array(coded, pa.binary())], names=["start", "docs", "block"])
            ready.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("doc").type
            for part, local, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "doc", "n", "ids")), strict=True):
                start = before[part] + local
                if start != at:  # another part's rows, or a part that lies in several tasks
                    close()
                    first = at = start
                ids = _ids_of(raw)
                done = 0
                while done < n:
                    take = min(n - done, BLOCK - (at - first))
                    docs.append({"doc": doc, "start": start, "piece": done, "length": take, "n_tokens": n})
                    held.append(ids[done : done + take])
                    done += take
                    at += take
                    if at - first == BLOCK:
                        close()
                        if len(ready) >= GROUP:
                            yield rows()
        close()
        if ready:
            yield rows()

    tokens.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    release(tokens)


def read_pieces(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Decode the files: ``doc, start, piece, length, n_tokens, ids_crc32`` of each document's piece in each block, and ``ids`` if asked for.

    Blocks are decoded wherever Spark puts them. A damaged block, or one of another
    table, is an error.
    """
    (row,) = spark.read.parquet(f"{path}/table").collect()
    table = FrequencyTable.from_bytes(bytes(row.content))
    if table.crc != row.crc32:
        raise ValueError("the frequency table is damaged")
    sent = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{path}/blocks")
    doc = blocks.schema["docs"].dataType.elementType.fields
    schema = T.StructType([*doc, T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        slots = None
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP):
                slots = table.slots() if slots is None else slots
                part = batch.slice(low, GROUP)
                pieces = part.column("docs").flatten()
                decoded = decode_blocks(part.column("block").to_pylist(), table, slots)
                raw = np.concatenate(decoded).astype("<u4").tobytes()
                ends = np.cumsum(pieces.field("length").to_numpy()) * 4
                if ends[-1] != len(raw):
                    raise ValueError("blocks and their documents differ in length")
                own = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                columns = [pieces.field(f.name) for f in doc] + [pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own, pa.binary())] if with_ids else [])], names=schema.names)

    return blocks.select("docs", "block").mapInArrow(run, schema)


def combine_crc32(pieces: list[tuple[int, int]]) -> int:
    """The crc32 of bytes from the ``crc32, length`` of their pieces in order.

    Appending zero bytes to a text multiplies its checksum, as a polynomial over
    two elements, by a power of x; the powers come by squaring.
    """

    def times(a: int, b: int) -> int:
        total = 0
        for _ in range(32):
            total ^= b if a & 0x80000000 else 0
            a = a << 1 & 0xFFFFFFFF
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return total

    found = 0
    for crc, length in pieces:
        factor, base, n = 0x80000000, 0x00800000, length  # one, and x to the eighth, in reflected order
        while n:
            if n & 1:
                factor = times(factor, base)
            base, n = times(base, base), n >> 1
        found = times(found, factor) ^ crc
    return found


def read_digests(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document, from the files alone.

    A document that lies in one block needs no shuffle. The others' pieces meet by
    ``start``, twenty bytes for 65,536 ids, and their checksums are combined. Pieces
    are written down, some bytes each, so that blocks are decoded once.
    """
    pieces = materialize(read_pieces(spark, path), "pieces")
    whole = F.col("length") == F.col("n_tokens")
    single = pieces.where(whole).select(F.col("doc").alias(id_col), "start", "n_tokens", "ids_crc32")
    grouped = pieces.where(~whole).groupBy("start").agg(F.first("doc").alias("doc"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "length", "ids_crc32"))).alias("pieces"))
    kept = grouped.schema["doc"].dataType
    schema = T.StructType([T.StructField(id_col, kept), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for own, n in zip(batch.column("pieces").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if sum(p["length"] for p in own) != n:
                    raise ValueError("a document's pieces are not all there")
                crcs.append(combine_crc32([(p["ids_crc32"], 4 * p["length"]) for p in own]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=schema.names)

    return tied(single.unionByName(grouped.mapInArrow(join, schema)), pieces)


def encode_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str, end_id: int = 2) -> DataFrame:
    """:func:`write_ids` into the shared folder and :func:`read_digests` of what was written."""
    path = new_folder(df.sparkSession, "rans")
    write_ids(df, path, id_col=id_col, text_col=text_col, vocabulary=vocabulary, end_id=end_id)
    found = read_digests(df.sparkSession, path, id_col=id_col)
    return tied(found, found, path)
