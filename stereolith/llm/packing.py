"""Packing by concatenating and cutting.

Pass one tokenizes every document and writes the ids with the part they came
from and their offset there. Prefix sums over the parts' totals turn these into
global offsets. Pass two cuts the one long sequence at multiples of the window;
a document that lies across a cut gives a piece on either side.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, small_batches, text_column

#: Fixed value: the published split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text in which a space stands beside other white space or at an end; RE2 syntax.
_UNEVEN = r"^ | $| [\s\v\x{85}\p{Z}]|[\s\v\x{85}\p{Z}] "


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelEncoder:
    """Ids of a ``tokenizers`` byte-level BPE file, for whole batches of texts.

    A space between two other characters always starts a new pre-token, so the
    ids of a text are those of its space-separated words put together. Each
    distinct word of a batch is encoded once; the texts are then gathered from
    these ids. Texts with uneven white space, or with an added token of the file,
    are encoded as they are.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        file = json.loads(vocabulary)
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in file["added_tokens"]):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        back = _byte_of()
        ranks = {bytes(back[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in self.added}
        self.core = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.widths[i] = len(piece)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def _with_added(self, text: str) -> np.ndarray:
        """Ids of a text in which the file's added tokens may stand: each is its own id, and what lies between is encoded by itself."""
        parts = self.cut.split(text) if self.cut else [text]
        return np.concatenate([np.array([self.added[p]], np.uint32) if i % 2 else self._ids(p) for i, p in enumerate(parts)])

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Each text's ids with ``end`` after them."""
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        for token in self.added:
            uneven = uneven | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(uneven):
            out[i] = np.append(self._with_added(texts[int(i)].as_py()), np.uint32(end))
        even = np.flatnonzero(~uneven)
        if len(even):
            for i, ids in zip(even, self._encode_even(texts.take(pa.array(even)), end), strict=True):
                out[i] = ids
        return out

    def _encode_even(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        words = pc.dictionary_encode(split.flatten())
        codes = words.indices.to_numpy().astype(np.int64)
        distinct = words.dictionary.to_pylist()
        size = len(distinct)
        first = bounds[:-1]
        # Codes: a word after a space, then size + that of a word at the start, then the end.
        inner = np.ones(len(codes), bool)
        inner[first] = False
        used = np.unique(codes[inner])
        joined = "".join([" " + distinct[i] for i in used])
        ids = self._ids(joined)
        at_byte = np.cumsum(self.widths[ids])
        width = np.array([1 + len(distinct[i].encode()) for i in used], np.int64)
        stop = np.searchsorted(at_byte, np.cumsum(width)) + 1
        starts, counts = np.zeros(2 * size + 1, np.int64), np.zeros(2 * size + 1, np.int64)
        starts[used] = np.concatenate([[0], stop[:-1]]) if len(used) else 0
        counts[used] = stop - starts[used] if len(used) else 0
        table, total = [ids], len(ids)
        for i in np.unique(codes[first]):
            own = self._ids(distinct[i])
            starts[size + i], counts[size + i] = total, len(own)
            table.append(own)
            total += len(own)
        starts[2 * size], counts[2 * size] = total, 1
        flat = np.concatenate([*table, np.array([end], np.uint32)])
        codes[first] += size
        codes = np.insert(codes, bounds[1:], 2 * size)
        n = counts[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1])]
        cuts = ends[bounds[1:] + np.arange(len(first))]
        return iter(np.split(ids, cuts[:-1]))


_ENCODERS: dict[int, ByteLevelEncoder] = {}


def tokenize(df: DataFrame, *, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """Pass one: ``part``, ``id_col``, ``doc_tokens``, ``local_start`` and ``ids`` of each row, written down.

    ``ids`` are little-endian unsigned 32-bit integers with ``end_id`` last; a null
    or empty text has that one id. ``vocabulary`` is read on the driver and sent to
    the executors, a few megabytes whatever the input.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    rows = df.select(F.col(id_col).alias("__id"), text_column(text_col).alias("__text"))
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField(id_col, rows.schema[0].dataType), T.StructField("doc_tokens", T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(hash(sent.value)) or _ENCODERS.setdefault(hash(sent.value), ByteLevelEncoder(sent.value))
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "__text"):
            docs = encoder.encode(batch.column("__text"), end_id)
            counts = [len(x) for x in docs]
            starts = list(accumulate(counts, initial=start))
            start = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), part, np.int32)), batch.column("__id"), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.tobytes() for x in docs], pa.binary())],
                names=schema.names,
            )

    return materialize(rows.mapInArrow(run, schema), "tokens")


def with_global_start(tokens: DataFrame) -> DataFrame:
    """Add ``start_at``, the ids before each document in the one long sequence.

    The driver holds one total for each input part, not for each document; the
    broadcast side has that many rows of 12 bytes, so the tokens aren't shuffled.
    """
    totals = sorted(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    before = accumulate((r.n for r in totals), initial=0)
    parts = tokens.sparkSession.createDataFrame([(r.part, b) for r, b in zip(totals, before)], "part int, part_start long")
    return tokens.join(F.broadcast(parts), "part").withColumn("start_at", F.col("part_start") + F.col("local_start"))


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of ``window`` tokens.

    Returns a row for each piece: ``id_col``, ``start`` (the document's ids before
    it), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in
    the sequence) and, if asked for, ``ids``. Only the last sequence has padding.
    A null or empty text is a document of the end id alone. Repeated rows and null
    ids are packed like any other; other columns are not read. An empty table
    gives no pieces.
    """
    tokens = with_global_start(tokenize(df, id_col=id_col, text_col=text_col, vocabulary=vocabulary, end_id=end_id))
    cut = f"greatest(k * {window}L, start_at)"
    length = f"least((k + 1) * {window}L, start_at + doc_tokens) - {cut}"
    own = f"substring(ids, cast(4 * ({cut} - start_at) + 1 as int), cast(4 * ({length}) as int))"
    piece = f"struct({cut} - start_at as start, {length} as length, crc32({own}) as ids_crc32, doc_tokens, k as sequence_id, {cut} - k * {window}L as offset{f', {own} as ids' if with_ids else ''})"
    pieces = F.expr(f"transform(sequence(start_at div {window}, (start_at + doc_tokens - 1) div {window}), k -> {piece})")
    return tokens.select(id_col, pieces.alias("pieces")).select(id_col, F.inline("pieces"))


def sequences(pieces: DataFrame, *, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``n_tokens``, ``ids``.

    Takes what :func:`pack` returns with ids. Runs of pieces that fill a window
    within one task are put together there; only boundary records, the pieces of
    windows that lie across tasks, are shuffled. ``ids`` is padded to ``window``.
    """
    schema = "sequence_id long, offset long, ids binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        filled = 0

        def flush() -> list[tuple[int, int, bytes]]:
            if held and held[0][1] == 0 and filled == 4 * window:
                return [(held[0][0], 0, b"".join(x[2] for x in held))]
            return list(held)

        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "ids")), strict=True):
                if held and (row[0] != held[-1][0] or 4 * row[1] != 4 * held[0][1] + filled):
                    out += flush()
                    held, filled = [], 0
                held.append(row)
                filled += len(row[2])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], names=["sequence_id", "offset", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*flush()), (pa.int64(), pa.int64(), pa.binary()))], names=["sequence_id", "offset", "ids"])

    runs = pieces.select("sequence_id", "offset", "ids").mapInArrow(join, schema)
    whole = F.octet_length("ids") == 4 * window
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("offset", "ids"))), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    boundary = runs.where(~whole).groupBy("sequence_id").agg(joined.alias("ids"))
    both = runs.where(whole).select("sequence_id", "ids").unionByName(boundary)
    pad = pad_id.to_bytes(4, "little")
    return both.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.concat("ids", F.expr(f"unhex(repeat('{pad.hex()}', {window} - cast(octet_length(ids) / 4 as int)))")).alias("ids"))
