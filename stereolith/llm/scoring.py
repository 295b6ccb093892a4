"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is coded as binary decisions, and the score is the sum of their log
probabilities. For each token these are: has training seen it after the two words
before; if not, after the word before; if not, has training seen it at all. A yes to the
first or second leaves the word's share of what followed there; a yes to the third, eight
bits of the word's class, a hash of its outer letters, and its share of the class;
three times no, the bits of its letters, so texts of any words have a probability.

A bit predictor is a table of counts under a hashed context, or a text's own
history so far. The predictors' log-odds are combined by weights that a gate picks.
Weights are learnt online in a few large blocks of texts, in an order that hashes of
the texts fix, and a last table corrects the mix adaptively.

What is counted after one word and after two grows with the corpus and stays
distributed: each chunk of texts sends its distinct keys with their counts to the
buckets that their hashes name, and gets back the sums. The tables of the bit
predictors have fixed sizes. All counts are sums of integers, so scores depend on
neither the order of rows nor the number of parts, but for rounding.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SUM_SCHEMA, materialize, pack_integers, release, slices, sum_rows, text_column, tied, tree_sum, unpack_integers

_SEED = 42
_CHUNK = 4 << 20  # bytes of text in a row of the chunk table, unless one text is longer
_ONE, _TWO, _SHAPE = 1 << 13, 1 << 12, 1 << 12  # slots of the contexts of the word before, of the one before that, and of the former's letters
_LETTERS = 1 << 12  # slots of the contexts of two and of three letters
_BUCKET = 1 << 20  # keys that a bucket gets, about
_BLOCK = 1 << 13
_BINS = 33
_SCALE = 1 << 14  # sums of fractions travel as integers of this unit
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two arrays of hashes."""
    with np.errstate(over="ignore"):
        x = (a ^ (b * _M + np.uint64(0x7F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * _M) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


class BitTable:
    """Counts of bytes under a context, as counts of bits at the nodes of the byte's tree."""

    def __init__(self, leaves: np.ndarray, learning: bool = True):
        level = leaves.reshape(-1, 256).astype(np.float32)
        slots = len(level)
        nodes = np.zeros((slots, 256, 2), np.float32)
        for depth in range(7, -1, -1):
            pairs = level.reshape(slots, 1 << depth, 2)
            nodes[:, 1 << depth : 2 << depth] = pairs
            level = pairs.sum(2)
        counts = nodes.reshape(-1, 2)
        self.level = _level(counts.sum(1)).astype(np.int8)
        # One look-up gets both counts while learning; afterwards their log-odds are enough.
        self.pairs = counts.view(np.complex64).ravel() if learning else None
        self.stretch = None if learning else np.log((counts[:, 1] + np.float32(0.4)) / (counts[:, 0] + np.float32(0.4)))

    def inputs(self, at: np.ndarray, without: np.ndarray | None) -> np.ndarray:
        """Log-odds at the nodes; an outcome of ``without`` is taken out of the counts first."""
        if self.stretch is not None:
            return self.stretch.take(at, mode="clip")
        pair = self.pairs.take(at, mode="clip")
        return _stretch(pair.imag, pair.real, without)


def _stretch(ones: np.ndarray, zeros: np.ndarray, without: np.ndarray | None) -> np.ndarray:
    if without is not None:
        ones, zeros = np.maximum(ones - without, 0), np.maximum(zeros - (1 - without), 0)
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def _level(seen: np.ndarray) -> np.ndarray:
    """The gate: how often a node was seen."""
    return (seen >= 2).astype(np.int64) + (seen >= 12) + (seen >= 80)


def _log2_cost(x: np.ndarray) -> np.ndarray:
    """Bits of an outcome whose log-odds are ``x``."""
    x = np.maximum(x.astype(np.float32, copy=False), np.float32(-60))
    return np.log2(np.float32(1) + np.exp(-x))


@dataclass
class Mixer:
    """Weights by bit and gate, the last of a constant, and the corrections of the mix by bit and bin."""

    weights: np.ndarray  # bits x 4 x (predictors + 1)
    corrections: np.ndarray | None = None  # bits x _BINS, log-odds

    @classmethod
    def fresh(cls, predictors: int, bits: int = 8) -> Mixer:
        weights = np.full((bits, 4, predictors + 1), 1.2 / predictors, np.float32)
        weights[:, :, -1] = 0
        return cls(weights)

    def dot(self, bit: int, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = self.weights[bit]
        return sum((x * w[:, i].take(gate, mode="clip") for i, x in enumerate(inputs)), w[:, -1].take(gate, mode="clip"))

    def bits(self, bit: int, inputs: list[np.ndarray], gate: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Bits of each outcome."""
        dot = self.dot(bit, inputs, gate)
        if self.corrections is not None:
            dot = (dot + self.corrections[bit].take(_bin(dot), mode="clip")) / 2
        return _log2_cost(np.where(outcome == 1, dot, -dot))

    def costs(self, tables: list[BitTable], slots: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        """Bits of each symbol of eight bits."""
        total = np.zeros(len(symbols), np.float32)
        for own, own_slots, k in _blocks(slots, symbols):
            for bit in range(8):
                total[k : k + _BLOCK] += self.bits(bit, *_inputs(tables, own_slots, own, bit, False))
        return total


def _blocks(slots: list[np.ndarray], symbols: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], int]]:
    for k in range(0, len(symbols), _BLOCK):
        yield symbols[k : k + _BLOCK], [s[k : k + _BLOCK] * 256 for s in slots], k


def _inputs(tables: list[BitTable], slots: list[np.ndarray], symbols: np.ndarray, bit: int, leave_out: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The predictors' log-odds, the gate and the outcome of one bit of each symbol."""
    node = (1 << bit) | (symbols >> (8 - bit))
    outcome = (symbols >> (7 - bit)) & 1
    at = [s + node for s in slots]
    without = outcome.astype(np.float32) if leave_out else None
    return [t.inputs(k, without) for t, k in zip(tables, at)], tables[-1].level.take(at[-1], mode="clip"), outcome


class Lesson:
    """What some outcomes teach a mixer: slopes and curvatures of its cost by its weights, and outcomes by bin.

    All are sums, so it doesn't matter in what order or in which task the outcomes come.
    """

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        bits, gates, width = mixer.weights.shape
        self.slopes, self.curves = np.zeros((bits, gates, width)), np.zeros((bits, gates, width, width))
        self.seen = np.zeros((bits, _BINS, 2), np.int64)

    def take(self, bit: int, inputs: list[np.ndarray], gate: np.ndarray, outcome: np.ndarray) -> None:
        dot = self.mixer.dot(bit, inputs, gate)
        p = 1 / (1 + np.exp(-dot))
        self.seen[bit] += np.bincount(_bin(dot) * 2 + outcome, minlength=2 * _BINS).reshape(_BINS, 2)
        order = np.argsort(gate.astype(np.int8), kind="stable")
        x = np.empty((len(inputs) + 1, len(dot)))
        for i, column in enumerate(inputs):
            column.take(order, out=x[i]) if column.dtype == x.dtype else np.copyto(x[i], column.take(order))
        x[-1] = 1
        p = p.take(order)
        error, spread = outcome.take(order) - p, p * (1 - p)
        for g, (a, b) in enumerate(zip(*(np.searchsorted(gate, range(5), sorter=order)[k : k + 4] for k in (0, 1)))):
            if b > a:
                own = x[:, a:b]
                self.slopes[bit, g] += own @ error[a:b]
                self.curves[bit, g] += (own * spread[a:b]) @ own.T

    def symbols(self, tables: list[BitTable], slots: list[np.ndarray], symbols: np.ndarray) -> None:
        """All eight bits of symbols that the tables were counted from, so each is left out of the counts that predict it."""
        for own, own_slots, _ in _blocks(slots, symbols):
            for bit in range(8):
                self.take(bit, *_inputs(tables, own_slots, own, bit, True))

    def rows(self, name: str, part: int) -> Iterator[pa.RecordBatch]:
        for kind, values in (("slopes", np.rint(self.slopes * _SCALE)), ("curves", np.rint(self.curves * _SCALE)), ("seen", self.seen)):
            yield from sum_rows(f"{name}-{kind}", part, values)

    @staticmethod
    def apply(mixer: Mixer, sums: dict[str, np.ndarray], name: str) -> Mixer:
        """The mixer after a step of Newton's on the sums of all tasks' lessons, drawn towards no step."""
        if f"{name}-slopes" not in sums:
            return mixer
        shape = mixer.weights.shape
        slopes = sums[f"{name}-slopes"].reshape(shape) / _SCALE
        curves = sums[f"{name}-curves"].reshape(*shape, shape[-1]) / _SCALE
        step = np.linalg.solve(curves + 16 * np.eye(shape[-1]), slopes[..., None])[..., 0]
        return Mixer((mixer.weights + np.clip(step, -1, 1)).astype(np.float32), _corrections(sums[f"{name}-seen"].reshape(shape[0], _BINS, 2)))


def _bin(dot: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(dot * 2) + _BINS // 2, 0, _BINS - 1).astype(np.int64)


def _corrections(seen: np.ndarray) -> np.ndarray:
    """Log-odds by bit and bin, drawn towards the bin's own where few outcomes were seen."""
    centre = (np.arange(_BINS) - _BINS // 2) / 2
    prior = 1 / (1 + np.exp(-centre))
    n = seen.sum(-1)
    p = (seen[..., 1] + 16 * prior) / (n + 16)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)).astype(np.float32)


# Chunks of texts.


class Chunk:
    """A row of the chunk table, as arrays over its tokens. ``hashes`` are those of its distinct words."""

    def __init__(self, hashes: np.ndarray, codes: bytes, ends: np.ndarray, held: np.ndarray):
        self.codes = unpack_integers(codes, np.int32)
        self.ends = ends
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.hashes = hashes
        self.end = hashes[-1]
        self.own = self.hashes[self.codes]
        self.before = self.shift(self.own, 1, self.end)
        self.two_before = self.shift(self.own, 2, self.end)
        self.learns = np.repeat(~held, self.ends - self.starts)

    def shift(self, x: np.ndarray, n: int, fill) -> np.ndarray:
        """What stands ``n`` tokens before in the same text, else ``fill``."""
        out = np.concatenate([np.full(n, fill, x.dtype), x[:-n]])[: len(x)] if len(x) else x
        for k in range(n):
            at = self.starts + k
            out[at[at < np.minimum(self.ends, len(x))]] = fill
        return out

    def pairs(self) -> np.ndarray:
        """The keys of each token after the word before, then of each after the two words before."""
        return np.concatenate([_mix(self.before, self.own), _mix(_mix(self.before, self.two_before), self.own)])

    def trained(self) -> np.ndarray:
        """How often each word comes in the chunk's training texts."""
        return np.bincount(self.codes[self.learns], minlength=len(self.hashes))


class Words:
    """Distinct words from the bytes in which each has a space after it; the last is empty and stands for the end of a text."""

    _draw = np.random.default_rng(_SEED)
    _TABLES = _draw.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + _draw.integers(0, 2, (2, 256), np.uint64)
    _FACTORS = np.array([0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F], np.uint64)

    def __init__(self, blob: bytes):
        self.bytes = np.frombuffer(blob, np.uint8)
        self.stops = np.flatnonzero(self.bytes == 32)
        self.starts = np.concatenate([[0], self.stops[:-1] + 1]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.stops)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash of each word: its letters' random numbers, each times a power of its place."""
        if not len(self):
            return np.zeros(0, np.uint64)
        sizes = self.stops - self.starts + 1
        place = np.arange(len(self.bytes)) - np.repeat(self.starts, sizes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()), self._FACTORS[which]))
            total = np.add.reduceat(self._TABLES[which][self.bytes] * powers[place], self.starts)
        return _mix(total, self._FACTORS[1 - which : 2 - which])

    def checks(self) -> np.ndarray:
        """A second hash, by which words of one hash differ."""
        return (self.hashes(1) >> np.uint64(48)).astype(np.uint16)

    def shapes(self) -> np.ndarray:
        """A hash of the outer letters of each word; its high byte is the word's class."""
        last = self.bytes[np.maximum(self.stops - 1, 0)].astype(np.uint64)
        last2 = self.bytes[np.maximum(self.stops - 2, 0)].astype(np.uint64)
        size = self.stops - self.starts
        key = self.bytes[self.starts] + (np.where(size > 0, last, 0) << np.uint64(8)) + (np.where(size > 1, last2, 0) << np.uint64(16))
        return (_mix(key.astype(np.uint64), self._FACTORS[:1]) >> np.uint64(32)).astype(np.uint32)

    def only(self, which: np.ndarray) -> bytes:
        """Those of a mask."""
        return self.bytes[np.repeat(which, self.stops - self.starts + 1)].tobytes()


def _read(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each row of a batch by itself, with its ends and whether its texts are held out."""
    for i in range(batch.num_rows):
        one = batch.slice(i, 1)
        yield one, one.column("ends").flatten().to_numpy(), one.column("held").flatten().to_numpy(zero_copy_only=False).astype(bool)


def chunk_table(df: DataFrame, *, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """Texts by the chunk, written down: ``chunk``, ``n_tokens``, ``ids``, ``held``, ``n_bytes``, ``ends``, ``words``, ``codes``.

    ``words`` are the chunk's distinct words, each with a space after it, the empty one, which
    is last, standing for the end of a text; ``codes`` are the tokens as packed places in ``words``, and ``ends`` say
    where each text's stop.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(held_out, F.lit(False)).alias("__held"), text_column(text_col).alias("__text"))
    ids = T.ArrayType(rows.schema[0].dataType)
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", ids), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("codes", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for piece in slices(batches, "__text", 1 << 20):
            n = piece.column("__text").nbytes
            if held and size + n > _CHUNK:
                yield _chunk(number, held, schema.names)
                number, held, size = number + 1, [], 0
            held.append(piece)
            size += n
        if held:
            yield _chunk(number, held, schema.names)

    return materialize(rows.mapInArrow(run, schema), "chunks")


def _chunk(number: int, pieces: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    table = pa.Table.from_batches(pieces)
    texts = table.column("__text").combine_chunks()
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = split.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(full)])[offsets[1:]]
    words = pc.dictionary_encode(flat.filter(pa.array(full)))
    codes = words.indices.to_numpy().astype(np.int32)
    codes = np.insert(codes, ends, np.int32(len(words.dictionary)))
    ends = ends + np.arange(1, len(ends) + 1)
    spelt = words.dictionary.cast(pa.large_binary())
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(spelt)], pa.int64()), spelt), pa.scalar(b" ", pa.large_binary()))[0].as_py()
    vocabulary = joined + b"  " if len(spelt) else b" "

    def whole(values: pa.Array) -> pa.Array:
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    bytes_ = pc.binary_length(texts).cast(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([len(codes)]), whole(table.column("__id")), whole(table.column("__held")), whole(bytes_), whole(pa.array(ends, pa.int64())), pa.array([vocabulary], pa.binary()), pa.array([pack_integers(codes)], pa.binary())],
        names=names,
    )


# Counts that grow with the corpus.


class Distinct:
    """The distinct ones of an array of keys in order, and the way back."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        ranked = keys[self.order]
        head = np.ones(len(keys), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        self.heads = np.flatnonzero(head)
        self.keys = ranked[self.heads]
        self._head = head

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order].astype(np.int64), self.heads) if len(self.heads) else np.zeros(0, np.int64)

    def back(self, values: np.ndarray) -> np.ndarray:
        """A value of each distinct key at all places of that key."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = values[np.cumsum(self._head) - 1]
        return out


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal width of the hashes, so that sorted keys are sorted by bucket."""
    high = keys >> np.uint64(32)
    if buckets <= 1 << 31:
        return ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    raise ValueError("too many buckets")


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their gaps, in as few bytes each as the widest takes, the high bytes compressed."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    first, gaps = gaps[:1], gaps[1:]
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + first.tobytes() + planes[:-1].tobytes() + zlib.compress(planes[-1].tobytes(), 1)


def _unpack_keys(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    width = packed[0]
    gaps = np.zeros((n, 8), np.uint8)
    low = (n - 1) * (width - 1)
    gaps[1:, : width - 1] = np.frombuffer(packed, np.uint8, low, 9).reshape(width - 1, n - 1).T
    gaps[1:, width - 1] = np.frombuffer(zlib.decompress(packed[9 + low :]), np.uint8)
    gaps = gaps.view(np.uint64).ravel()
    gaps[0] = np.frombuffer(packed, np.uint64, 1, 1)[0]
    return np.cumsum(gaps, dtype=np.uint64)


_SENT = "kind int, bucket long, chunk long, keys binary, checks binary, counts binary"
_ANSWERS = "kind int, bucket long, chunk long, totals binary, n_distinct long, n_once long"
_WORDS, _PAIRS = 0, 1


def _by_bucket(kind: int, chunk: int, keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray, buckets: int, shift: int) -> Iterator[tuple]:
    """A chunk's sorted keys as rows for their buckets."""
    at = _bucket_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield kind, int(at[a]), chunk, _pack_keys(keys[a:b] >> np.uint64(shift)), None if checks is None else checks[a:b].tobytes(), pack_integers(counts[a:b].astype(np.uint32))


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """For each chunk the counts in all training texts of its words and of its pairs, written down.

    Pairs are hashes of 36 bits beyond those that name the bucket, so that one in
    about sixty thousand is taken for another; words have 80 bits in all. A bucket gets about a
    million keys, however large the corpus; a key that a third of all tokens have comes once from
    each chunk.
    """
    total = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    pair_buckets = max(1, -(-2 * total // _BUCKET))
    word_buckets = max(1, pair_buckets // 8)
    shift = max(0, 28 - (pair_buckets - 1).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, ends, held in (r for batch in batches for r in _read(batch)):
            words, number = Words(one.column("words")[0].as_py()), one.column("chunk")[0].as_py()
            chunk = Chunk(words.hashes(), one.column("codes")[0].as_py(), ends, held)
            order = np.argsort(chunk.hashes, kind="stable")
            out = list(_by_bucket(_WORDS, number, chunk.hashes[order], words.checks()[order], chunk.trained()[order], word_buckets, 0))
            found = Distinct(chunk.pairs())
            out += _by_bucket(_PAIRS, number, found.keys, None, found.sums(np.tile(chunk.learns, 2)), pair_buckets, shift)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in _SENT.split(", ")])

    def add(table: pa.Table) -> pa.Table:
        kind, packed = table.column("kind")[0].as_py(), table.column("keys").to_pylist()
        counts = [unpack_integers(c, np.uint32) for c in table.column("counts").to_pylist()]
        sizes = np.cumsum([0, *map(len, counts)])
        keys = np.concatenate([_unpack_keys(k, len(n)) for k, n in zip(packed, counts)])
        counts = np.concatenate(counts).astype(np.int64)
        if kind == _WORDS:
            checks = np.frombuffer(b"".join(table.column("checks").to_pylist()), np.uint16)
            order = np.lexsort((checks, keys))
            head = np.ones(len(keys), bool)
            head[1:] = (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)
        else:
            order = np.argsort(keys)
            head = np.ones(len(keys), bool)
            head[1:] = np.diff(keys[order]) != 0
        sums = np.add.reduceat(counts[order], np.flatnonzero(head))
        totals = np.empty(len(keys), np.int64)
        totals[order] = sums[np.cumsum(head) - 1]
        parts = [pack_integers(np.minimum(totals[a:b], np.iinfo(np.int64).max)) for a, b in zip(sizes[:-1], sizes[1:])]
        n = len(parts)
        once = lambda x: pa.array([int(x)] + [0] * (n - 1), pa.int64())
        return pa.table([table.column("kind"), table.column("bucket"), table.column("chunk"), pa.array(parts, pa.binary()), once((sums > 0).sum()), once((sums == 1).sum())], names=[x.split()[0] for x in _ANSWERS.split(", ")])

    sent = chunks.select("chunk", "held", "ends", "words", "codes").mapInArrow(send, _SENT)
    sent = sent.repartition(_tasks(pair_buckets + word_buckets), "kind", "bucket")
    return materialize(sent.groupBy("kind", "bucket").applyInArrow(add, _ANSWERS), "answers")


_COUNTED = "held array<boolean>, n_bytes array<bigint>, ends array<bigint>, codes binary, hashes binary, shapes binary, c binary, after binary, rare binary, " + SUM_SCHEMA


def _tasks(groups: int) -> int:
    return max(1, -(-groups // 4))


def with_counts(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunk table with what the corpus says, and what the predictors' tables count; written down.

    Rows with ``ids`` are chunks: ``hashes`` and ``shapes`` of their words, ``c``, the words'
    counts in training, ``after``, the tokens' counts after one and after two words, and
    ``rare``, the words that training has once or never. Rows with ``name`` are the
    sums of a task for :func:`tree_sum`.
    """
    tasks = _tasks(chunks.count())  # so that a task's share stays the same, however many chunks there are
    mine = answers.repartition(tasks, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "totals"))).alias("answers"))
    rows = chunks.repartition(tasks, "chunk").join(mine.hint("merge"), "chunk").select("ids", "held", "n_bytes", "ends", "words", "codes", "answers")
    schema = T.StructType([rows.schema[0], *T._parse_datatype_string(_COUNTED).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for one, ends, held in (r for batch in batches for r in _read(batch)):
            words = Words(one.column("words")[0].as_py())
            chunk = Chunk(words.hashes(), one.column("codes")[0].as_py(), ends, held)
            parts = one.column("answers")[0].as_py()
            totals = {kind: np.concatenate([unpack_integers(a["totals"], np.int64) for a in parts if a["kind"] == kind]) for kind in (_WORDS, _PAIRS)}
            c = np.empty(len(words), np.int64)
            c[np.argsort(chunk.hashes, kind="stable")] = totals[_WORDS]
            after = Distinct(chunk.pairs()).back(totals[_PAIRS])
            shapes = words.shapes()
            rare = words.only(c <= 1)
            counts.take(chunk, c, after, shapes, Words(rare))
            made = [chunk.hashes.tobytes(), shapes.tobytes(), pack_integers(c), pack_integers(after), rare]
            columns = [*[one.column(n) for n in ("ids", "held", "n_bytes", "ends", "codes")], *[pa.array([x], pa.binary()) for x in made], *[pa.nulls(1, f.type) for f in arrow][10:]]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], names=schema.names)
        for sums in counts.rows(TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(sums.num_rows, f.type) for f in arrow][:10], *sums.columns], names=schema.names)

    return materialize(rows.mapInArrow(run, schema), "counted")


# Decisions and the tables that predict them.

_DECISION_SLOTS = (128, 256, 1 << 12)
_WORD_SLOTS = (1, _TWO, _SHAPE, _ONE)
_LETTER_SLOTS = (256, _LETTERS, _LETTERS)


_SIZES = np.array([n.bit_length() for n in range(65)], np.int8)


def _size(n: np.ndarray) -> np.ndarray:
    """0 for 0, else the number of bits of a count, 7 at most."""
    return _SIZES.take(np.minimum(n, 64))


class Facts:
    """What the corpus says of each token of a chunk, and the decisions that this leaves.

    With ``leave_out`` a training token's own count is taken out of all counts.
    """

    def __init__(self, chunk: Chunk, c: np.ndarray, after: np.ndarray, leave_out: bool):
        self.chunk = chunk
        n = len(chunk.codes)
        own = chunk.learns.astype(np.int64) if leave_out else np.zeros(n, np.int64)
        texts = int(c[-1])  # each training text has one end
        known, one, two = c[chunk.codes], after[:n], after[n:]
        self.n1 = np.maximum(chunk.shift(known, 1, texts) - own, 0)
        self.n2 = np.maximum(chunk.shift(one, 1, texts) - own, 0)
        # What was seen after two words was seen after one, and so on, but for hashes that are the same.
        self.c0 = np.maximum(known - own, 0)
        self.c1 = np.minimum(np.minimum(np.maximum(one - own, 0), self.n1), self.c0)
        self.c2 = np.minimum(np.minimum(np.maximum(two - own, 0), self.n2), self.c1)
        self.own = own
        self.depth = (self.c0 > 0).view(np.int8) + (self.c1 > 0).view(np.int8) + (self.c2 > 0).view(np.int8)
        full = self.depth == 3
        one_, two_ = chunk.shift(full, 1, False), chunk.shift(full, 2, False)
        two_ &= one_
        self.run = one_.view(np.int8) + two_.view(np.int8) + (two_ & chunk.shift(full, 3, False)).view(np.int8)
        self.last = chunk.shift(self.depth, 1, 0) * np.int8(4) + chunk.shift(self.depth, 2, 0)
        self._l1, self._l2 = _size(self.n1), _size(self.n2)
        self._before = _slot(chunk.before, _DECISION_SLOTS[2]).astype(np.int32)

    def decision(self, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The tokens at which decision ``k`` (2: seen after two words, 1: after one, 0: at all) is taken, its contexts, the log-odds of the text's own history, the gate and the outcome.

        ``among`` restricts the tokens that are given, not those that make the history.
        """
        offered = (self.n2 > 0, (self.depth < 3) & (self.n1 > 0), self.depth < 2)[2 - k]
        hit = self.depth == k + 1
        history = self._so_far(hit & offered, offered)
        at = np.flatnonzero(offered if among is None else offered & among)
        level = (self._l1 * np.int8(0), self._l1, self._l2)[k].take(at)
        last, wide = self.last.take(at), np.int32
        slots = [level.astype(wide) * 16 + last, (self._l1.take(at).astype(wide) * 8 + self._l2.take(at)) * 4 + self.run.take(at), self._before.take(at)]
        gate = last >> 2 if k == 0 else np.clip((level - 1) // (3 - k), 0, 3)
        return at, slots, history.take(at), gate, hit.take(at).view(np.int8).astype(wide)

    def _so_far(self, hit: np.ndarray, offered: np.ndarray) -> np.ndarray:
        """Log-odds of a decision from its outcomes earlier in the same text."""
        chunk = self.chunk
        sums = []
        for x in (hit, offered):
            total = np.cumsum(x, dtype=np.int32) - x.view(np.int8)
            begin = np.zeros(len(chunk.ends), np.int32)
            inside = chunk.starts < len(x)
            begin[inside] = total[chunk.starts[inside]]
            sums.append((total - np.repeat(begin, chunk.ends - chunk.starts)).astype(np.float32))
        return _stretch(sums[0], sums[1] - sums[0], None)


def _class_slots(chunk: Chunk, shapes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    before = chunk.shift(shapes[chunk.codes], 1, 0)
    return [np.zeros(len(at), np.int64), _slot(chunk.two_before[at], _TWO), _slot(before[at].astype(np.uint64), _SHAPE), _slot(chunk.before[at], _ONE)]


class Counts:
    """What the predictors' tables count in one task's training texts, each token's own count left out of what decides."""

    def __init__(self) -> None:
        self.words = [np.zeros(n * 256, np.int32) for n in _WORD_SLOTS]
        self.letters = [np.zeros(n * 256, np.int32) for n in _LETTER_SLOTS]
        self.decisions = [[np.zeros(2 * n, np.int64) for n in _DECISION_SLOTS] for _ in range(3)]
        self.classes = np.zeros(256, np.int64)

    def take(self, chunk: Chunk, c: np.ndarray, after: np.ndarray, shapes: np.ndarray, rare: Words) -> None:
        facts = Facts(chunk, c, after, True)
        for k in range(3):
            _, slots, _, _, outcome = facts.decision(k, chunk.learns)
            for total, slot in zip(self.decisions[k], slots):
                total += np.bincount(slot * 2 + outcome, minlength=len(total))
        kinds = (shapes >> np.uint32(24)).astype(np.int64)[chunk.codes]
        self.classes += np.bincount(kinds[chunk.learns], minlength=256)
        at = np.flatnonzero(chunk.learns & (facts.depth == 1))
        for total, slot in zip(self.words, _class_slots(chunk, shapes, at)):
            total += np.bincount(slot * 256 + kinds[at], minlength=len(total)).astype(np.int32)
        contexts, symbols, _ = _letters(Words(rare.only(_spelling(chunk, c))))
        for total, slot in zip(self.letters, contexts):
            total += np.bincount(slot * 256 + symbols, minlength=len(total)).astype(np.int32)

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        for kind, totals in (("w", self.words), ("l", self.letters), *((f"d{k}", t) for k, t in enumerate(self.decisions))):
            for i, total in enumerate(totals):
                yield from sum_rows(f"{kind}{i}", part, total, 1 << 18)
        yield from sum_rows("classes", part, self.classes)


def _letters(words: Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Contexts, letters and owners of words spelt out, each with a space at its end."""
    letters = words.bytes.astype(np.int64)
    sizes = words.stops - words.starts + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - words.starts[owner]
    past = [np.where(place >= k, np.concatenate([np.full(k, 32), letters[:-k]])[: len(letters)], 32) for k in (1, 2, 3)]
    two = (past[0] * 256 + past[1]).astype(np.uint64)
    three = two * np.uint64(256) + past[2].astype(np.uint64)
    return [past[0], _slot(two, _LETTERS), _slot(three, _LETTERS)], letters, owner


class Tables:
    """The tables of counts, as an executor builds them from what it was sent."""

    _built: tuple[tuple[str, bool], Tables] | None = None

    def __init__(self, sent: dict[str, bytes], learning: bool):
        def leaves(name: str, cells: int) -> np.ndarray:
            return unpack_integers(sent[name], np.uint32) if name in sent else np.zeros(cells, np.uint32)

        self.words = [BitTable(leaves(f"w{i}", n * 256), learning) for i, n in enumerate(_WORD_SLOTS)]
        self.letters = [BitTable(leaves(f"l{i}", n * 256), learning) for i, n in enumerate(_LETTER_SLOTS)]
        counts = [[leaves(f"d{k}{i}", 2 * n).astype(np.float32).view(np.complex64) for i, n in enumerate(_DECISION_SLOTS)] for k in range(3)]
        self.decisions = [[(t, _stretch(t.imag, t.real, None)) for t in own] for own in counts]

    @classmethod
    def of(cls, sent: Sent, learning: bool) -> Tables:
        """Built once in each worker, the last ones let go first."""
        if cls._built is None or cls._built[0] != (sent.id, learning):
            cls._built = None
            cls._built = ((sent.id, learning), cls(sent.value, learning))
        return cls._built[1]

    def about(self, k: int, slots: list[np.ndarray], history: np.ndarray, without: np.ndarray | None) -> list[np.ndarray]:
        """The predictors' log-odds of decision ``k``; the outcomes of ``without`` are taken out of the counts."""
        if without is None:
            return [*[odds.take(s) for (_, odds), s in zip(self.decisions[k], slots)], history]
        pairs = [counts.take(s) for (counts, _), s in zip(self.decisions[k], slots)]
        return [*[_stretch(x.imag, x.real, without) for x in pairs], history]


@dataclass
class Sent:
    """A broadcast with a name by which a worker knows it again."""

    id: str
    held: object

    @property
    def value(self) -> dict[str, bytes]:
        return self.held.value


@dataclass
class Model:
    """All that the executors get: tables of fixed sizes, sent compressed and once, the mixers and the classes' sizes."""

    sent: Sent
    total: int  # training tokens
    classes: np.ndarray  # training tokens of each class
    decisions: Mixer = field(default_factory=lambda: Mixer.fresh(len(_DECISION_SLOTS) + 1, 3))
    words: Mixer = field(default_factory=lambda: Mixer.fresh(len(_WORD_SLOTS)))
    letters: Mixer = field(default_factory=lambda: Mixer.fresh(len(_LETTER_SLOTS)))
    learning: bool = True

    @property
    def tables(self) -> Tables:
        return Tables.of(self.sent, self.learning)


_ROUNDS = 2  # blocks of texts that teach one after the other: a quarter of them, then the rest


def _round_of(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, hashes) >> np.uint64(40)) % np.uint64(4) != 0


def _spelling(chunk: Chunk, c: np.ndarray) -> np.ndarray:
    """A mask over the chunk's rare words of those that training has once, here: each teaches its spelling."""
    rare = np.flatnonzero(c <= 1)
    return (c[rare] == 1) & (chunk.trained()[rare] == 1) & (rare < len(c) - 1)  # the end of a text, which is last, isn't spelt


def _counted(one: pa.RecordBatch, ends: np.ndarray, held: np.ndarray) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, Words]:
    """The chunk of a row of :func:`with_counts`, its words' counts, its tokens' counts, its words' shapes and its rare words."""
    hashes, codes, shapes, c, after = (one.column(n)[0].as_py() for n in ("hashes", "codes", "shapes", "c", "after"))
    chunk = Chunk(np.frombuffer(hashes, np.uint64), codes, ends, held)
    return chunk, unpack_integers(c, np.int64), unpack_integers(after, np.int64), np.frombuffer(shapes, np.uint32), Words(one.column("rare")[0].as_py())


def train(counted: DataFrame) -> Model:
    """The model of the texts of :func:`with_counts` that aren't held out: a pass over them for each round of learning."""
    sums = counted.where("name is not null").select("name", "block", "part", "sums")
    sums = tree_sum(sums, (sums.agg(F.max("part")).first()[0] or 0) + 1)
    classes = sums.pop("classes", np.zeros(256, np.int64))
    packed = counted.sparkSession.sparkContext.broadcast({name: pack_integers(np.minimum(x, np.iinfo(np.uint32).max).astype(np.uint32)) for name, x in sums.items()})
    model = Model(Sent(uuid.uuid4().hex, packed), int(classes.sum()), classes)
    rows = counted.where("ids is not null").select("held", "ends", "codes", "hashes", "shapes", "c", "after", "rare")
    parts = rows.rdd.getNumPartitions()
    for turn in range(_ROUNDS):
        taught = tree_sum(rows.mapInArrow(_teach(model, turn), SUM_SCHEMA), parts)
        for name in ("decisions", "words", "letters"):
            setattr(model, name, Lesson.apply(getattr(model, name), taught, name))
    model.learning = False
    return model


def _teach(model: Model, turn: int):
    """What the texts of one round teach the mixers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables
        lessons = {name: Lesson(getattr(model, name)) for name in ("decisions", "words", "letters")}
        for chunk, c, after, shapes, words in (_counted(*r) for batch in batches for r in _read(batch)):
            facts = Facts(chunk, c, after, True)
            of_text = _round_of(np.add.reduceat(chunk.own, chunk.starts)) if len(chunk.own) else np.zeros(0, bool)
            learns = chunk.learns & (np.repeat(of_text, chunk.ends - chunk.starts) == bool(turn))
            for k in range(3):
                _, slots, history, gate, outcome = facts.decision(k, learns)
                lessons["decisions"].take(k, tables.about(k, slots, history, outcome.astype(np.float32)), gate, outcome)
            at = np.flatnonzero(learns & (facts.depth == 1))
            lessons["words"].symbols(tables.words, _class_slots(chunk, shapes, at), (shapes >> np.uint32(24)).astype(np.int64)[chunk.codes[at]])
            now = _round_of(chunk.hashes[c <= 1]) == bool(turn)
            contexts, symbols, _ = _letters(Words(words.only(_spelling(chunk, c) & now)))
            lessons["letters"].symbols(tables.letters, contexts, symbols)
        part = TaskContext.get().partitionId()
        for name, lesson in lessons.items():
            yield from lesson.rows(name, part)

    return run


def score_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column) -> DataFrame:
    """The model's and a unigram's log10 probability of every text.

    Learns from the rows for which ``held_out`` isn't true. Tokens are words between
    ASCII white space with A-Z in lower case, then one end of text. Returns
    ``id_col``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training has),
    ``train_tokens``, ``base_score`` (unigram with one added to each count),
    ``score``, and ``bits_per_byte``: the cost of the text when each training token's own
    count is left out, which tells texts that occur again from those that don't (null for a
    text without bytes). Equal texts have equal scores. A null or empty
    text is the end alone. Without training texts every word is spelt. One row
    comes out for each that goes in; other columns are not read.

    Counts of words and pairs are summed over all texts and stay distributed. Each task
    holds one chunk of about 4 MB of text, or one text if that is longer.
    """
    chunks = chunk_table(df, id_col=id_col, text_col=text_col, held_out=held_out)
    answers = corpus_counts(chunks)
    distinct = answers.where(f"kind = {_WORDS}").agg(F.sum("n_distinct")).first()[0] or 0
    counted = with_counts(chunks, answers)
    release(chunks, answers)
    model = train(counted)
    id_type = counted.schema["ids"].dataType.elementType
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [id_type, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, ends, held in (r for batch in batches for r in _read(batch)):
            chunk, c, after, shapes, words = _counted(one, ends, held)
            at = chunk.starts
            spelt = _spelt(model, c, words)
            bits = _bits(model, Facts(chunk, c, after, False), shapes, spelt)
            apart = np.where(chunk.learns, _bits(model, Facts(chunk, c, after, True), shapes, spelt, chunk.learns), bits)
            base = np.log10((c + 1) / (model.total + distinct + 1))[chunk.codes]
            n = chunk.ends - at
            size = one.column("n_bytes").flatten().to_numpy()
            rate = np.divide(np.add.reduceat(apart, at), size, out=np.full(len(size), np.nan), where=size > 0)
            yield pa.RecordBatch.from_arrays(
                [one.column("ids").flatten(), one.column("held").flatten(), pa.array(n), pa.array(np.add.reduceat((c > 0).astype(np.int64)[chunk.codes], at)), pa.array(np.full(len(n), model.total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(-np.add.reduceat(bits, at) * np.log10(2)), pa.array(rate, mask=np.isnan(rate))],
                names=names,
            )

    rows = counted.where("ids is not null").select("ids", "held", "n_bytes", "ends", "codes", "hashes", "shapes", "c", "after", "rare")
    return tied(rows.mapInArrow(run, schema), counted)


def _spelt(model: Model, c: np.ndarray, words: Words) -> np.ndarray:
    """Bits of the letters of each word that training has once or never; the end of a text has one to spell."""
    out = np.zeros(len(c))
    rare = np.flatnonzero(c <= 1)
    if len(rare):
        contexts, symbols, owner = _letters(words)
        out[rare] = np.bincount(owner, weights=model.letters.costs(model.tables.letters, contexts, symbols), minlength=len(rare))
    return out


def _bits(model: Model, facts: Facts, shapes: np.ndarray, spelt: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Bits of each token, or of those ``among`` alone."""
    chunk, tables = facts.chunk, model.tables
    bits = np.zeros(len(chunk.codes))
    chosen = np.ones(len(bits), bool) if among is None else among
    for k in range(3):
        at, slots, history, gate, outcome = facts.decision(k, among)
        own = facts.own[at]
        without = outcome.astype(np.float32) if own.any() else None
        bits[at] += model.decisions.bits(k, tables.about(k, slots, history, without), gate, outcome)
    for depth, mine, all_ in ((3, facts.c2, facts.n2), (2, facts.c1, facts.n1)):
        at = np.flatnonzero(chosen & (facts.depth == depth))
        bits[at] -= np.log2(mine[at] / all_[at])
    at = np.flatnonzero(chosen & (facts.depth == 1))
    kinds = (shapes >> np.uint32(24)).astype(np.int64)[chunk.codes[at]]
    bits[at] += model.words.costs(tables.words, _class_slots(chunk, shapes, at), kinds)
    bits[at] -= np.log2(facts.c0[at] / np.maximum(model.classes[kinds] - facts.own[at], 1))
    at = np.flatnonzero(chosen & (facts.depth == 0))
    bits[at] += spelt[chunk.codes[at]]
    return bits
