"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merge-type encoding starts from characters and merges the best-scored adjacent
pair until none is left. Here each candidate that comes up is first put to a
keyed hash of seed, variant, word, place and piece; if that falls under the
dropout rate, the candidate is struck off the agenda. The same key always gives
the same segmentation, other keys give others, and all of them decode to the
same text.

Distinct words of a batch are segmented together, a step of all their agendas at
a time; very long words have an agenda of their own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_column

SPACE = "▁"
_LONG = 48  # characters from which a word has an agenda of its own
_NONE = np.iinfo(np.int32).max
_CHUNK = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def _skips(word: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate merge into ``piece`` at character ``place`` of the keyed ``word`` is skipped."""
    with np.errstate(over="ignore"):
        drawn = _mix(word ^ _mix(place.astype(np.uint64) * _M2 + piece.astype(np.uint64)))
    return (drawn >> np.uint64(11)).astype(np.float64) / (1 << 53) < rate


class PieceModel:
    """The vocabulary of a merge-type SentencePiece model, with what its agenda needs."""

    def __init__(self, model: bytes):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = file.get_piece_size()
        pieces = [file.id_to_piece(i) for i in range(size)]
        normal = [not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i)) for i in range(size)]
        self.byte_ids = np.array([file.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if len(set(self.byte_ids.tolist())) != 256:
            raise ValueError("the model has no piece for each byte, so not every text would decode")
        self.size = size
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.ids):
            raise ValueError("the model has pieces across words")
        self.bytes_of = [p.replace(SPACE, " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[int(i)] = bytes([b])
        scores = np.array([file.get_score(i) for i in range(size)])
        self.rank = np.empty(size, np.int32)
        self.rank[np.lexsort((np.arange(size), -scores))] = np.arange(size)
        self.by_rank = np.argsort(self.rank).astype(np.int32)
        self.single = np.arange(0x110000, dtype=np.int32) + size  # a character without a piece: its number above the vocabulary
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = int(self.rank[i])
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        self.probes = 1
        slots = self._slot(np.array(list(pairs), np.int64))
        for slot, (key, value) in zip(slots.tolist(), pairs.items()):
            n = 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) % (1 << bits), n + 1
            self.keys[slot], self.values[slot] = key, value
            self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _M1) >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair makes, or the highest integer."""
        out = np.full(a.shape, _NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0) & (a < self.size) & (b < self.size))
        keys = a.ravel()[todo].astype(np.int64) * self.size + b.ravel()[todo]
        slots = self._slot(keys)
        flat = out.ravel()
        for _ in range(self.probes):
            held = self.keys[slots]
            hit = held == keys
            flat[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (held >= 0)
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) % len(self.keys)
            if not len(todo):
                break
        return flat.reshape(a.shape)

    def final(self, symbols: Sequence[int]) -> list[int]:
        """Ids of a word's symbols: characters without a piece become the pieces of their bytes."""
        if all(s < self.size for s in symbols):
            return list(symbols)
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.size else [int(self.byte_ids[b]) for b in chr(s - self.size).encode()]
        return out


def segment_word(model: PieceModel, word: str, key: int, rate: float) -> list[int]:
    """One word's ids, with an agenda of its own: best piece first, then the leftmost."""
    symbols = [int(model.single[ord(c)]) for c in word]
    place = list(range(len(symbols)))
    left, right = [i - 1 for i in place], [i + 1 for i in place]
    alive = [True] * len(symbols)
    agenda: list[tuple[int, int, int, int]] = []

    def propose(i: int) -> None:
        j = right[i] if i >= 0 else len(symbols)
        if i >= 0 and j < len(symbols):
            rank = model.pairs.get(symbols[i] * model.size + symbols[j]) if symbols[i] < model.size and symbols[j] < model.size else None
            if rank is not None:
                heapq.heappush(agenda, (rank, i, symbols[i], symbols[j]))

    for i in place:
        propose(i)
    keyed = np.array([key], np.uint64)
    while agenda:
        rank, i, a, b = heapq.heappop(agenda)
        if not alive[i] or symbols[i] != a or right[i] >= len(symbols) or symbols[right[i]] != b:
            continue
        piece = int(model.by_rank[rank])
        if rate and _skips(keyed, np.array([i]), np.array([piece]), rate)[0]:
            continue
        j = right[i]
        symbols[i], alive[j], right[i] = piece, False, right[j]
        if right[j] < len(symbols):
            left[right[j]] = i
        propose(left[i])
        propose(i)
    return model.final([s for s, on in zip(symbols, alive) if on])


def segment(model: PieceModel, words: Sequence[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids in one array, and the number of each word's."""
    size = np.array([len(w) for w in words], np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their symbols, their numbers of symbols
    done: dict[int, list[int]] = {}
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        if n > _LONG:
            done |= {int(i): segment_word(model, words[i], int(keys[i]), rate) for i in own}
        elif n:
            letters = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            found.append((own, *_segment_block(model, model.single[letters], keys[own], rate)))
    counts = np.zeros(len(words), np.int64)
    for own, symbols, n in found:
        odd = np.flatnonzero((symbols >= model.size).any(1))
        done |= {int(own[r]): model.final(symbols[r, : n[r]].tolist()) for r in odd}
        counts[own] = n
    for i, ids in done.items():
        counts[i] = len(ids)
    ends = np.cumsum(counts)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for own, symbols, n in found:
        cols = np.arange(symbols.shape[1])
        plain = ~(symbols >= model.size).any(1)
        keep = (cols < n[:, None]) & plain[:, None]
        at = (ends[own] - counts[own])[:, None] + cols
        flat[at[keep]] = symbols[keep]
    for i, ids in done.items():
        flat[ends[i] - len(ids) : ends[i]] = ids
    return flat, counts


def _segment_block(model: PieceModel, symbols: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length: their agendas take a step each at a time, until all are empty."""
    rows, width = symbols.shape
    symbols = symbols.astype(np.int32)
    out, left = symbols.copy(), np.full(rows, width, np.int64)
    if width == 1:
        return out, left
    at = np.arange(rows)
    places = np.tile(np.arange(width, dtype=np.int32), (rows, 1))
    offered = model.merged(symbols[:, :-1], symbols[:, 1:])
    count = left.copy()
    while len(at):
        best = offered.argmin(1)
        lines = np.arange(len(at))
        rank = offered[lines, best]
        open_ = rank != _NONE
        if not open_.all():
            shut = ~open_
            out[at[shut]], left[at[shut]] = np.pad(symbols[shut], ((0, 0), (0, width - symbols.shape[1])), constant_values=-1), count[shut]
            at, symbols, places, offered, count, keys, best, rank = (x[open_] for x in (at, symbols, places, offered, count, keys, best, rank))
            lines = np.arange(len(at))
            if not len(at):
                break
        piece = model.by_rank[rank]
        skip = _skips(keys, places[lines, best], piece, rate) if rate else np.zeros(len(at), bool)
        offered[lines[skip], best[skip]] = _NONE
        go = np.flatnonzero(~skip)
        if not len(go):
            continue
        b = best[go]
        cols = np.arange(symbols.shape[1])
        moved = np.minimum(cols + (cols > b[:, None]), symbols.shape[1] - 1)
        s = np.take_along_axis(symbols[go], moved, 1)
        s[:, -1] = -1
        s[np.arange(len(go)), b] = piece[go]
        symbols[go] = s
        places[go] = np.take_along_axis(places[go], moved, 1)
        count[go] -= 1
        gaps = np.arange(offered.shape[1])
        kept = np.minimum(gaps + (gaps > b[:, None]), offered.shape[1] - 1)
        o = np.take_along_axis(offered[go], kept, 1)
        o[:, -1] = _NONE
        r = np.arange(len(go))
        has = b > 0
        o[r[has], b[has] - 1] = model.merged(s[r[has], b[has] - 1], s[r[has], b[has]])
        inner = b < o.shape[1]
        nxt = np.minimum(b + 1, s.shape[1] - 1)
        new = model.merged(s[r, b], np.where(b + 1 < s.shape[1], s[r, nxt], -1))
        o[r[inner], b[inner]] = new[inner]
        offered[go] = o
        widest = int(count.max())
        if widest < symbols.shape[1] and widest >= 2:
            symbols, places, offered = symbols[:, :widest], places[:, :widest], offered[:, : widest - 1]
    return out, left


class Encoder:
    """Encodes batches of texts and decodes ids."""

    def __init__(self, model: bytes, seed: int, rate: float, variants: int):
        self.model, self.seed, self.rate, self.variants = PieceModel(model), seed, rate, variants
        self.mark = [int(i) for i in self.model.byte_ids[list(SPACE.encode())]]

    def encode(self, texts: Sequence[str], lanes: np.ndarray) -> list[np.ndarray]:
        """Each text's ids; ``lanes`` picks each text's variant."""
        import xxhash

        book: dict[str, int] = {}
        codes: list[np.ndarray] = []
        plain: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            if SPACE in text:
                plain.append((i, text))
                codes.append(np.empty(0, np.int64))
            else:
                codes.append(np.array([book.setdefault(w, len(book)) for w in _CHUNK.findall(SPACE + text.replace(" ", SPACE))], np.int64))
        words = list(book)
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
        both, back = np.unique(flat * self.variants + np.repeat(lanes, sizes), return_inverse=True)
        hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), self.seed) for w in words], np.uint64)
        own = both // self.variants
        keys = _mix(hashes[own] + (both % self.variants).astype(np.uint64)) if len(own) else np.empty(0, np.uint64)
        ids, counts = segment(self.model, [words[i] for i in own], keys, self.rate)
        ends = np.cumsum(counts)
        n = counts[back]
        stop = np.cumsum(n)
        whole = ids[np.repeat(ends[back] - n - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate([[0], stop])[np.cumsum(sizes)]
        out = np.split(whole, bounds[:-1]) if len(texts) else []
        for i, text in plain:
            out[i] = self._encode_marked(text, int(lanes[i]))
        return out

    def _encode_marked(self, text: str, lane: int) -> np.ndarray:
        """A text that holds the space mark itself: the mark goes in as its bytes, which no space does."""
        import xxhash

        ids: list[int] = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                ids += self.mark
            for word in _CHUNK.findall((SPACE if not k else "") + part.replace(" ", SPACE)):
                key = _mix(np.array([xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed) + lane & 0xFFFFFFFFFFFFFFFF], np.uint64))
                ids += segment_word(self.model, word, int(key[0]), self.rate)
        return np.array(ids, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes: the pieces' bytes without the space put before it."""
        table = self.model.bytes_of
        return b"".join([table[i] for i in ids.tolist()])[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str, seed: int = 0, dropout: float = 0.1, variants: int = 8) -> DataFrame:
    """``id_col``, ``ids``, ``n_bytes`` and ``lossless`` of every row.

    A row's variant is its id's hash: rows of different variants segment the same
    word differently, and so does another ``seed``. ``dropout`` 0 gives the model's
    own segmentation. ``lossless`` says that the ids decode to the very text. A null
    or empty text has the ids of the space put before it. Characters outside the
    vocabulary become the pieces of their bytes. One row comes out for each that
    goes in; other columns are not read. The model file is read on the driver.
    """
    with open(model, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())
    lane = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(variants))
    rows = df.select(F.col(id_col), lane.alias("__lane"), text_column(text_col).alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_bytes", T.LongType()), T.StructField("lossless", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (hash(sent.value), seed, dropout, variants)
        encoder = _ENCODERS.get(at) or _ENCODERS.setdefault(at, Encoder(sent.value, seed, dropout, variants))
        for batch in slices(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            ids = encoder.encode(texts, batch.column("__lane").to_numpy())
            raw = [t.encode() for t in texts]
            same = [encoder.decode(x) == t for x, t in zip(ids, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(t) for t in raw], pa.int64()), pa.array(same)], names=schema.names)

    return rows.mapInArrow(run, schema)
