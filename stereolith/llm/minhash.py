"""Near-duplicates by the Jaccard similarity of word shingles, found by meet-in-the-middle ball hashing.

A single SimHash fingerprint can't tell texts at 0.8, which differ in 10 of its 64
bits in the mean. So a text has ``PRINTS`` SimHash fingerprints of ``BITS`` bits over its set of shingles,
each with an anchor, the least values of ``ROWS`` permutations of them. Texts of one anchor are looked up by their
fingerprints: each distinct one emits all points of its half ball, and one shuffle
brings those with a common point together, which are all within ``RADIUS`` bits. A
bit differs with a probability of at most 0.1875 at 0.8 (four shingles of five; 0.15
for large sets), so a fingerprint finds such a pair with 0.8^2 * 0.40 or
more, and all ``PRINTS`` miss one in 800,000. Every candidate is then held against the
shingles themselves, so nothing below the least similarity is linked.

Texts of the same words are one class. At a point, one text is the hub,
that which has most company in all its fingerprints, and each text is compared with the first of its hubs. What these links leave in
different components is compared where the rarest shingles of two texts meet: a prefix of
each, so short that no two similar texts can miss. So a large group of near copies of one
text costs its star, and those too far from it and from each other cost no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, slices, small_batches, text_column, tied
from .components import connected_components
from .simhash import SEED, at_places, ball, kept_rows, marked, placed_rows

ROWS, PRINTS, BITS, RADIUS = 2, 46, 16, 2
STARS = 8  # hubs that a text is compared with first; what they leave apart is compared after them
_BLOCK = 255  # shingles whose bits are counted in bytes
_M = np.uint64(0x9E3779B97F4A7C15)


def _odd(n: int, kind: type) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, np.iinfo(kind).max, n, kind) | kind(1)


_FACTORS = _odd(ROWS * PRINTS, np.uint32)
_ADDED = np.random.default_rng(SEED + 1).integers(0, 1 << 32, ROWS * PRINTS, np.uint32)
_MIXED = _odd(ROWS, np.uint64)
_WORDS = _odd(-(-PRINTS * BITS // 64), np.uint64)


def shingles(text: bytes, size: int) -> tuple[int, np.ndarray]:
    """A hash of all words of a text, and the sorted hashes of its distinct shingles; of all words if they are fewer than ``size``."""
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z and ASCII white space
    digest = xxhash.xxh64_intdigest
    whole = digest(b" ".join(words), SEED)
    if len(words) < size:
        return whole, np.array([whole], np.uint64)
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    total = len(words) - size + 1
    x = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            x = (x ^ hashes[k : k + total]) * _M
            x ^= x >> np.uint64(29)
    return whole, np.unique(x)


def anchors(found: np.ndarray) -> np.ndarray:
    """The anchor of each fingerprint of a set of shingles as longs; those of different places differ."""
    x = ((found ^ (found >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(ROWS * PRINTS, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), _BLOCK):
            values = x[k : k + _BLOCK, None] * _FACTORS
            values += _ADDED
            np.minimum(least, values.min(axis=0), out=least)
        keys = (least.reshape(PRINTS, ROWS).astype(np.uint64) * _MIXED).sum(axis=1, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(31)) ^ np.arange(PRINTS, dtype=np.uint64)) * _M
    return keys.view(np.int64)


def prints(found: np.ndarray) -> np.ndarray:
    """The SimHash fingerprints of a set of shingles as shorts: a bit is 1 if set in over half the shingles' hashes."""
    ones = np.zeros(64 * len(_WORDS), np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), _BLOCK):
            x = found[k : k + _BLOCK, None] * _WORDS
            x = (x ^ (x >> np.uint64(32))) * _M
            x ^= x >> np.uint64(29)
            ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).view(np.int16)[:PRINTS]


def parities(found: np.ndarray) -> np.ndarray:
    """1024 bits as longs: whether an odd number of the shingles falls on each place.

    Two sets differ in at least as many shingles as these differ in bits.
    """
    odd = np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _signatures(placed: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``__id``, the place, ``whole``, ``n`` (distinct shingles), ``anchors``, ``prints`` and ``bits`` of every row, written down."""
    rows = placed.select(F.col(id_col).alias("__id"), "__file", "__row", text_column(text_col).cast("binary").alias("__text"))
    lists = {"anchors": (anchors, PRINTS, T.LongType()), "prints": (prints, PRINTS, T.ShortType()), "bits": (parities, 16, T.LongType())}
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("whole", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(name, T.ArrayType(kind)) for name, (_, _, kind) in lists.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            made = [shingles(t, shingle) for t in batch.column("__text").to_pylist()]
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * n), pa.array(np.concatenate([of(s) for _, s in made]))) for of, n, _ in lists.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([_signed(w) for w, _ in made], pa.int64()), pa.array([len(s) for _, s in made], pa.int64()), *arrays], names=schema.names)

    return materialize(rows.mapInArrow(run, schema), "signatures")


def _sets(named: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``whole`` and the array ``shingles`` of each text of ``named(whole)``, written down; no other text is shuffled."""
    places = materialize(classes.select("whole", "__file", "__row").join(named, "whole", "left_semi"), "places")
    marks = marked(places)
    rows = at_places(texts, marks).join(places, ["__file", "__row"]).select("whole", "__text")
    schema = "whole long, shingles array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            made = [shingles(t, shingle)[1].view(np.int64) for t in batch.column("__text").to_pylist()]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))], names=["whole", "shingles"])

    found = materialize(rows.mapInArrow(run, schema), "sets")
    release(places, marks)
    return found


def _similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingles are similar enough; only texts of a pair are read."""
    found = materialize(pairs, "pairs")
    release(pairs)
    pairs = found
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("whole")).distinct(), classes, texts, shingle)
    left = sets.select(F.col("whole").alias("a"), F.col("shingles").alias("__a"))
    right = sets.select(F.col("whole").alias("b"), F.col("shingles").alias("__b"))
    both = F.size(F.array_intersect("__a", "__b"))
    enough = both * (10 + tenths) >= (F.size("__a") + F.size("__b")) * tenths
    found = materialize(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "links")
    release(pairs, sets)
    return found


def _pairs(both: DataFrame, tenths: int) -> DataFrame:
    """The distinct ``a, b`` of rows ``x, y`` that sizes and parities don't rule out."""
    n, m = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(16)), F.lit(0))
    fits = (10 * F.least(n, m) >= tenths * F.greatest(n, m)) & (apart * (10 + tenths) <= (n + m) * (10 - tenths))
    return tied(both.where(fits).select(F.least("x.whole", "y.whole").alias("a"), F.greatest("x.whole", "y.whole").alias("b")).where("a <> b").distinct(), both)


def _points(cells: DataFrame) -> DataFrame:
    """Rows with a ``print`` once for each ``point`` of its half ball."""
    masks = F.array(*[F.lit(m).cast("short") for m in ball(RADIUS // 2, BITS)])
    return cells.withColumn("point", F.explode(F.transform(masks, lambda m: F.col("print").bitwiseXOR(m))))


def links(classes: DataFrame, texts: DataFrame, *, shingle: int, tenths: int) -> DataFrame:
    """Edges ``a, b`` that join all candidates of ``tenths`` / 10 similarity or more.

    Candidates are texts that have an anchor in common and fingerprints there within ``RADIUS``
    bits. ``classes`` has ``whole``, ``n``, ``anchors``, ``prints``, ``bits`` and the place of one row;
    ``texts`` has ``__file``, ``__row`` and ``__text``.
    """
    cell, at = ["anchor", "print"], Window.partitionBy("anchor", "point")
    emitted = classes.select("whole", F.explode(F.arrays_zip("anchors", "prints")).alias("e")).select("whole", F.col("e.anchors").alias("anchor"), F.col("e.prints").alias("print"))
    shared = emitted.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("size > 1")
    shared = materialize(shared.select("whole", *cell, "size", F.count(F.lit(1)).over(Window.partitionBy(*cell)).alias("alike")), "shared")
    # Texts of one fingerprint emit its half ball once, and only where others have the anchor; points of one fingerprint go.
    # Fingerprints are dealt by anchor, 65,536 of one at most, and their points stay there.
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = _points(shared.where("size > alike").select(*cell).repartition(parts, "anchor").distinct())
    meets = materialize(points.withColumn("prints", F.count(F.lit(1)).over(at)).where("prints > 1").drop("prints"), "meets")
    nodes = materialize(shared.groupBy("whole").agg(F.sum("alike").alias("weight")).join(classes.select("whole", "n", "bits"), "whole"), "nodes")
    members = materialize(shared.join(nodes.select("whole", "weight", "n"), "whole").select(*cell, "whole", "weight", "n"), "members")
    named = nodes.select("whole", F.struct("whole", "n", "bits").alias("x"))

    hubs = members.groupBy(*cell).agg(F.max(F.struct("weight", "whole")).alias("hub"))
    hubs = hubs.unionByName(meets.join(hubs, cell).select(*cell, F.max("hub").over(at).alias("hub")).distinct())
    stars = members.join(hubs, cell).where("whole <> hub.whole").groupBy("whole").agg(F.sort_array(F.collect_set("hub"), asc=False).alias("hubs"))
    stars = stars.select("whole", F.explode(F.slice("hubs", 1, STARS)["whole"]).alias("hub"))
    stars = stars.join(named, "whole").select("x", "hub").join(named.select(F.col("whole").alias("hub"), F.col("x").alias("y")), "hub")
    first = _similar(_pairs(stars, tenths), classes, texts, shingle, tenths)

    components = connected_components(first)
    rooted = members.join(components.withColumnRenamed("node", "whole"), "whole", "left").select(*cell, F.coalesce("root", "whole").alias("root"), "whole", "n")
    mixed = rooted.groupBy(*cell).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"))
    around = meets.join(mixed, cell).select(*cell, F.min("low").over(at).alias("low"), F.max("high").over(at).alias("high"), F.min("least").over(at).alias("least"))
    mixed = materialize(mixed.unionByName(around).where("low < high").groupBy(*cell).agg(F.min("least").alias("least")), "mixed")
    open_ = rooted.join(mixed, cell).groupBy("whole").agg(F.first("root").alias("root"), F.min("least").alias("least"))
    open_ = materialize(open_.join(named, "whole"), "open")
    second = _similar(_pairs(_unlinked(open_, classes, texts, shingle, tenths), tenths), classes, texts, shingle, tenths)
    release(shared, meets, nodes, members, components, mixed, open_)
    return tied(first.unionByName(second), first, second)


def _unlinked(open_: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Pairs ``x, y`` of different components among which are all that share a point and are similar enough.

    Two sets that share at least ``t`` shingles have a common one among the first ``n - t + 1`` of each, in
    any one order of all shingles; the rarest come first here. ``least`` is the smallest set that
    shares a point with a text, and gives its ``t``, as does the smallest that can be similar. Near copies that are too far from each other
    have only shingles of their own up to there, so they make no pairs. Where most texts that have a
    shingle are in one component, the others alone are held against all.
    """
    sets = _sets(open_.select("whole"), classes, texts, shingle)
    each = sets.select("whole", F.explode("shingles").alias("s"))
    known = materialize(each.groupBy("s").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "known")
    ranked = each.join(known, "s").groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("texts", "s"))).alias("order"))
    n = F.col("x.n")
    least = F.greatest("least", F.ceil(n * tenths / 10))
    enough = F.floor((tenths * (n + least) + (9 + tenths)) / (10 + tenths))
    own = n - F.size("order")  # shingles that no other text has come before all others
    first = F.slice("order", F.lit(1), F.greatest((n - enough + 1 - own).cast("int"), F.lit(0)))
    prefixes = materialize(ranked.join(open_, "whole").select("root", "x", F.explode(first).alias("p")).select(F.col("p.s").alias("s"), "root", "x"), "prefixes")
    sizes = prefixes.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"))
    major = materialize(sizes.groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("s", "major"), "major")
    minor = prefixes.join(major, "s").where("root <> major").select("s", F.col("root").alias("root2"), F.col("x").alias("y"))
    return tied(prefixes.join(minor, "s").where("root <> root2").select("x", "y"), sets, known, prefixes, major)


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """``df`` with one row of each component of texts of ``tenths`` / 10 similarity or more: that of the smallest id.

    Similarity is that of the sets of ``shingle`` words; texts of fewer words are
    alike if all words are. Null, empty and white texts are alike. Rows with a null
    id come after all others; of repeated rows one stays. Columns and their order
    are kept, whatever their names. An empty table stays empty.
    """
    columns = df.columns
    small_batches(df.sparkSession)
    placed = placed_rows(df)
    id_col, text_col = (f"c{columns.index(c)}" for c in (id_col, text_col))
    made = _signatures(placed, id_col, text_col, shingle)
    key = F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__file", "__row")
    # The row of least key of each class, picked by its place, so that its lists are neither aggregated nor shuffled.
    owners = marked(made.groupBy("whole").agg(F.min(key).alias("own")).select("own.__file", "own.__row"))
    classes = at_places(made, owners)
    texts = placed.select("__file", "__row", text_column(text_col).cast("binary").alias("__text"))
    edges = links(classes, texts, shingle=shingle, tenths=tenths)
    components = connected_components(edges)
    roots = components.withColumnRenamed("node", "whole")
    members = classes.select("whole", key.alias("own")).join(roots, "whole", "left").select(F.coalesce("root", "whole").alias("root"), "own")
    stay = marked(members.groupBy("root").agg(F.min("own").alias("own")).select("own.__file", "own.__row"))
    release(made, owners, edges, components)
    return kept_rows(placed, stay, columns)
