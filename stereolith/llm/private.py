"""Personal data: pattern spans, and identifiers that their contexts give away.

Fixed patterns find e-mail and IP addresses, card and phone numbers. These, and
values that are assigned to one of :data:`SECRET_NAMES`, are the seeds of a bootstrap: the
words beside them and their shapes induce lexical patterns, a graph of patterns and
instances is scored in turns, and the patterns that prove reliable discover
identifiers of forms that no fixed pattern has.

Everything is a DataFrame expression. Regular expressions use possessive
quantifiers, so that they neither backtrack over long runs nor recurse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain_names, release, text_column, tied

MARK = "\u0001"
_STAND_IN = "\u0003"  # takes the place of a mark that a text has itself; no pattern matches either
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BLOCK = 256
BROADCAST_BYTES = 8 << 20  # discovered values up to this size are sent to every executor


@dataclass(frozen=True)
class Kind:
    """A kind of entity: what a text must hold, the pattern, and what a match must pass."""

    name: str
    hint: str
    pattern: str


#: The four kinds. A match can begin where the last one ended or where no
#: character of its first run stands before, which is where a plain search would begin it.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", "[0-9]\\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", "[0-9][0-9 -]{14}", r"[0-9](?:[ -]?[0-9])++"),
    Kind("phone", "\\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
)
#: What may be an identifier: number groups that spaces or signs divide, and words with a digit.
CANDIDATE = r"\+[0-9][ ().0-9-]+[0-9]|[0-9](?:[ -]?[0-9]){11,18}+(?![0-9])|(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9])[A-Za-z0-9@._%+-]++"
CANDIDATES = "seen"
#: Fixed values, the seed table: what a secret is called where it is assigned, also after a prefix such as ``my_``.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key", "access_key", "secret_key", "private_key")
_ASSIGNED = r"(?i)(?<![\p{L}\p{N}])(?:[\p{L}\p{N}]+[_-])*(?:" + "|".join(SECRET_NAMES) + r")[\"']?\s*(?::=|=>|[:=])\s*[\"']?$"
CONTEXT = 80  # characters on either side in which a value's words are looked for


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total: Column, k: Column) -> Column:
        digit = F.substr(digits, -k, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The check that a kind's matches must pass; a match that fails is dropped."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _running(sizes: Column) -> Column:
    """Sums of all elements before each element of an integer array, in blocks, so that long arrays stay cheap."""

    def scan(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n), lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1))

    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"))
    parts = F.transform(blocks, lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)))
    starts = scan(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n)), F.lit(0))
    return F.flatten(F.zip_with(parts, starts, scan))


def _cut(text: Column, pattern: str) -> Column:
    """The text in pieces: every second one is a match."""
    safe = F.translate(text, MARK, _STAND_IN)
    return F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _words_before(before: Column) -> Column:
    """The last word of what stands before, and the last two, in lower case and without the signs between; empty where there are none."""
    ends = r"(?:(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)[^\p{L}\p{N}_]++)?(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)[^\p{L}\p{N}_]*+$"
    near = F.right(before, F.lit(CONTEXT))
    one, other = F.lower(F.regexp_extract(near, ends, 2)), F.lower(F.regexp_extract(near, ends, 1))
    return F.struct(one.alias("left"), F.when(other != "", F.concat(other, F.lit(" "), one)).otherwise("").alias("left2"), near.rlike(_ASSIGNED).alias("assigned"))


def _word_after(after: Column) -> Column:
    return F.lower(F.regexp_extract(F.left(after, F.lit(CONTEXT)), r"^[^\p{L}\p{N}_]*+([\p{L}\p{N}_]++)", 1))


def _shape(value: Column) -> Column:
    """What a value with letters is made of, and its length; null for bare numbers, whose kinds have checks of their own."""
    kind = F.when(value.contains("@"), "mail").when(value.rlike("^[0-9a-fA-F]*[a-fA-F][0-9a-fA-F]*$"), "hex").when(value.rlike("^[0-9A-Za-z]*[A-Za-z][0-9A-Za-z]*$"), "letters").when(value.rlike("[A-Za-z]"), "mixed")
    return F.when(kind.isNotNull(), F.concat_ws(" ", F.lit("#"), kind, F.length(value).cast("string")))


def _with_spans(rows: DataFrame, min_digits: int) -> DataFrame:
    """``rows`` with a column of spans for each kind and for the candidates, and without its text.

    Cut texts and running lengths are columns of their own on the way: within a
    lambda they would be computed again for every match. A text without a kind's
    hint costs one look.
    """

    def candidate(m: Column) -> Column:
        return (F.length(_digits(m)) >= min_digits) | (m.contains("@") & m.rlike("[0-9]"))

    kinds = [(k.name, k.pattern, k.hint, lambda m, k=k: passes(k.name, m)) for k in KINDS] + [(CANDIDATES, CANDIDATE, "[0-9]", candidate)]
    text = F.col("__text")
    rest = [c for c in rows.columns if c != "__text"]
    cut = rows.select(*rest, *[F.when(text.rlike(hint), _cut(text, pattern)).alias(f"p_{n}") for n, pattern, hint, _ in kinds])
    placed = cut.select("*", *[_running(F.transform(f"p_{n}", F.length)).alias(f"s_{n}") for n, *_ in kinds])
    return placed.select(*rest, *[_spans(F.col(f"p_{n}"), F.col(f"s_{n}"), keep, context=n == CANDIDATES).alias(f"__{n}") for n, _, _, keep in kinds])


def _spans(parts: Column, starts: Column, keep, context: bool) -> Column:
    """``start`` and ``end`` (code points, end exclusive) of every second part that ``keep`` accepts; if asked for, its text and the words beside it."""
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("match"), F.element_at(starts, i + 1).alias("start")))
    found = F.filter(placed, lambda x: F.when(x["i"] % 2 == 1, keep(x["match"])).otherwise(False))

    def show(x: Column) -> Column:
        span = [x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end")]
        if context:
            span += [x["match"].alias("value"), _words_before(F.element_at(parts, x["i"])).alias("before"), _word_after(F.element_at(parts, x["i"] + 2)).alias("right")]
        return F.struct(*span)

    empty = "array<struct<start:int,end:int,value:string,before:struct<left:string,left2:string,assigned:boolean>,right:string>>" if context else "array<struct<start:int,end:int>>"
    return F.coalesce(F.transform(found, show), F.array().cast(empty))


def detect(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_digits: int = 5, min_support: int = 3, min_reliability: float = 0.6, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Spans of every row, and the identifiers that were discovered.

    The first table has ``id_col``, the row's number ``row``, and for each of
    :data:`KINDS` and for ``id`` (what the bootstrap discovered) an array of
    ``start, end``. The second has ``digest`` (SHA-256 of a text in which the
    bootstrap found something), ``value`` and ``reliability``.

    An instance is a text form with ``min_digits`` digits or an at sign. Its patterns are the
    word to its left, the two words there, the word to its right, both sides together, signs
    left out, and the shape of one with letters. Seeds are instances that one of :data:`KINDS` covers, and those that are
    assigned to a name of :data:`SECRET_NAMES`, as in ``token = "..."``; the latter count as discovered, wherever they stand. A
    pattern's reliability is the mean of its distinct instances'; one with fewer than
    ``min_support`` instances says nothing. A seed's reliability is 1. That of any other
    instance is the sum over its patterns that have ``min_support`` trusted instances,
    divided by the number of its patterns that say something, two at least. Trusted are the
    seeds and, from the second of ``rounds`` turns on, the instances that have reached
    ``min_reliability``, so that what was discovered supports patterns of its own.

    A null text counts as empty. One row comes out for each that goes in; other
    columns are not read. An empty table gives empty results.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.sha2(text_column(text_col), 256).alias("digest"), text_column(text_col).alias("__text"))
    found = materialize(_with_spans(rows, min_digits), "spans")

    base = F.concat(*[F.col(f"__{k.name}") for k in KINDS])
    each = found.where(F.size(f"__{CANDIDATES}") > 0).select("row", base.alias("base"), F.explode(f"__{CANDIDATES}").alias("s"), "digest")
    covered = F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    each = each.select("row", "digest", "s.start", "s.end", "s.value", "s.before", "s.right", covered.alias("covered"))
    assigned = ~F.col("covered") & F.col("before.assigned")
    each = each.withColumn("assigned", assigned).withColumn("seed", F.col("covered") | assigned)
    left, left2, right = F.col("before.left"), F.col("before.left2"), F.col("right")
    sides = [F.when(left != "", F.concat(F.lit("< "), left)), F.when(left2 != "", F.concat(F.lit("<< "), left2)), F.when(right != "", F.concat(F.lit("> "), right)), F.when((left != "") & (right != ""), F.concat_ws(" ", F.lit("<>"), left, right)), _shape(F.col("value"))]
    beside = F.explode(F.array_compact(F.array(*sides))).alias("pattern")
    edges = materialize(each.select("value", "seed", beside).groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    values = _score(edges, min_support, min_reliability, rounds)
    release(edges)
    given = each.where("assigned").select("value", F.lit(1.0).alias("reliability")).distinct()
    known = values.unionByName(given).groupBy("value").agg(F.max("reliability").alias("reliability"))
    hits = each.where(~F.col("covered")).join(known, "value")
    more = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__id"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = found.join(more, "row", "left").select("row", id_col, *[f"__{k.name}" for k in KINDS], F.coalesce("__id", none).alias("__id"))
    return tied(spans, found, values), tied(hits.select("digest", "value", "reliability").distinct(), found, values)


def discover(df: DataFrame, **options) -> DataFrame:
    """The second table of :func:`detect`, written down; nothing else stays in the work folder."""
    _, discovered = detect(df, **options)
    found = materialize(discovered, "discovered")
    release(discovered)
    return found


def _score(edges: DataFrame, min_support: int, min_reliability: float, rounds: int) -> DataFrame:
    """``value`` and ``reliability`` of the instances that were discovered, after some turns over the graph.

    Both sides are sums, made before they are shuffled, and both are written down
    before they are joined with the edges, so that a pattern or an instance with a
    third of all edges can be split.
    """
    if rounds < 1:
        raise ValueError("there must be one round at least")
    scored = edges.withColumn("r", F.col("seed").cast("double"))
    values = None
    for _ in range(rounds):
        trusted = F.count_if(F.col("seed") | (F.col("r") >= min_reliability))
        patterns = scored.groupBy("pattern").agg(F.avg("r").alias("p"), trusted.alias("trusted"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
        patterns = materialize(patterns.select("pattern", F.when(F.col("trusted") >= min_support, F.col("p")).otherwise(0.0).alias("p")), "patterns")
        size = patterns.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0
        on_edges = edges.where(~F.col("seed")).join(F.broadcast(patterns) if size <= BROADCAST_BYTES else patterns, "pattern")
        m = F.sum("p") / F.greatest(F.count(F.lit(1)), F.lit(2))
        before, values = values, materialize(on_edges.groupBy("value").agg(m.alias("m")).where("m > 0"), "values")
        release(patterns, *([before] if before is not None else []))
        scored = edges.join(values, "value", "left").select("pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("m", F.lit(0.0))).alias("r"))
    return tied(values.where(F.col("m") >= min_reliability).select("value", F.col("m").alias("reliability")), values)


def span_text(arrays: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` of all spans, by kind as given, then by start, joined by commas."""
    return F.array_join(F.concat(*[_named(kind, spans) for kind, spans in arrays]), ",")


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def mask(df: DataFrame, discovered: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with every entity in ``text_col`` replaced by its kind in brackets, ``[EMAIL]`` and so on.

    Masks what ``discovered`` (of :func:`detect`) has for a text, as ``[ID]``, then
    the fixed kinds in order. All other characters stay, nulls stay null, and every
    column is kept, whatever its name. Only texts in which something was discovered are joined by
    their digest; copies share it.
    """
    values = discovered.groupBy("digest").agg(F.collect_set("value").alias("__values")).withColumnRenamed("digest", "__digest")
    size = discovered.agg(F.sum(F.octet_length("value") + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else both sides are shuffled
        values = F.broadcast(values)
    kept = df.columns
    target = f"c{kept.index(text_col)}"
    digest = F.when(F.col(target).rlike("[0-9]"), F.sha2(target, 256))
    joined = plain_names(df).join(values, digest == F.col("__digest"), "left")
    cut = joined.withColumn("__parts", F.when(F.col("__values").isNotNull(), _cut(F.col(target), CANDIDATE)))
    shown = F.array_join(F.transform("__parts", lambda p, i: F.when((i % 2 == 1) & F.array_contains("__values", p), F.lit("[ID]")).otherwise(p)), "")
    text = F.coalesce(shown, F.col(target))
    for kind in KINDS:
        cut = cut.withColumn(target, text)
        text = _masked(F.col(target), kind)
    return cut.withColumn(target, text).select(*[f"c{i}" for i in range(len(kept))]).toDF(*kept)


def _masked(text: Column, kind: Kind) -> Column:
    shown = F.transform(_cut(text, kind.pattern), lambda p, i: F.when((i % 2 == 1) & passes(kind.name, p), F.lit(f"[{kind.name.upper()}]")).otherwise(p))
    return F.when(text.rlike(kind.hint), F.array_join(shown, "")).otherwise(text)
