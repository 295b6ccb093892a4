"""The mixer and the counts of language-model scoring."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolith.llm import scoring

from .helpers import documents, prose


def lesson_of(symbols, slots, tables, mixer):
    lesson = scoring.Lesson(mixer)
    lesson.symbols(tables, slots, symbols)
    return lesson


def test_few_symbols_teach_all_bits():
    symbols = np.random.default_rng(1).integers(0, 256, 5000)
    slots = [np.zeros(5000, np.int64), symbols % 7]
    tables = [scoring.BitTable(np.bincount(s * 256 + symbols, minlength=n * 256)) for s, n in zip(slots, (1, 7))]
    lesson = lesson_of(symbols, slots, tables, scoring.Mixer.fresh(2))
    assert (lesson.seen.sum((1, 2)) == 5000).all()
    assert all((lesson.slopes[bit] != 0).any() for bit in range(8))


def test_lessons_are_sums_and_lower_the_cost():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 40, 20_000)
    slots = [np.zeros(len(symbols), np.int64), symbols % 5]
    tables = [scoring.BitTable(np.bincount(s * 256 + symbols, minlength=n * 256)) for s, n in zip(slots, (1, 5))]
    mixer = scoring.Mixer.fresh(2)
    whole = lesson_of(symbols, slots, tables, mixer)
    parts = [lesson_of(symbols[i::3], [s[i::3] for s in slots], tables, mixer) for i in range(3)]
    assert np.allclose(whole.curves, sum(p.curves for p in parts)) and np.allclose(whole.slopes, sum(p.slopes for p in parts))
    sums = {f"x-{k}": np.rint(v * (scoring._SCALE if k != "seen" else 1)).ravel() for k, v in (("slopes", whole.slopes), ("curves", whole.curves), ("seen", whole.seen))}
    after = scoring.Lesson.apply(mixer, sums, "x")
    assert after.costs(tables, slots, symbols).sum() < mixer.costs(tables, slots, symbols).sum()


def test_bits_of_all_symbols_are_a_distribution():
    rng = np.random.default_rng(0)
    tables = [scoring.BitTable(rng.integers(0, 50, n * 256)) for n in (1, 4)]
    mixer = scoring.Mixer(rng.normal(0, 0.5, (8, 4, 3)).astype(np.float32), scoring._corrections(rng.integers(0, 50, (8, 33, 2))))
    bits = mixer.costs(tables, [np.zeros(256, np.int64), np.full(256, 3)], np.arange(256))
    assert np.isclose(np.exp2(-bits.astype(float)).sum(), 1, atol=1e-4)


def test_keys_travel_and_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (scoring._unpack_keys(scoring._pack_keys(keys), n) == keys).all()
    keys = rng.integers(0, 9, 100).astype(np.uint64)
    found = scoring.Distinct(keys)
    expected = Counter(keys.tolist())
    assert found.back(found.sums(np.ones(100, np.int64))).tolist() == [expected[k] for k in keys.tolist()]


TEXTS = [(i, prose(30 + 7 * (i % 9), i % 25)) for i in range(60)] + [(60, None), (61, ""), (62, "unseen zyx words")]


def test_counts_equal_plain_ones(spark):
    """Each token's counts after one and after two words, over all training texts, in several chunks."""
    df = documents(spark, TEXTS).repartition(5)
    chunks = scoring.chunk_table(df, id_col="doc_id", text_col="text", held_out=F.col("doc_id") % 7 == 2)
    rows = scoring.with_counts(chunks, scoring.corpus_counts(chunks)).where("ids is not null").toArrow().to_batches()
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in TEXTS}
    own = [[(b"", b"", *w)[k : k + 3] for k in range(len(w))] for i, w in tokens.items() if i % 7 != 2]
    one, two, words = Counter(x[1:] for w in own for x in w), Counter(x for w in own for x in w), Counter(x[2] for w in own for x in w)
    seen = set()
    for batch in rows:
        for row, ends, held in scoring._read(batch):
            chunk, c, after, _, _ = scoring._counted(row, ends, held)
            facts = scoring.Facts(chunk, c, after, False)
            for n, i in enumerate(row.column("ids")[0].as_py()):
                seen.add(i)
                w = (b"", b"", *tokens[i])
                for k in range(len(tokens[i])):
                    at = chunk.starts[n] + k
                    assert (facts.c0[at], facts.c1[at], facts.c2[at]) == (words[w[k + 2]], one[w[k + 1 : k + 3]], two[w[k : k + 3]])
                    starts = sum(x[:2] == w[k : k + 2] for own_ in own for x in own_)
                    assert facts.n2[at] == starts and facts.n1[at] == sum(x[1] == w[k + 1] for own_ in own for x in own_)
    assert seen == set(tokens)


def test_scores_do_not_depend_on_layout(spark):
    df = documents(spark, TEXTS)
    one, many = ({r.doc_id: r for r in scoring.score_texts(d, held_out=F.col("doc_id") % 7 == 2).collect()} for d in (df.coalesce(1), df.repartition(6)))
    for i, a in one.items():
        assert many[i].score == pytest.approx(a.score, rel=1e-3) and (a.bits_per_byte is None or many[i].bits_per_byte == pytest.approx(a.bits_per_byte, rel=1e-3))
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_next_words_sum_to_one_at_most(spark):
    """A text of one word is that word and then an end; over all words, known or not, their probabilities may not pass one."""
    words = sorted({w for _, t in TEXTS for w in (t or "").lower().split()})
    asked = [(1000 + i, w) for i, w in enumerate(words)]
    rows = scoring.score_texts(documents(spark, TEXTS + asked), held_out=F.col("doc_id") >= 1000).collect()
    assert math.fsum(10**r.score for r in rows if r.doc_id >= 1000) <= 1
