"""Small tables with the edges that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, part int"


def documents(spark, texts):
    """Documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 0.5, 3) for i, t in texts], SCHEMA)


WORDS = "the of and to in is that it was for on are as with they be at one have this from by hot word but what some we can out other were all there when up use your how said an each she".split()


def prose(n, seed=0):
    import random

    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c"), (5, prose(400)), (6, prose(400)), (7, "héllo ▁ wörld 日本 😀\u00a0x\r\n\n  y "), (8, "x" * 5000), (9, prose(30_000, 1))]
