"""Small tables with the edge cases every operator must handle."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


def texts(seed=1):
    """id -> text: nulls, empty, blank, short, exact and near copies, shared passages, non-ASCII, one long text."""
    draw = random.Random(seed)
    passage, base = prose(draw, 60), prose(draw, 120)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    rows = [None, "", "   \n", "!!!", "one two", base, base, near, base + " tail", passage + " " + prose(draw, 40), prose(draw, 30) + " " + passage, passage, "é" * 150, "日本語テスト 🙂 " * 40, "ab" * 400, prose(draw, 3000), "one two", near]
    rows += [prose(draw, draw.randint(1, 80)) for _ in range(20)]
    return dict(enumerate(rows))


def frame(spark, rows, extra=True):
    """documents-like table; columns that clash with names used inside."""
    if extra:
        data = [(i, t, "x", "s", None if t is None else len(t), 1, "r", 2) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id int, rest string, kept int")
    return spark.createDataFrame(rows, "doc_id long, text string")
