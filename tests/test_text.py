"""Normalisation, tokens and strata against plain Python."""

import unicodedata

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from gleaner.functions import normalize as n
from gleaner.functions import tokens as t
from gleaner.functions.stopwords import PORTUGUESE
from gleaner.operators import strata, text

# Examples of technical texts.
EXAMPLES = ["Parafuso 6,5 mm × 50 mm", "Cabo de força 220 V", "Motor 1.5 HP", "DN 50", "Aço inoxidável – resistente à corrosão", "Registro ¾ rosca 3 / 4", "Joelho ½", "3½ 1 x 2 x 3", "Straße 1,2,3", "", None, "  \t\n", "fim: [a] (b)* \"c\"", "cano ⅓ e ⅛ pol", "ac\u0327o ﬁo ＤＮ 10㎜ 5㎏", "ΣΑΣ ǆ ŉ İ ſ", "a\u2028b\x85c"]


def plain(value):
    """The steps in plain Python."""
    s = "".join(c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c))
    s = s.casefold().translate(str.maketrans("×X–—", "xx--")).replace("⁄", "/")
    s = regex.sub(r"(?<=\d)\s*/\s*(?=\d)", "/", s)
    s = regex.sub(r"(?<=\d),(?=\d)", ".", s)
    s = regex.sub(r'[^\w\s./"-]+', " ", s)
    s = regex.sub(r"(\d)\s*x\s*(\d)", r"\1x\2", s)
    s = regex.sub(r"(\d)\s*(mm|cm|m|v|w|kw|kva|hp)\b", r"\1\2", s)
    s = regex.sub(r"\b(dn)\s*(\d)", r"\1\2", s)
    return " ".join(w for w in s.split() if w not in set(PORTUGUESE))


def test_normalize(spark):
    df = spark.createDataFrame([(x,) for x in EXAMPLES], "t string")
    assert [r[0] for r in df.select(n.normalize(F.col("t"))).collect()] == [plain(x) for x in EXAMPLES]


def test_accents_case_and_blanks_of_every_script(spark):
    """The basic plane and two more, where both libraries know the character alike."""
    known = [chr(i) for i in range(0x20, 0x2FA20) if unicodedata.category(chr(i)) not in ("Cs", "Cn")]
    new = {0x1C89, 0xA7CB, 0xA7DA, 0xA7DC}  # younger than this Python's tables
    df = spark.createDataFrame([(f"{c}a{c}",) for c in known if ord(c) not in new], "t string")
    for t, accents, case, blanks, words in df.select("t", n.strip_accents(F.col("t")), n.fold_case(F.col("t")), n.single_blanks(F.col("t")), n.words(F.col("t"))).collect():
        assert accents == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), ascii(t)
        assert case == t.casefold() and blanks == regex.sub(r"\s+", " ", t).strip() and words == t.split(), ascii(t)


def test_fraction_step_alone(spark):
    df = spark.createDataFrame([("".join(n.FRACTIONS) + " 3 ⁄ 4 1\u2003/ 2 X×–—",), (None,)], "t string")
    got = df.select(n.unify_fractions(F.col("t")), n.unify_symbols(F.col("t"))).first()
    assert got[0] == "".join(n.FRACTIONS.values()) + " 3/4 1/2 X×–—" and got[1].endswith(" xx--") and len(n.FRACTIONS) == 18
    assert all(unicodedata.normalize("NFKD", c).replace("⁄", "/") == x for c, x in n.FRACTIONS.items())


def test_report_names_changes_only(spark):
    row = spark.createDataFrame([("6,5 mm DE aço",)], "t string").select(n.normalize_report(F.col("t")).alias("r")).first()["r"]
    assert row["normalized"] == "6.5mm aco" and row["raw"] == "6,5 mm DE aço"
    assert [c["step"] for c in row["changes"]] == ["strip_accents", "normalize_case", "normalize_decimal_comma", "normalize_technical_spacing", "remove_stopwords"]
    for a, b in zip(row["changes"], row["changes"][1:]):
        assert a["after"] == b["before"]


def test_removed_tokens_are_a_multiset(spark):
    df = spark.createDataFrame([(1, "a b a c b a", "a b"), (2, "x", "x"), (3, None, "y")], "k long, before string, after string")
    assert [r[0] for r in df.orderBy("k").select(n.removed_tokens(F.coalesce("before", F.lit("")), F.col("after"))).collect()] == [["a", "c", "b", "a"], [], []]
    assert {r["k"]: r["removed"] for r in text.removed_tokens_table(df, "k").collect()} == {1: ["a", "c", "b", "a"], 2: [], 3: []}


def test_removed_tokens_stay_in_their_row(spark):
    """Rows that share a key keep their own tokens, blanks of every script part tokens, and nothing is shuffled."""
    df = spark.createDataFrame([(1, "a\u2003b\x1ca", "a"), (1, "a", None), (None, "c", "")], "k long, before string, after string")
    got = text.removed_tokens_table(df, "k")
    assert sorted(map(str, got.collect())) == sorted(["Row(k=1, removed=['b', 'a'])", "Row(k=1, removed=['a'])", "Row(k=None, removed=['c'])"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_words_of_long_texts_are_fast(spark):
    """Against a pattern of plain blanks over the same 40 million characters."""
    import time
    df = spark.range(400).select(F.repeat(F.concat_ws(" ", F.lit("palavra"), F.col("id").cast("string"), F.lit("é")), 8_000).alias("t"))

    def took(c):
        began = time.perf_counter()
        df.agg(F.sum(F.size(c))).collect()
        return time.perf_counter() - began

    plain = [took(F.regexp_extract_all("t", F.lit(r"\S+"), 0)) for _ in range(3)]
    assert took(n.words(F.col("t"))) < 5 * min(plain) + 1


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (["a", "a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(t.jaccard(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 1, 0, 1])


def test_jaccard_of_distinct_tokens(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(t.jaccard_distinct(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 1, 0, 1])


def test_extremes_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(20).selectExpr("id as k", "cast(id % 7 as double) as v").mapInArrow(counted, "k long, v double")
    got = sorted((r["side"], r["v"], r["k"]) for r in strata.extremes(rows, "v", 2, "k").collect())
    assert got == [("high", 6.0, 6), ("high", 6.0, 13), ("low", 0.0, 0), ("low", 0.0, 7)] and made.value == 20


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("7.0", "x [tag 12]", ""), (" 7 ", "none", None), ("abc", None, "z")], "a string, b string, c string")
    rows = df.select(t.safe_id(F.col("a")), t.tagged_id(F.col("b"), "tag"), t.first_filled(F.col("c"), F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(None, 12, "7.0"), (7, None, " 7 "), (None, None, "z")]
    grams = spark.createDataFrame([(["a", "b", "c"],), ([],), (["a"],)], "t array<string>").select(t.ngrams(F.col("t"), 2), t.ngrams(F.col("t"), 3)).collect()
    assert [list(r) for r in grams] == [[["a b", "b c"], ["a b c"]], [[], []], [[], []]]
    kept = spark.createDataFrame([("Tubo de PVC 3/4 x 25 para agua",)], "t string").select(t.preprocess_topics(F.col("t"))).first()[0]
    assert kept == "tubo pvc agua"
    assert spark.createDataFrame([("Olá, mundo!",)], "t string").select(t.punctuated_tokens(F.col("t"))).first()[0] == ["olá", ",", "mundo", "!"]


def test_quantile_bins_like_qcut(spark):
    draw = np.random.default_rng(3)
    values = np.round(draw.random(200) * 10) / 10
    got = strata.quantile_bins(spark.createDataFrame(pd.DataFrame({"v": values})), "v").toPandas()
    want = pd.qcut(values, 4, labels=False, duplicates="drop") + 1
    assert sorted(zip(got["v"], got["bin"])) == sorted(zip(values, want))


def test_median_split_puts_equals_above(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3)], "jaccard double")
    assert sorted((r["jaccard"], r["half"]) for r in strata.median_split(df).collect()) == [(1.0, "lower"), (2.0, "upper"), (2.0, "upper"), (3.0, "upper")]


def test_spearman_and_ecdf(spark):
    draw = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": np.round(draw.random(60), 1), "b": np.round(draw.random(60), 1)})
    got = strata.spearman(spark.createDataFrame(pdf), "a", "b").first()["spearman"]
    assert got == pytest.approx(np.corrcoef(pdf["a"].rank(), pdf["b"].rank())[0, 1])
    steps = strata.ecdf(spark.createDataFrame(pdf), "a").orderBy("share").collect()
    assert [r["value"] for r in steps] == sorted(pdf["a"]) and steps[-1]["share"] == 1.0


def test_histogram_and_extremes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "k long, v double")
    assert sorted((r["bin"], r["count"]) for r in strata.histogram(df, "v", 5).collect()) == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 3)]
    rows = strata.extremes(df, "v", 2, "k").collect()
    assert sorted((r["side"], r["k"]) for r in rows) == [("high", 9), ("high", 10), ("low", 0), ("low", 1)]
