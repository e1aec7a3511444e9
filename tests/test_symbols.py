import pytest
from pyspark.sql import functions as F

from brute import letters, pattern_labels, patterns, series_rows
from motifline.functions.columns import breakpoints
from motifline.operators import symbols
from motifline.plans.blocks import with_position

K = ["k"]


def numbered(spark, values, labels=None):
    rows = [("s", i, float(v), (labels or [0] * len(values))[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, pos long, x double, label int").withColumn("n", F.lit(len(rows)).cast("long"))


def text(spark, values, size, alphabet):
    found = symbols.sax_letters(symbols.paa(numbered(spark, values), K, size), K, alphabet)
    return symbols.sax_string(found, K).first().symbols


def test_constant_series_takes_the_lower_middle_letter(spark):
    assert text(spark, [0.1] * 20, 5, 4) == "bbbb"
    assert text(spark, [0.1] * 20, 5, 3) == "bbbb"


def test_short_series_gives_one_mean_and_no_labels(spark):
    seg = symbols.paa(numbered(spark, [1, 2, 6], [1, 0, 0]), K, 5).collect()
    assert [(r.seg, r.paa, r.seg_label) for r in seg] == [(0, 3.0, None)]
    assert symbols.align_labels(numbered(spark, [1, 2, 6]), K, 5, 1).count() == 0


def test_remainder_is_dropped_and_size_one_changes_nothing(spark):
    seg = symbols.paa(numbered(spark, [1, 3, 5, 7, 100]), K, 2).orderBy("seg").collect()
    assert [r.paa for r in seg] == [2.0, 6.0]
    same = symbols.paa(numbered(spark, [1, 3, 5]), K, 1).orderBy("seg").collect()
    assert [r.paa for r in same] == [1.0, 3.0, 5.0]


def test_value_on_a_breakpoint_takes_the_lower_letter(spark):
    assert text(spark, [-1, 0, 1], 1, 2) == "aab"
    assert breakpoints(4)[1] == 0.0


@pytest.mark.parametrize("bad", [1, 27])
def test_alphabet_is_checked(spark, bad):
    with pytest.raises(ValueError):
        symbols.sax_letters(symbols.paa(numbered(spark, [1, 2]), K, 1), K, bad)


def test_window_is_checked(spark):
    found = symbols.sax_letters(symbols.paa(numbered(spark, [1, 2, 3]), K, 1), K, 4)
    with pytest.raises(ValueError):
        symbols.extract_patterns(found, K, 0)
    assert symbols.extract_patterns(found, K, 4).count() == 0
    assert symbols.extract_patterns(found, K, 3).count() == 1


@pytest.mark.parametrize("size,alphabet,window", [(5, 4, 3), (3, 6, 4), (1, 5, 6), (2, 3, 1)])
def test_chain_over_block_edges(spark, size, alphabet, window):
    rows = series_rows(3, {"a": 700, "b": 61, "c": 4})
    df = with_position(spark.createDataFrame(rows, "k string, t int, x double, label int"), K, ["t"])
    seg = symbols.paa(df, K, size)
    found = symbols.sax_letters(seg, K, alphabet, 60)
    pats = symbols.extract_patterns(found, K, window, 60).collect()
    labels = symbols.align_labels(df, K, size, window, 60).collect()
    steps = symbols.grams(seg, K, [3, alphabet], [window, window + 1], 60).where(
        f"alphabet_size = {alphabet} and window_size = {window}"
    ).dropDuplicates(["k", "seg"]).collect()
    for key in "abc":
        mine = sorted(r[1:] for r in rows if r[0] == key)
        expected = patterns(letters([r[1] for r in mine], size, alphabet), window)
        assert [r.pattern for r in sorted(pats, key=lambda r: r.seg) if r.k == key] == expected
        marks = pattern_labels([r[2] for r in mine], size, window)
        assert [r.label for r in sorted(labels, key=lambda r: r.seg) if r.k == key] == marks
        grams = [r for r in sorted(steps, key=lambda r: r.seg) if r.k == key]
        assert [r.gram for r in grams] == [(expected[i - 1][0] if i else "") + p for i, p in enumerate(expected)]
        assert [r.label for r in grams if r.label is not None] == marks


def test_z_normalize(spark):
    z = symbols.z_normalize(numbered(spark, [1, 2, 3, 4]), K).orderBy("pos").collect()
    assert [round(r.z, 6) for r in z] == [-1.341641, -0.447214, 0.447214, 1.341641]
    assert {r.z for r in symbols.z_normalize(numbered(spark, [2, 2]), K).collect()} == {0.0}
