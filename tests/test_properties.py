"""Property tests: random inputs, checked against the stated rules (one Spark job per example)."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sftlens.functions.mathnorm import normalize
from sftlens.functions.text import PY_WHITESPACE, is_blank, py_strip, whitespace_token_count
from sftlens.operators.stats import percentile_linear

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
ALPHABET = st.sampled_from(list(PY_WHITESPACE) + list("ab é∑😀​{}\\$/-.0123456789"))


@SETTINGS
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=40, max_size=40))
def test_strip_and_split_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(py_strip("t").alias("s"), whitespace_token_count("t").alias("n"), is_blank("t").alias("b")).collect()
    for t, r in zip(texts, got):
        assert (r["s"], r["n"], r["b"]) == (t.strip(), len(t.split()), not t.strip())


def _reference_rule(vals, p):
    s = sorted(vals)
    n = len(s)
    if n == 1:
        return float(s[0])
    k = (p / 100) * (n - 1)
    f = int(k)
    if f + 1 >= n:
        return float(s[-1])
    return s[f] + (s[f + 1] - s[f]) * (k - f)


@SETTINGS
@given(st.lists(st.lists(st.integers(0, 40000), min_size=1, max_size=60), min_size=5, max_size=5))
def test_percentiles_follow_the_linear_rule(spark, groups):
    rows = [(g, v) for g, vals in enumerate(groups) for v in vals]
    df = spark.createDataFrame(rows, "g int, v long")
    got = {r["g"]: r for r in percentile_linear(df, "v", [50, 90, 95], ["g"]).collect()}
    for g, vals in enumerate(groups):
        for p in (50, 90, 95):
            assert got[g][f"p{p}"] == _reference_rule(vals, p)
            assert int(got[g][f"p{p}"]) == int(_reference_rule(vals, p))


def _canonical_int(x: str) -> bool:
    try:
        return str(int(x)) == x
    except ValueError:
        return False


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["0", "1", "-3", "01", "+2", "-0", "12", "a", ""]),
                          st.sampled_from(["2", "0", "-7", "007", "b", "", "3/4"])), min_size=30, max_size=30))
def test_a_slash_b_only_for_canonical_integers(spark, pairs):
    texts = [f"{a}/{b}" for a, b in pairs]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in normalize(df, "t", "n").select("n").collect()]
    for (a, b), t, n in zip(pairs, texts, got):
        if t.count("/") == 1 and _canonical_int(a) and _canonical_int(b):
            assert n == "\\frac{%s}{%s}" % (a, b)
        else:
            assert n == t
