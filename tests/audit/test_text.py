import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lensaudit.functions import numbers, text, urls
from lensaudit.operators import chunking, judging, questions


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).collect()[0]


def test_similarity_of_empty_texts(spark):
    j = lambda a, b: text.jaccard(text.tokens(F.lit(a)), text.tokens(F.lit(b)))
    assert tuple(one(spark, j("", " "), j("a", ""), j("A b\tc", "b C d"), j("x", "x"))) == (1.0, 0.0, 0.5, 1.0)


def test_span_by_its_first_words(spark):
    span = " ".join(f"w{i}" for i in range(40))
    hay = "x  " + " ".join(f"W{i}" for i in range(12)) + " other"
    assert tuple(one(spark, text.span_in(F.lit(span), F.lit(hay)), text.span_in(F.lit(""), F.lit(hay)), text.span_in(F.lit("w3 w5"), F.lit(hay)), text.span_in(F.lit(None).cast("string"), F.lit(hay)))) == (True, False, False, False)


def test_intervals_and_buckets(spark):
    lo, hi = numbers.ci95(F.lit(0.6), F.lit(50))
    zero = numbers.ci95(F.lit(0.0), F.lit(0))
    row = one(spark, hi - lo, *zero, numbers.bucket(F.lit(7), [(5, "a"), (6, "b")]))
    assert round(row[0] * 50) == 14 and tuple(row)[1:] == (0.0, 0.0, "b")


@pytest.mark.parametrize("digits", [4, 5])
def test_ratios_between_two_steps_are_rounded_as_in_sql(spark, digits):
    n = 2 * 10**digits
    got = spark.range(1, n, 2).select(numbers.share(F.col("id"), F.lit(n), digits)).toArrow()[0].to_pylist()
    assert got == [r[0] for r in duckdb.execute(f"SELECT round(i / {n}, {digits}) FROM range(1, {n}, 2) t(i) ORDER BY i").fetchall()]
    assert one(spark, numbers.share(F.lit(1), F.lit(0)), numbers.share(F.lit(995), F.lit(1600), 5)) == (None, 0.62187)


@pytest.mark.parametrize(("url", "want"), [(" a.net/x ", "https://a.net/x"), ("http://b", "http://b"), ("ftp://c", None), ("https://", None)])
def test_normal_urls(spark, url, want):
    assert one(spark, urls.normalize(F.lit(url)))[0] == want


@pytest.mark.parametrize(("path", "role"), [("/docs/faq", "docs"), ("/help", "faq"), ("/shop", "product"), ("/blog/x", "article"), ("/team", "about"), ("/", "home"), ("", "home"), ("/x", "article")])
def test_roles_by_path(spark, path, role):
    assert one(spark, urls.role(F.lit(path), F.lit(None).cast("string"), F.array().cast("array<string>")))[0] == role


def test_addresses(spark):
    ips = {"10.1.2.3": True, "8.8.8.8": False, "169.254.169.254": True, "172.32.0.1": False, "nonsense": True, "1.2.3.999": True}
    assert list(one(spark, *(urls.blocked_address(F.lit(i)) for i in ips))) == list(ips.values())


def test_chunks_follow_headings_and_overlap():
    md = "# A\none\n\ntwo\n## B\n" + "x" * 40 + "\n# C\n" + "y. " * 30
    got = chunking.chunk_text(md, target=10, overlap=50)
    assert [c["heading_path"] for c in got[:2]] == ["A", "A > B"] and got[0]["text"] == "one\ntwo"
    assert got[1]["text"].startswith("one\ntwo") is (chunking.size("one\ntwo") <= 6)
    assert all(c["tokens"] <= 12 + 6 for c in got) and chunking.chunk_text(" \n") == [] and chunking.chunk_text(None) == []


@settings(max_examples=50)
@given(st.text(alphabet="ab #.\n", max_size=300), st.integers(5, 40))
def test_no_word_is_lost_without_overlap(s, target):
    words = lambda t: [w for line in t.splitlines() if not line.strip().startswith("#") for w in line.split()]
    joined = " ".join(c["text"] for c in chunking.chunk_text(s, target, 0))
    assert words(s) == joined.split() or "#" in joined


def test_answers_and_verdicts(spark):
    a = judging.parse_answer(F.lit('Answer: "42"\nUsed: [1]'))
    v = lambda raw, gone=False: judging.parse_verdict(F.lit(raw), F.lit(gone))
    row = one(spark, a["answer"], a["quoted"], judging.parse_answer(F.lit("so NOT_found"))["abstained"], v('{"verdict":"correct"}'), v("x {\"verdict\": \"Partially Correct\"} y"), v("incorrect!"), v("?"), v("?", True))
    assert tuple(row) == ("42", "[1]", True, "correct", "partially_correct", "incorrect", "incorrect", "abstained")


def test_generated_questions_recovered_from_prose(spark):
    raw = 'Sure: {"questions": [{"question": "q one?", "reference_answer": "a"}]} bye'
    row = one(spark, questions.parse_generated(F.lit(raw))[0]["question"], questions.parse_generated(F.lit("no json")))
    assert tuple(row) == ("q one?", None)


def test_white_space_of_any_script(spark):
    nbsp, em = "a\u00a0b c", "\u2003x\t\n"
    assert sorted(one(spark, text.tokens(F.lit(nbsp)))[0]) == ["a", "b", "c"] and one(spark, text.strip(F.lit(em)))[0] == "x"
    assert one(spark, urls.normalize(F.lit("\ta.net\n")))[0] == "https://a.net"
