"""URL grammar, hosts and the per-package URL features (hand-worked cases)."""

import re

from pyspark.sql import functions as F

from regscope import constants as C
from regscope.functions import urls as U
from regscope.operators.url_features import url_features

# The scanner's original alternation, kept here only to prove the single
# character class in constants.URL_FEATURE is equivalent.
ORIGINAL = r'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+'
SAMPLES = [
    "see http://bit.ly) and (http://bit.ly) then",
    "a https://a.b/c?d=1#frag b",
    'x "https://q.r/s" y',
    "u https://h:8080/p<q> v",
    "t https://é.com/x",
    "m https://x.y/a{b}c ~ d",
    "n http://[::1]/x o https://[bad/y",
    "w https://a.b/`c` http://x.y/!~",
    "",
]


def test_pattern_matches_original():
    for s in SAMPLES:
        assert re.findall(C.URL_FEATURE, s) == re.findall(ORIGINAL, s), s


def test_spark_extract_equals_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: list(r.u) for r in df.select("i", U.extract_urls(F.col("s")).alias("u")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == re.findall(ORIGINAL, s)


def test_netloc_domain(spark):
    rows = [("https://a.b.example.com:8080/x",), ("http://bit.ly)",), ("https://co.uk",), ("https://x?y",)]
    df = spark.createDataFrame(rows, "u string")
    got = [(r.h, r.d) for r in df.select(U.netloc(F.col("u")).alias("h"), U.url_domain(F.col("u")).alias("d")).collect()]
    assert got == [("a.b.example.com:8080", "example.com:8080"), ("bit.ly)", "bit.ly)"), ("co.uk", "co.uk"), ("x", "x")]


def test_url_features_hand_worked(spark):
    ranks = spark.createDataFrame([("example.com", 100000), ("bit.ly", 900)], "domain string, rank long")
    text = ("https://www.example.com/a https://www.example.com/a https://bit.ly/x "
            "https://hub.docker.com/r https://[bad/q")
    df = spark.createDataFrame([(1, text), (2, "no links")], "package_id long, text string")
    r = {x.package_id: x for x in url_features(df, ranks).collect()}
    # 5 URLs; '[bad' is unparseable (skipped for hosts) but counted; docker.com is internal.
    a = r[1]
    assert a.n_urls == 5 and a.n_external == 3 and a.n_short == 1 and a.n_hosts == 3 and a.n_dup_urls == 1
    assert abs(a.url_external - 3 / 6) < 1e-12 and abs(a.url_short - 1 / 6) < 1e-12
    assert abs(a.url_domains - 1 / 4) < 1e-12 and abs(a.url_dups - 1 / 2) < 1e-12
    assert abs(a.url_rank - (2 * 0.9 + 0.9991) / 4) < 1e-12
    b = r[2]
    assert (b.url_external, b.url_short, b.url_domains, b.url_rank, b.url_dups) == (0.0, 0.0, 1.0, 0.0, 1.0)


def test_audit_pattern_matches_python(spark):
    original = ORIGINAL + r"(?=[;().\s]|(?<=http))"
    samples = SAMPLES + ["end http://a.b/c;", "x http://a.b/http", "y (http://q.r/s) z", "http://nope"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: list(r.u) for r in df.select("i", U.extract_urls(F.col("s"), C.URL_AUDIT).alias("u")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == re.findall(original, s), s
