import uuid

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import identity
from cairnlake.functions.urls import host_matches, normalize_url, normalized, registrable_domain


@pytest.mark.parametrize(
    "url, want",
    [
        (" HTTP://Www.A.Example:80#x ", "http://www.a.example/"), ("https://a.example:443/p?b=2&a=1#f", "https://a.example/p?b=2&a=1"),
        ("https://a.example:8443", "https://a.example:8443/"), ("ftp://a.example/", None), ("https://u:p@a.example/", None), ("https:///x", None),
        ("https://a..b/", None), ("https://bücher.example/ä", "https://xn--bcher-kva.example/ä"), ("http://[::1]:80/", "http://[::1]/"), ("http://[zz]/", None),
        ("http://a.example/\x07", None), ("http://a.example:99999/", None), ("", None), (None, None), ("http://-a.example/", None), ("http://" + "a" * 64 + ".example/", None),
    ],
)
def test_normalize(url, want):
    assert normalize_url(url) == want


def test_normalized_column(spark):
    df = spark.createDataFrame([("HTTP://A.example",), (None,), ("x",), ("HTTP://A.example",)], "u string")
    assert [r[0] for r in df.select(normalized("u")).collect()] == ["http://a.example/", None, None, "http://a.example/"]


def test_uuid5_is_pythons(spark):
    names = ["", "a", "v1:ü:3", "x" * 200]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(identity.uuid5(uuid.NAMESPACE_URL, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_link_id_is_canonical_json(spark):
    df = spark.createDataFrame([('a"\\ü', "b")], "s string, t string")
    got = df.select(identity.link_id(F.col("s"), F.col("t"))).first()[0]
    assert got == str(uuid.uuid5(identity.LINK_SPACE, "v1:" + identity.canonical_json(['a"\\ü', "b"])))


def test_hosts(spark):
    df = spark.createDataFrame([("a.example",), ("b.a.example",), (None,)], "h string")
    match = lambda p: [r[0] for r in df.select(host_matches(F.col("h"), p)).collect()]
    assert match("*.a.example")[:2] == [False, True] and match("a.example")[:2] == [True, False] and match("*") == [True, True, False]
    assert (registrable_domain("x.y.co.uk"), registrable_domain("a.b.example"), registrable_domain("1.2.3.4")) == ("y.co.uk", "b.example", "1.2.3.4")
