import math
import re
import zlib

import pytest

from graphloom.llm import op03_urls as op
from tests.llm.helpers import write


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [r for r, _ in op.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len) if fits else None


def grams(text, mark):
    return [mark + text[i : i + n] for n in op.GRAM_SIZES for i in range(max(1, len(text) - n + 1))]


URLS = ["http://a.example.net/en/1", "https://EXAMPLE.net/de/x?q=http://b/", "http://net", "http://net/", "ftp://x.org/fr/#a", "http://org/fr", "http://nonet/", "no scheme", None, "", "http://free-casino-bets.example.com/win", "http://www.gardens.example.com/en/22", "http://a.example.com/de/3", "x://://y/z", "http://ÜBER.example.org/fr/ä", "://h/p", "http://h\n.net/x"]


def test_query_against_plain_python(spark, tmp_path):
    df = spark.createDataFrame([(k, u, "h", 1.0, "clash") for k, u in enumerate(URLS)] + [(0, URLS[0], "h", 1.0, "clash")], "page_id long, url string, html string, probability double, host string")
    got = op.op3_url_filter(spark, write(spark, tmp_path, pages=df)).collect()
    assert len(got) == len(URLS) + 1
    weights, bias = op.fit(spark.createDataFrame(op.labelled_urls(), "url string, label int"))
    for r in got:
        host, path = split(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == rule(host, path)
        g = grams(f"^{host}$", "h") + grams(re.sub("[1-9]", "0", path), "p")
        p = 1 / (1 + math.exp(-(sum(weights[zlib.crc32(x.encode()) % op.BINS] for x in g) + bias)))
        assert r["probability"] == pytest.approx(p), (r, len(g))
        assert r["verdict"] == (dict(op.RULES)[r["rule"]] if r["rule"] else "block" if p >= 0.5 else "allow")


def test_model_learns(spark):
    rows = spark.createDataFrame(op.labelled_urls(), "url string, label int")
    model = op.fit(rows)
    out = op.judge(rows, model, []).collect()
    assert all((r["verdict"] == "block") == bool(r["label"]) for r in out)
    new = op.judge(spark.createDataFrame([("http://m.casino-win.example.com/en/1",), ("http://cheap-pills.example.org/x",), ("https://www.weather.example.org/en/9",)], "url string"), model, []).collect()
    assert [r["verdict"] for r in new] == ["block", "block", "allow"]


def test_held_out_words_and_very_long_urls(spark):
    errors = op.held_out_errors(spark)
    assert errors["fitted"][0] <= 2 and errors["held out"][0] <= 0.35 * errors["held out"][1]
    long = "http://casino.example.com/" + "a/b-" * 50_000
    rows = op.judge(spark.createDataFrame([(1, long)], "page_id long, url string"), op.fit(spark.createDataFrame(op.labelled_urls(), "url string, label int")), op.RULES).collect()
    assert rows[0]["path"] == long[len("http://casino.example.com") :] and rows[0]["verdict"] in ("allow", "block")


def test_bound_on_labelled_rows_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/b", 1)] * 5, "url string, label int")
    with pytest.raises(ValueError):
        op.fit(rows, max_rows=4)
    assert op.fit(rows.limit(0)) == ([0.0] * op.BINS, 0.0)
    assert op.op3_url_filter(spark, write(spark, tmp_path, pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
