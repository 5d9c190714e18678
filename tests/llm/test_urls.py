from dunlin.llm.urls import RULES, filter_urls


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)


def test_rules_and_parts(spark):
    urls = {
        1: "https://WWW.Shop.COM/en/7?x#y",
        2: "http://example.com/en/7",
        3: "http://a.example.com/en/8",
        4: "http://b.net/de/",
        5: "http://x.example.net/de/8",
        6: "http://b.org/es",
        7: None,
        8: "no scheme/en/",
        9: "ftp://h.com?en/",
        10: "http://notcom/en/",
        11: "http://Ünï.org/es/é#f",
    }
    df = spark.createDataFrame([(k, u, "") for k, u in urls.items()], "page_id long, url string, html string")
    out = {r.page_id: r for r in filter_urls(df).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("www.shop.com", "/en/7", "com/en/", "block")
    assert (out[2].rule, out[2].verdict) == ("example.com/en/7", "allow")
    assert (out[3].rule, out[3].verdict) == ("com/en/", "block")
    assert (out[4].rule, out[4].verdict) == ("net/de/", "allow")
    assert (out[5].rule, out[5].verdict) == ("example.net/de/8", "block")
    assert (out[6].rule, out[6].path) == (None, "/es")
    assert (out[7].host, out[7].path, out[7].rule, out[7].verdict) == ("", "", None, "allow")
    assert (out[8].host, out[8].path) == ("", "")
    assert (out[9].host, out[9].path) == ("h.com", "")
    assert out[10].rule is None
    assert out[11].host == "Ünï.org" and out[11].rule == "org/es/"
    assert len(RULES) == 5


def test_trust_and_distrust_flow(spark):
    rows = [
        (1, "http://good.net/de/1", link("friend.xyz")),
        (2, "http://friend.xyz/", link("far.xyz")),
        (3, "http://far.xyz/", ""),
        (4, "http://farm.xyz/", link("bad.com", "bad.com")),
        (5, "http://bad.com/en/1", link("good.net")),
        (6, "http://alone.xyz/", None),
        (6, "http://alone.xyz/", None),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    out = filter_urls(df.select("page_id", "url", "html")).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == 7
    assert by[2].trust > by[3].trust > 0 and by[2].verdict == "allow"
    assert by[4].distrust > 0 and by[4].verdict == "block"
    assert by[6].verdict == "allow" and by[6].trust == by[6].distrust == 0


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_verdict_depends_on_neither_size_nor_distance(spark):
    from pyspark.sql import functions as F

    big = spark.range(400_000).select((F.col("id") + 100).alias("page_id"), F.concat(F.when(F.col("id") == 0, "http://big.com/en/").otherwise("http://big.com/x"), F.col("id").cast("string")).alias("url"), F.lit("").alias("html"))
    chain = [(k, f"http://h{k}.xyz/", link(f"h{k + 1}.xyz" if k < 8 else "bad.com")) for k in range(9)] + [(9, "http://bad.com/en/1", "")]
    out = filter_urls(big.union(spark.createDataFrame(chain, big.schema)))
    assert out.where("host = 'big.com' and verdict = 'allow'").isEmpty() and out.where("host = 'big.com'").count() == 400_000
    by = {r.page_id: r for r in out.where("page_id < 100").collect()}
    assert {by[k].verdict for k in range(10)} == {"block"}
    assert [by[k].distrust for k in (0, 8, 9)] == [round(0.15 * 0.85**9, 6), round(0.15 * 0.85, 6), 0.15]
