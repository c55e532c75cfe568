from tidegraph.llm import html


def test_a_small_template_is_voted_in_on_a_large_host(spark):
    page = "<html><body><div class='{0}'>{1}</div><div class='{2}'>{3}</div></body></html>"
    rows = [(k, "http://big.org/", page.format("main", f"common {k} " * 20, "x", "y")) for k in range(600)]
    rows += [(1000 + k, "http://big.org/", page.format("rare", f"article {k} " * 20, "box", "short")) for k in range(4)]
    rows += [(1004, "http://big.org/", page.format("rare", "article 4", "box", "long advert " * 20))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 605 and got[1004] == "article 4" and got[1000] == ("article 0 " * 20).strip()
