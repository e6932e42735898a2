import pytest

from quillwork.sources import web


def test_sitemaps_nested_deeper_than_ten(spark):
    index = "<sitemapindex><sitemap><loc>{}</loc></sitemap><sitemap><loc>m0</loc></sitemap></sitemapindex>"
    docs = [(f"m{i}", index.format(f"m{i + 1}")) for i in range(13)] + [("m13", "<urlset><url><loc>page</loc></url></urlset>")]
    df = spark.createDataFrame(docs, "url string, xml string")
    assert [r["loc"] for r in web.expand_sitemaps(df, ["m0"]).collect()] == ["page"]
    with pytest.raises(RuntimeError):
        web.expand_sitemaps(df, ["m0"], max_depth=5)
