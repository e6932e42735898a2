"""Sources and sinks (SRC, SNK): round trips through files and pages made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reserve
from ..sources import html, tables, web
from .registry import Plan

plan = Plan()
q = plan.add


def _string(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@q("src_01_csv_rows", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def src_01(t):
    path = reserve(t.spark, "csv")
    tables.write_csv(t.nation, path, ["n_nationkey", "n_name", "n_regionkey"])
    return tables.read_csv(t.spark, path, _string("n_nationkey", "n_name", "n_regionkey"))


@q("src_02_csv_typed_pruned", "SELECT s_suppkey, s_acctbal FROM supplier")
def src_02(t):
    path = reserve(t.spark, "csv")
    tables.write_csv(t.supplier, path, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType())])
    return tables.read_csv(t.spark, path, schema).select("s_suppkey", "s_acctbal")


@q("src_04_sql_to_frame", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def src_04(t):
    return t.spark.sql("SELECT r_name, count(*) AS n FROM {n} JOIN {r} ON n_regionkey = r_regionkey GROUP BY r_name", n=t.nation, r=t.region)


@q("src_05_json_cache_typing", "SELECT record_id, CASE WHEN status >= 500 THEN 'fetch_error' WHEN status = 404 OR len(coalesce(cids, [])) = 0 THEN 'no_match' WHEN len(cids) = 1 THEN 'exact_match' ELSE 'multiple_matches' END AS match_type FROM names")
def src_05(t):
    path = reserve(t.spark, "json")
    t.names.select("record_id", "name", "status", "cids").write.json(path)
    schema = T.StructType([T.StructField("record_id", T.LongType()), *tables.NAME_RECORD.fields])
    return t.spark.read.schema(schema).json(path).select("record_id", tables.match_type(F.col("status"), F.col("cids")).alias("match_type"))


@q("src_06_json_required_keys", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS complete FROM events")
def src_06(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("complete"))


@q("src_07_json_alternates", "SELECT inchikey_connectivity, coalesce(nullif(smiles_standardized, ''), nullif(smiles_flat, '')) AS structure FROM compounds_unique")
def src_07(t):
    doc = F.to_json(F.struct(F.col("smiles_standardized").alias("a"), F.col("smiles_flat").alias("b")))
    back = t.compounds_unique.select("inchikey_connectivity", doc.alias("j"))
    return back.select("inchikey_connectivity", F.coalesce(F.nullif(F.get_json_object("j", "$.a"), F.lit("")), F.nullif(F.get_json_object("j", "$.b"), F.lit(""))).alias("structure"))


@q("src_11_content_address", "SELECT plant_index, substring(sha256(source_page_url), 1, 24) AS cache_key FROM plant_index")
def src_11(t):
    return t.plant_index.select("plant_index", web.cache_key(F.col("source_page_url")).alias("cache_key"))


def _maps(t):
    pages = t.plant_index.select("source_page_url").distinct().withColumn("shard", F.pmod(F.length("source_page_url"), F.lit(3)))
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.col("source_page_url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    leaf = pages.groupBy("shard").agg(F.concat(F.lit('<urlset xmlns="http://x.example/ns">'), F.array_join(F.array_sort(F.collect_list(loc)), ""), F.lit("</urlset>")).alias("xml")).select(F.format_string("m%d.xml", F.col("shard").cast("int")).alias("url"), "xml")
    # an index that lists the leaves and, in a circle, itself
    root = leaf.agg(F.concat(F.lit("<sitemapindex><sitemap><loc>root.xml</loc></sitemap>"), F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    return leaf.unionByName(root.select(F.lit("root.xml").alias("url"), "xml"))


@q("src_13_sitemap_parse", "SELECT DISTINCT 'urlset' AS kind, source_page_url AS loc FROM plant_index")
def src_13(t):
    return web.sitemap_urls(_maps(t)).filter("kind = 'urlset'").select("kind", "loc")


@q("src_14_sitemap_expand", "SELECT DISTINCT source_page_url AS loc FROM plant_index")
def src_14(t):
    return web.expand_sitemaps(_maps(t), ["root.xml"])


def _escaped(c):
    x = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _pages(t, headers=("Scientific name", "Synonym", "Family:")):
    """One list page for each page number, with a table of its plants; sized by the page, not the table."""
    row = F.concat(F.lit("<tr><td>"), F.col("plant_index").cast("string"), *(x for c in ("scientific_name", "synonym", "family") for x in (F.lit("<td>"), _escaped(c), F.lit("</td>"))), F.lit("</tr>\n"))
    head = "<html><body><table><tr><th>No</th>" + "".join(f"<th> {h} </th>" for h in headers) + "</tr>"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plant_index", row.alias("r")))), lambda s: s["r"]), "")
    foot = F.concat(F.lit('</table><a rel="next" href="?page='), (F.col("page_number") + 1).cast("string"), F.lit('">next</a><a href="/plants?page=99">last</a></body></html>'))
    return t.plant_index.groupBy("page_number").agg(rows.alias("rows")).select("page_number", F.concat(F.lit(head), "rows", foot).alias("html"))


_TEXT = r"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{00A0}}]+', ' ', 'g'))"
_RULES = {"plant_index": "^no$", "scientific_name": "scientific", "synonym": "synonym", "family": "family"}


@q("src_15_tables_by_header", "SELECT page_number, 1 AS n_tables, count(*) AS n_rows FROM plant_index GROUP BY 1")
def src_15(t):
    r = html.records(_pages(t), "html", ["page_number"], _RULES)
    return r.groupBy("page_number").agg(F.countDistinct("table").cast("int").alias("n_tables"), F.count(F.lit(1)).alias("n_rows"))


@q("src_16_table_records", f"SELECT page_number, plant_index::VARCHAR AS plant_index, {_TEXT.format(c='scientific_name')} AS scientific_name, {_TEXT.format(c='synonym')} AS synonym, {_TEXT.format(c='family')} AS family FROM plant_index")
def src_16(t):
    return html.records(_pages(t), "html", ["page_number"], _RULES).select("page_number", *_RULES)


@q("src_17_positional_fallback", f"SELECT page_number, plant_index::VARCHAR AS plant_index, {_TEXT.format(c='scientific_name')} AS scientific_name FROM plant_index")
def src_17(t):
    pages = _pages(t, ("A", "B", "C"))
    return html.records(pages, "html", ["page_number"], _RULES, ["plant_index", "scientific_name", "synonym", "family"]).select("page_number", "plant_index", "scientific_name")


@q("src_18_label_value_page", f"SELECT plant_index, {_TEXT.format(c='scientific_name')} AS scientific_name, {_TEXT.format(c='family')} AS family FROM plant_index")
def src_18(t):
    page = F.concat(F.lit("<table><tr><td>Scientific Name :</td><td>"), _escaped("scientific_name"), F.lit("</td></tr><tr><th>Family</th><td>"), _escaped("family"), F.lit("</td></tr></table>"))
    return html.labelled(t.plant_index.select("plant_index", page.alias("html")), "html", ["plant_index"], ["Scientific Name", "Family"])


@q("src_19_pagination", "SELECT DISTINCT page_number, page_number + 1 AS next, 99 AS last FROM plant_index")
def src_19(t):
    p = _pages(t).select("page_number", html.pagination(F.col("html")).alias("p"))
    return p.select("page_number", "p.next", "p.last")


_XYZ = "floor(embedding[{i}]::DOUBLE * 1000) / 100"


def _pdb(t):
    xyz = [F.format_string("%8.3f", F.floor(F.element_at("embedding", i).cast("double") * 1000) / 100) for i in (1, 2, 3)]
    line = F.concat(F.lit("ATOM  "), F.lpad(F.col("vec_id").cast("string"), 5, " "), F.lit("  CA  ALA A"), F.lpad((F.col("vec_id") % 900).cast("string"), 4, " "), F.lit("    "), *xyz, F.lit("  1.00  0.00          "), F.lit(" C"), F.lit(" "))
    return t.embeddings.select(line.alias("value"))


@q("src_20_fixed_width_atoms", f"SELECT vec_id::INT AS serial, 'CA' AS atom, 'ALA' AS residue, (vec_id % 900)::INT AS residue_no, {_XYZ.format(i=1)} AS x, {_XYZ.format(i=2)} AS y, {_XYZ.format(i=3)} AS z FROM embeddings")
def src_20(t):
    path = reserve(t.spark, "pdb")
    _pdb(t).write.text(path)
    return tables.pdb_atoms(t.spark.read.text(path)).select("serial", "atom", "residue", "residue_no", "x", "y", "z")


@q("src_21_multi_model", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS model FROM orders")
def src_21(t):
    lines = t.orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("k"), F.explode(F.array(F.struct(F.lit(0).alias("s"), F.lit("MODEL").alias("value")), F.struct(F.lit(1).alias("s"), F.lit("ATOM").alias("value")))).alias("l")).select("file", (F.col("k") * 2 + F.col("l.s")).alias("number"), "k", "l.value")
    m = tables.pose_models(lines, "file", "number")
    return m.filter("value = 'ATOM'").select(F.col("file").alias("o_custkey"), F.col("k").alias("o_orderkey"), "model")


@q("snk_01_fixed_columns", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand, NULL::VARCHAR AS remark FROM part")
def snk_01(t):
    path = reserve(t.spark, "csv")
    tables.write_csv(t.part, path, ["p_partkey", "p_brand", "remark"])
    return tables.read_csv(t.spark, path, _string("p_partkey", "p_brand", "remark"))


@q("snk_02_append_migration", "SELECT r_regionkey, r_name, NULL::INT AS n_nations FROM region UNION ALL SELECT r_regionkey, r_name, 5 FROM region")
def snk_02(t):
    return tables.migrate_append(t.region, t.region.withColumn("n_nations", F.lit(5)))


@q("src_03_sqlite_read_only", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_03(t):
    import os
    import sqlite3
    import tempfile
    import uuid

    path = os.path.join(tempfile.mkdtemp(prefix="quillwork-"), f"nation-{uuid.uuid4().hex}.db")  # the source, a file on the driver
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
    con.executemany("INSERT INTO nation VALUES (?, ?, ?)", (tuple(r) for r in t.nation.select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()))
    con.commit()
    con.close()
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    return tables.read_sqlite(t.spark, path, "SELECT n_nationkey, n_name, n_regionkey FROM nation", schema, "n_nationkey", 3)


def _fetched(t, first, refusals: int, **kw):
    """Every status of the name cache as the first answer of a page, given ``refusals`` times before the page comes: answers, attempts and waits."""
    import io
    import urllib.error

    schema = T.StructType([T.StructField(n, k) for n, k in (("status", T.IntegerType()), ("n", T.LongType()), ("final", T.IntegerType()), ("attempts", T.IntegerType()), ("shortest", T.DoubleType()), ("longest", T.DoubleType()))])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for status, n in zip(pdf["status"], pdf["n"]):
                tried, waits = [], []

                class Answer(io.BytesIO):
                    pass

                def opener(req, timeout, status=status, tried=tried, Answer=Answer):
                    tried.append(req)
                    if len(tried) > refusals or status == 200:
                        body = Answer(b"x")
                        body.status = 200
                        return body
                    if pd.isna(status):
                        raise TimeoutError
                    raise urllib.error.HTTPError(req.full_url, int(status), "", {}, None)

                final, _ = web.fetch("http://x.example/p", opener=opener, sleep=waits.append, **kw)
                out.append((status, n, final, len(tried), min(waits, default=None), max(waits, default=None)))
            yield pd.DataFrame(out, columns=schema.fieldNames()).astype({"status": "Int32"})

    return t.names.groupBy("status").agg(F.count(F.lit(1)).alias("n")).mapInPandas(run, schema)


_RETRIED = "status IN (429, 500, 502, 503, 504) OR status IS NULL"


@q("src_08_fetch_retry", f"SELECT status, count(*) AS n, CASE WHEN status = 200 OR {_RETRIED} THEN 200 ELSE status END AS final, CASE WHEN {_RETRIED} THEN 3 ELSE 1 END AS attempts FROM names GROUP BY status")
def src_08(t):
    return _fetched(t, 200, 2).select("status", "n", "final", "attempts")


@q("src_09_backoff_jitter", f"SELECT status, CASE WHEN {_RETRIED} THEN 5 ELSE 1 END AS attempts, CASE WHEN {_RETRIED} THEN coalesce(status, 0) ELSE status END AS final, ({_RETRIED}) AS waited FROM names GROUP BY status")
def src_09(t):
    """Pages that never come: five attempts, each wait between 1.0 and 1.5 seconds over the doubled pause."""
    got = _fetched(t, 200, 99, jitter=(1.0, 1.5))
    within = F.col("shortest").between(2.0, 2.5) & F.col("longest").between(9.0, 9.5)
    return got.select("status", "attempts", "final", F.coalesce(within, F.lit(False)).alias("waited"))


@q("src_10_robots_gate", "SELECT plant_index, source_page_url, NOT (contains(source_page_url, '/plants?page=1') AND NOT contains(source_page_url, '/plants?page=12')) AS allowed FROM plant_index WHERE source_page_url IS NOT NULL")
def src_10(t):
    rules = "User-agent: *\nAllow: /plants?page=12\nDisallow: /plants?page=1\nCrawl-delay: 1"

    @F.pandas_udf(T.BooleanType())
    def allowed(s):
        held = web.robots(rules, "https://flora.example")
        return s.map(lambda u: held.can_fetch("quillwork", u))

    p = t.plant_index.filter("source_page_url IS NOT NULL")
    return p.select("plant_index", "source_page_url", allowed("source_page_url").alias("allowed"))


@q("snk_05_markdown_report", "WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS e FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY source) AS i, '| ' || replace(source, '|', chr(92) || '|') || ' | ' || n || ' | ' || e || ' |' AS text FROM g) SELECT 0::BIGINT AS line_no, '# Documents by source' AS text UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| source | documents | without text |' UNION ALL SELECT 3, '| --- | --- | --- |' UNION ALL SELECT i + 3, text FROM r")
def snk_05(t):
    g = t.documents.filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("text").isNull(), 1)).alias("without text"))
    return tables.markdown(g, "Documents by source", "source")


@q("snk_06_figure_data", "SELECT 'value histogram' AS figure, assay_type AS series, floor(pchembl_value * 2) / 2 AS x, count(*)::DOUBLE AS y FROM activities WHERE pchembl_value > 0 AND pchembl_value < 15 AND assay_type IS NOT NULL GROUP BY ALL UNION ALL SELECT 'plants by compounds', 'all', n_plants::DOUBLE, count(*)::DOUBLE FROM compounds_unique WHERE n_plants IS NOT NULL GROUP BY ALL")
def snk_06(t):
    """What the figures are drawn from, as one long table: figure, series, x, y."""
    v = F.col("pchembl_value")
    a = t.activities.filter((v > 0) & (v < 15) & F.col("assay_type").isNotNull()).groupBy(F.col("assay_type").alias("series"), (F.floor(v * 2) / 2).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    b = t.compounds_unique.filter("n_plants IS NOT NULL").groupBy(F.lit("all").alias("series"), F.col("n_plants").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return a.select(F.lit("value histogram").alias("figure"), "series", "x", "y").unionByName(b.select(F.lit("plants by compounds").alias("figure"), "series", "x", "y"))


@q("snk_04_manifest", "SELECT (SELECT count(*) FROM region) AS n_regions, (SELECT count(*) FROM nation) AS n_nations, 1::BIGINT AS version")
def snk_04(t):
    import json
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as d:  # a control-plane file on the driver
        path = os.path.join(d, "manifest.json")
        tables.write_manifest(path, {"version": 1, "n_regions": t.region.count(), "n_nations": t.nation.count()})
        with open(path) as f:
            m = json.load(f)
    return t.spark.createDataFrame([(m["n_regions"], m["n_nations"], m["version"])], "n_regions bigint, n_nations bigint, version bigint")


QUERIES, SQL = plan.queries, plan.sql
