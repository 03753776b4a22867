"""Results that once went wrong: clashing column names in the near-copy stage, pages whose URL names no host."""

from __future__ import annotations

from postroom.llm import html_extraction, jaccard_join

WORDS = "one two three four five six seven eight nine ten"


def test_deduplicate_passes_columns_of_any_name(spark):
    schema = "doc_id long, text string, stays string, _id int, _print int, _stays int, _mark string, __mark string, node string, root int"
    extra = ("x", 1, 2, 3, "m", "mm", "n", 4)
    rows = [(2, WORDS, *extra), (1, WORDS, *extra), (3, None, *extra), (4, "other words stand here alone", *extra), (1, WORDS, *extra), (None, WORDS, *extra)]
    docs = spark.createDataFrame(rows, schema)
    out = jaccard_join.deduplicate(docs, width=5, percent=80)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted([rows[1], rows[2], rows[3]])
    assert jaccard_join.deduplicate(docs.limit(0), width=5, percent=80).columns == docs.columns


def test_pages_without_a_host_share_no_template(spark):
    pages = [(i, f"/p/{i}", f"<html><body><div>A line that all of them hold.</div><p>Own words of page {i}.</p></body></html>") for i in range(8)]
    rows = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all("A line that all of them hold." in r["text"] and f"page {r['page_id']}" in r["text"] for r in rows)
