"""Full-text search over the catalog, through an index of its titles and abstracts.

The first query of a session over a data folder builds the index on disk; the others read their terms' partitions of it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.plans.registry import Tables, query
from folio.plans.search_index import SearchIndex
from folio.sources import storage

_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def papers_index(t: Tables) -> SearchIndex:
    """The index of the folder's papers, built once in an application."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        papers = t.spread("papers").select("id", "title", "abstract")
        _INDEXES[key] = SearchIndex.build(papers, storage.new_path(t.spark, "papers-index"), "id", ["title", "abstract"])
    return _INDEXES[key]


_TOK = "list_filter(string_split_regex(lower(strip_accents(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_DOCS = f"SELECT id, {_TOK.format('title')} AS a, {_TOK.format('abstract')} AS b FROM papers"


def _bm25(terms: list[str]) -> str:
    """SQL of a query of prefix words that must all match."""
    counts = ", ".join(f"len(list_filter(a, lambda t: starts_with(t, '{w}'))) + len(list_filter(b, lambda t: starts_with(t, '{w}'))) AS c{i}" for i, w in enumerate(terms))
    facts = ", ".join(f"sum(CASE WHEN c{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(terms)))
    weight = lambda i: f"ln((n_docs - n{i} + 0.5) / (n{i} + 0.5))"
    part = lambda i: f"(CASE WHEN {weight(i)} <= 0 THEN 1e-6 ELSE {weight(i)} END) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * len / avg_len))"
    return f"""SELECT id, round(-({" + ".join(part(i) for i in range(len(terms)))}), 6) AS rank FROM (SELECT id, len(a) + len(b) AS len, {counts} FROM ({_DOCS}) d) x
      CROSS JOIN (SELECT count(*) AS n_docs, avg(len) AS avg_len, {facts} FROM (SELECT len(a) + len(b) AS len, {counts} FROM ({_DOCS}) d) y) f
      WHERE {" AND ".join(f"c{i} > 0" for i in range(len(terms)))}"""


@query("F3_boolean_match", f"SELECT id FROM ({_DOCS}) d WHERE len(list_filter(list_concat(a, b), lambda t: starts_with(t, 'ent'))) > 0 OR len(list_filter(list_concat(a, b), lambda t: starts_with(t, 'ment'))) > 0 AND len(list_filter(list_concat(a, b), lambda t: starts_with(t, 'ou'))) = 0", "papers")
def f3(t: Tables):
    return papers_index(t).search("ent OR ment -ou").select("id")


@query("F4_bm25", _bm25(["the", "er"]), "papers")
def f4(t: Tables):
    return papers_index(t).search("the er").select("id", F.round("rank", 6).alias("rank"))


@query("F5_phrase_in_field", f"SELECT id FROM ({_DOCS}) d WHERE contains(' ' || array_to_string(a, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(b, ' ') || ' ', ' of the ')", "papers")
def f5(t: Tables):
    return papers_index(t).search('"of the"').select("id")


_CHANGED = "SELECT id, seq, title, CASE WHEN seq % 10 = 1 THEN concat(abstract, ' new words') ELSE abstract END AS abstract FROM papers WHERE seq % 10 <> 2"


@query("F6_index_upkeep", f"SELECT id, CAST(len(a) + len(b) AS BIGINT) AS n, len(list_filter(list_concat(a, b), lambda t: t = 'words')) AS words FROM (SELECT id, {_TOK.format('title')} AS a, {_TOK.format('abstract')} AS b FROM ({_CHANGED}) c) d WHERE len(a) + len(b) > 0", "papers")
def f6(t: Tables):
    p = t["papers"].select("id", "seq", "title", "abstract")
    changed = p.where("seq % 10 = 1").withColumn("abstract", F.concat("abstract", F.lit(" new words")))
    # A copy of the index as one segment, so that the others' stays as it is; then a segment of what changed and went.
    index = papers_index(t).compact(storage.new_path(t.spark, "papers-updated"))
    index.update(changed, p.where("seq % 10 = 2"))
    return index.postings().groupBy("id").agg(F.sum("tf").alias("n"), F.sum(F.when(F.col("term") == "words", F.col("tf")).otherwise(0)).alias("words"))


@query("F6_search_after_upkeep", _bm25(["the", "words"]).replace("FROM papers", f"FROM ({_CHANGED}) c"), "papers")
def f6_search(t: Tables):
    p = t["papers"].select("id", "seq", "title", "abstract")
    index = papers_index(t).compact(storage.new_path(t.spark, "papers-updated"))
    index.update(p.where("seq % 10 = 1").withColumn("abstract", F.concat("abstract", F.lit(" new words"))))
    index.update(deleted=p.where("seq % 10 = 2"))
    return index.search("the words").select("id", F.round("rank", 6).alias("rank"))


@query("O7_by_relevance", f"SELECT id, row_number() OVER (ORDER BY rank, id) AS place FROM ({_bm25(['tion', 'the'])}) x QUALIFY place <= 100", "papers")
def o7(t: Tables):
    best = papers_index(t).search("tion the").select("id", F.round("rank", 6).alias("rank")).orderBy("rank", "id").limit(100)
    return best.select("id", F.row_number().over(Window.orderBy("rank", "id")).cast("long").alias("place"))
