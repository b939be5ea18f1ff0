"""An inverted index on disk: search reads the partitions of its terms, not the documents.

An index is a folder of numbered segments, each with

* `postings`: term, id, field, tf, len (tokens of the document) and positions, partitioned by a hash of the term's first LEAD
  characters and sorted by term within, so a term or prefix is found by partition and by the files' statistics. A document's
  postings are made in its own row and written by the task that reads it, so building shuffles nothing. A last partition has a
  row for each document, without a term;
* `gone`: ids whose entries in earlier segments no longer hold;
* `totals`: documents and tokens of the index with this segment, one row, written last: a segment without it doesn't count.

What ranking needs of a document (its length) stands in its postings, so a search shuffles nothing but the postings of its terms,
added up by document before. Updates write a segment of the changed documents; compact() writes them all into one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans import search as language
from folio.sources import storage

#: Characters of a term by which it is dealt to a partition, and the number of partitions.
LEAD, BUCKETS = 2, 64
#: Rows of `gone` that are broadcast; more are joined by a shuffle.
BROADCAST_GONE = 1_000_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(LEAD))), F.lit(BUCKETS)).cast("int")


def _documents() -> Column:
    """The rows of documents themselves, a partition of their own."""
    return F.col("bucket") == BUCKETS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grouped(tokens: Column, field: int) -> Column:
    """The postings of one document's field: term, field, tf, positions of each of its terms. The tokens are sorted with their places,
    and a term's places are the run between where it begins and where the next one does."""
    pairs = F.sort_array(F.transform(tokens, lambda t, at: F.struct(t.alias("term"), at.alias("at"))))

    def runs(ordered: Column) -> Column:
        first = F.transform(ordered, lambda p, i: (i == 0) | (p["term"] != F.get(ordered, i - 1)["term"]))
        begins = lambda new: F.filter(F.transform(new, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
        return _let(F.struct(F.transform(ordered, lambda p: p["at"]).alias("at"), begins(first).alias("b")), lambda k: F.transform(k["b"], lambda i, j: posting(ordered, k, i, j)))

    def posting(ordered: Column, k: Column, i: Column, j: Column) -> Column:
        tf = F.coalesce(F.get(k["b"], j + 1), F.size(k["at"])) - i
        return F.struct(F.get(ordered, i)["term"].alias("term"), F.lit(field).alias("field"), tf.alias("tf"), F.slice(k["at"], i + 1, tf).alias("positions"))

    return _let(pairs, runs)


class SearchIndex:
    """An index below `path` over the fields of documents, in their order."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, fields: list[str]):
        self.spark, self.path, self.id_col, self.fields = spark, path.rstrip("/"), id_col, list(fields)

    @classmethod
    def build(cls, documents: DataFrame, path: str, id_col: str, fields: list[str]) -> SearchIndex:
        """A new index of all documents (ids distinct and not null)."""
        index = cls(documents.sparkSession, path, id_col, fields)
        index._write(documents, None, 0)
        return index

    def segments(self) -> int:
        """The number of whole segments."""
        n = 0
        while storage.exists(self.spark, f"{self._at(n, 'totals')}/_SUCCESS"):
            n += 1
        return n

    def _at(self, segment: int, table: str) -> str:
        return f"{self.path}/{segment:06d}/{table}"

    def _read(self, segment: int, table: str) -> DataFrame:
        if table != "postings":
            return self.spark.read.parquet(self._at(segment, table))
        # A segment of deletions has no postings' files to tell a schema from.
        kind = self._read(segment, "gone").schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"term string, id {kind}, field int, tf int, len int, positions array<int>, bucket int").parquet(self._at(segment, table))

    def _write(self, documents: DataFrame, gone: DataFrame | None, segment: int) -> None:
        fields = documents.select(F.col(self.id_col).alias("id"), *[language.tokens(F.col(f)).alias(f"f{i}") for i, f in enumerate(self.fields)])
        n = reduce(lambda x, y: x + y, [F.size(f"f{i}") for i in range(len(self.fields))])
        own = F.array(F.struct(F.lit("").alias("term"), F.lit(-1).alias("field"), F.lit(0).alias("tf"), F.lit(None).cast("array<int>").alias("positions")))
        held = fields.select("id", n.alias("len"), F.explode(F.concat(own, *[_grouped(F.col(f"f{i}"), i) for i in range(len(self.fields))])).alias("p"))
        postings = held.select("p.term", "id", "p.field", "p.tf", "len", "p.positions", F.when(F.col("p.field") < 0, BUCKETS).otherwise(_bucket(F.col("p.term"))).alias("bucket"))
        postings.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(self._at(segment, "postings"))
        before, removed = {"docs": 0, "tokens": 0}, {"docs": 0, "tokens": 0}
        empty = self.spark.createDataFrame([], documents.select(F.col(self.id_col).alias("id")).schema)
        (gone if gone is not None else empty).select("id").distinct().write.mode("overwrite").parquet(self._at(segment, "gone"))
        counted = F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")
        if segment:
            before = self._read(segment - 1, "totals").first().asDict()
            removed = self._live(segment, _documents()).join(self._gone(segment), "id", "left_semi").agg(*counted).first().asDict()
        added = self._read(segment, "postings").where(_documents()).agg(*counted).first().asDict()
        totals = [tuple(before[k] - removed[k] + added[k] for k in ("docs", "tokens"))]
        self.spark.createDataFrame(totals, "docs long, tokens long").coalesce(1).write.mode("overwrite").parquet(self._at(segment, "totals"))

    def _gone(self, segment: int) -> DataFrame:
        """The ids that a segment takes out, to be broadcast where they are few."""
        gone = self._read(segment, "gone")
        return F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone

    def _live(self, segments: int, postings: Column | None = None) -> DataFrame:
        """Postings of the first so many segments that later ones have not replaced."""
        out = None
        for n in range(segments):
            one = self._read(n, "postings")
            one = one if postings is None else one.where(postings)
            for later in range(n + 1, segments):
                one = one.join(self._gone(later), "id", "left_anti")
            out = one if out is None else out.unionByName(one)
        return out

    def postings(self) -> DataFrame:
        """All postings that hold."""
        return self._live(self.segments(), ~_documents())

    def update(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Write a segment: documents that came or changed, and (column of the id) those that went."""
        n = self.segments()
        if not n:
            raise ValueError(f"no index at {self.path}")
        ids = [df.select(F.col(self.id_col).alias("id")) for df in (changed, deleted) if df is not None]
        if ids:
            documents = changed if changed is not None else self.spark.createDataFrame([], self._schema(deleted))
            self._write(documents, reduce(DataFrame.unionByName, ids), n)

    def _schema(self, deleted: DataFrame) -> str:
        return ", ".join([f"{self.id_col} {deleted.schema[self.id_col].dataType.simpleString()}", *[f"{f} string" for f in self.fields if f != self.id_col]])

    def compact(self, path: str) -> SearchIndex:
        """The index as one segment at another path."""
        n = self.segments()
        out = SearchIndex(self.spark, path, self.id_col, self.fields)
        # A task's files are sorted together; what is read of a partition is written to it, so nothing is shuffled.
        self._live(n).sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(out._at(0, "postings"))
        self._read(0, "gone").limit(0).write.parquet(out._at(0, "gone"))
        self._read(n - 1, "totals").coalesce(1).write.parquet(out._at(0, "totals"))
        return out

    def _matches(self, term: str, prefix: bool) -> Column:
        """The postings of a term, or of all terms that begin with it, by partition where it is long enough to name one."""
        same = F.col("term").startswith(term) if prefix else F.col("term") == term
        return same & (F.col("bucket") == _bucket(F.lit(term))) if not prefix or len(term) >= LEAD else same

    def _counts(self, segments: int, terms: list[language.Term]) -> DataFrame:
        """id, len, c<i>: how often each term occurs in each document that holds any."""
        words = [language.fold(t.value) for t in terms]
        single = {i: self._matches(w[0], not terms[i].phrase) for i, w in enumerate(words) if len(w) == 1}
        parts = []
        if single:
            live = self._live(segments, reduce(lambda a, b: a | b, single.values()))
            parts.append(live.select("id", "len", *[(F.when(single[i], F.col("tf")) if i in single else F.lit(None).cast("int")).alias(f"c{i}") for i in range(len(terms))]))
        for i, w in enumerate(words):
            if len(w) < 2:
                continue
            places = [self._matches(x, not terms[i].phrase and k == len(w) - 1) for k, x in enumerate(w)]
            live = self._live(segments, reduce(lambda a, b: a | b, places))
            # Where a run would begin, by each of its words: a posting travels as it is, and a run begins where all words say so.
            begun = lambda k: F.transform("positions", lambda at: at - F.lit(k))
            starts = [F.flatten(F.collect_list(F.when(p, begun(k)))).alias(f"s{k}") for k, p in enumerate(places)]
            dealt = live.select("id", "len", "field", "term", "bucket", "positions").repartition("id", "field").groupBy("id", "field").agg(F.first("len").alias("len"), *starts)
            runs = dealt.select("id", "len", F.size(reduce(F.array_intersect, [F.col(f"s{k}") for k in range(len(w))])).alias("n")).where("n > 0")
            parts.append(runs.select("id", "len", *[(F.col("n") if j == i else F.lit(None).cast("int")).alias(f"c{j}") for j in range(len(terms))]))
        both = reduce(DataFrame.unionByName, parts)
        return both.groupBy("id").agg(F.first("len").alias("len"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(terms))])

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """id, rank of the documents that match a query of the search language, best first (smaller is better), as search() has them."""
        terms = [t for t in language.parse(query) if t.alternative or language.fold(t.value)]
        groups = language.groups(terms)
        n = self.segments()
        named = [t for t in terms if not t.alternative]
        place = {i: k for k, i in enumerate(i for i, t in enumerate(terms) if not t.alternative)}
        if not groups:
            return self._read(0, "gone").select(F.col("id").alias(self.id_col), F.lit(0.0).alias("rank")).limit(0)
        counted = self._counts(n, named)
        totals = self._read(n - 1, "totals").first()
        count, holders = (lambda i: F.col(f"c{place[i]}")), (lambda i: F.col(f"n{place[i]}"))
        match = language.matching(terms, groups, count)
        rank = language.bm25(groups, count, holders, F.lit(totals["docs"]), F.lit(totals["tokens"] / max(totals["docs"], 1)))
        facts = counted.agg(*[F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"n{k}") for k in range(len(named))])
        ranked = counted.where(match).join(F.broadcast(facts)).select(F.col("id").alias(self.id_col), rank.alias("rank"))
        ordered = ranked.orderBy("rank", self.id_col)
        return ordered if limit is None else ordered.limit(limit)
