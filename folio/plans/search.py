"""Boolean full-text search: query language, match predicate, BM25 rank.

A query is parsed once on the driver into groups of terms. Tables with an index are searched by search_index.py; search() counts
each term in the folded texts, natively and without arrays of tokens. Precedence: a negated part binds to the last alternative
only; words side by side bind tighter than OR.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rank's parameters, and the least weight of a common term.
K1, B, LEAST_WEIGHT = 1.2, 0.75, 1e-6
#: Token between fields, which no query word equals: phrases do not cross fields.
GAP = "\x1f"


@dataclass(frozen=True)
class Term:
    """A word (matched by prefix), a phrase (matched word by word), or OR between its neighbours."""

    value: str
    phrase: bool = False
    negated: bool = False
    alternative: bool = False


#: An id of a paper in a query, new style or old style, without its version.
_PAPER_ID = re.compile(r"(\d{4}\.\d{4,5})|([a-zA-Z-]+/\d{7})")
_SCAN = re.compile(r'(?P<or>(?<!\S)OR(?!\S))|(?P<neg>-?)(?:"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))')


def parse(query: str) -> list[Term]:
    """Terms of a query: "phrases", -negations, OR (capital, between blanks), words. ORs at the edges are dropped; a quote
    that is not closed runs to the end."""
    terms = []
    for m in _SCAN.finditer(query.strip()):
        if m["or"]:
            terms.append(Term("OR", alternative=True))
        elif m["phrase"] is not None:
            if m["phrase"].strip():
                terms.append(Term(m["phrase"].strip(), True, bool(m["neg"])))
        elif m["word"]:
            terms.append(Term(m["word"], False, bool(m["neg"])))
    while terms and terms[0].alternative:
        terms.pop(0)
    while terms and terms[-1].alternative:
        terms.pop()
    return terms


def match_expression(terms: list[Term]) -> str:
    """The full-text expression: positive terms (words as prefixes) first, then NOT (negated terms); empty if none is positive."""
    shown = lambda t: f'"{t.value}"' if t.phrase else f'"{re.sub(chr(39) + "|" + chr(34), "", t.value)}"*'
    usable = [t for t in terms if t.alternative or t.phrase or re.sub("['\"]", "", t.value)]
    positive = [("OR" if t.alternative else shown(t)) for t in usable if not t.negated]
    while positive and positive[0] == "OR":
        positive.pop(0)
    while positive and positive[-1] == "OR":
        positive.pop()
    negative = [shown(t) for t in usable if t.negated]
    return " ".join(positive) + (f" NOT ({' OR '.join(negative)})" if positive and negative else "")


def feed_expression(terms: list[Term]) -> str:
    """The query for a remote feed: `all:` terms joined by AND, OR, ANDNOT. A leading negation is dropped; OR before one becomes ANDNOT."""
    out: list[str] = []
    for t in terms:
        if t.alternative:
            out.append("OR")
            continue
        value = f'"{t.value}"' if t.phrase else re.sub("['\"]", "", t.value)
        if t.negated and out and out[-1] == "OR":
            out.pop()
        if out and out[-1] != "OR":
            joint = "ANDNOT" if t.negated else "AND"
        elif t.negated:
            continue
        else:
            joint = ""
        if value:
            out += [joint, f"all:{value}"] if joint else [f"all:{value}"]
    return " ".join(out)


def fold(text: str) -> list[str]:
    """A query's words as the index has them: lower case, without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


#: Letters with diacritics and their base letters, for the native tokenizer.
_MARKED = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1)
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def folded(*fields: Column) -> Column:
    """The text of all fields, lower case and without diacritics, with a gap between fields."""
    return F.concat_ws(GAP, *[F.lower(F.translate(F.coalesce(f, F.lit("")), _MARKED, _BASE)) for f in fields])


#: A token of a folded text; where one begins, where one ends, and what stands between two of a field (not the gap).
_TOKEN, _BEGIN, _END, _BETWEEN = r"(?U)[^\W_]+", r"(?<![^\W_])", r"(?![^\W_])", r"[\W_&&[^\x1f]]+"


def tokens(field: Column) -> Column:
    """The tokens of one field."""
    return F.regexp_extract_all(folded(field), F.lit(_TOKEN), 0)


def occurrences(text: Column, term: Term) -> Column:
    """How often a term occurs in a folded text: prefix matches of a word, runs of a phrase (a word of several tokens is a
    phrase whose last token is a prefix). Runs may overlap."""
    words = fold(term.value)
    if not words:
        return F.lit(0)
    run = _BETWEEN.join(words) + (_END if term.phrase else "")
    return F.regexp_count(text, F.lit(f"(?U){_BEGIN}(?={run})"))


def groups(terms: list[Term]) -> list[list[int]]:
    """Positions of positive terms: alternatives, each a list of terms that must all match."""
    out: list[list[int]] = [[]]
    for i, t in enumerate(terms):
        if t.alternative:
            out.append([])
        elif not t.negated:
            out[-1].append(i)
    return [g for g in out if g]


def matching(terms: list[Term], alternatives: list[list[int]], count: Callable[[int], Column]) -> Column:
    """Whether a document matches, by the counts of its terms: negated ones bind to the last alternative."""
    every = lambda g: reduce(Column.__and__, [count(i) > 0 for i in g])
    parts = [every(g) for g in alternatives]
    refused = [count(i) > 0 for i, t in enumerate(terms) if t.negated]
    if refused:
        parts[-1] = parts[-1] & ~reduce(Column.__or__, refused)
    return reduce(Column.__or__, parts)


def bm25(alternatives: list[list[int]], count: Callable[[int], Column], holders: Callable[[int], Column], docs: Column, mean: Column) -> Column:
    """The negated relevance (smaller is better) by counts of the positive terms, documents that hold them, and column len."""

    def part(i: int) -> Column:
        n, tf = holders(i), count(i)
        weight = F.log((docs - n + 0.5) / (n + 0.5))
        weight = F.when(weight <= 0, LEAST_WEIGHT).otherwise(weight)
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))

    return -reduce(Column.__add__, [part(i) for i in sorted({i for g in alternatives for i in g})])


def search(documents: DataFrame, query: str, id_col: str, fields: list[str], limit: int | None = None) -> DataFrame:
    """id_col, rank of the documents that match, best first (smaller is better); no rows for a query without positive terms.

    This reads all documents, for tables without an index (SearchIndex has the same rows).
    """
    terms = [t for t in parse(query) if t.alternative or fold(t.value)]
    found = groups(terms)
    if not found:
        return documents.select(id_col, F.lit(0.0).alias("rank")).limit(0)
    counted = documents.select(id_col, folded(*[F.col(f) for f in fields]).alias("folded"))
    columns = {f"c{i}": occurrences(F.col("folded"), t) for i, t in enumerate(terms) if not t.alternative}
    counted = counted.select(id_col, F.regexp_count("folded", F.lit(_TOKEN)).alias("len"), *[c.alias(n) for n, c in columns.items()])
    # Corpus figures: one row, so it is broadcast; the documents are read once more, but nothing of them is shuffled.
    facts = counted.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.sum((F.col(c) > 0).cast("long")).alias(f"n{c[1:]}") for c in columns])
    count = lambda i: F.col(f"c{i}")
    rank = bm25(found, count, lambda i: F.col(f"n{i}"), F.col("n_docs"), F.col("avg_len"))
    ranked = counted.where(matching(terms, found, count)).join(F.broadcast(facts)).select(id_col, rank.alias("rank"))
    ordered = ranked.orderBy("rank", id_col)
    return ordered if limit is None else ordered.limit(limit)


def find(documents: DataFrame, query: str, id_col: str, fields: list[str], limit: int | None = None) -> DataFrame:
    """The documents that a query asks for, with rank: one that names a paper id is a look-up of that id, others are searched."""
    if named := _PAPER_ID.search(query):
        return documents.where(F.col(id_col) == F.lit(named[1] or named[2])).withColumn("rank", F.lit(0.0))
    return documents.join(search(documents, query, id_col, fields, limit), id_col)
