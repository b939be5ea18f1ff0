"""Toxicity scores from misspelling-tolerant lexicon hits in context (operator 5).

The lexicon (seed terms, and terms and stems learned from labelled rows) is a trie; a stem, written `stem*`, stands for all
words that begin with it, and the words it was learned from stand beside it, so that their misspellings count, too. The
Levenshtein automata of all its terms are run at once over the trie: a state is the set of (trie node, edits so far) that a
token's letters can have reached, and the deterministic transitions between states are built when first needed and kept, so
a token costs a few look-ups and most die after three letters. A hit is scored in its window of tokens: quotation marks
around it or a reporting word before it speak for quotation, words of address for abuse. A logistic regression over these
counts, fitted on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize, release, shuffles_removed, small_batches

#: Seed terms, words of address, reporting words, negations.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "scumbag", "vermin")
ADDRESS = frozenset({"you", "your", "youre", "u", "ur", "yourself", "yall"})
REPORTING = frozenset({"said", "says", "say", "called", "calls", "quote", "quoted", "quotes", "wrote", "writes", "word", "term", "reported", "reads", "titled"})
NEGATION = frozenset({"not", "never", "no", "isnt", "arent", "wasnt", "nobody"})
_CLOSING, _PLAIN = "»”", '"'
_MARK = re.compile('[\n"«“„»”]')
#: Tokens to each side of a hit that form its context.
CONTEXT = 5
#: Labelled rows of each class that terms are learned from, and labelled rows that the classifier is fitted on.
LEXICON_ROWS, FIT_ROWS = 5_000, 60_000
#: A learned term or stem stands in so great a share of the toxic rows (and so many rows), its odds are so many times those
#: in other rows and it stands in at most so great a share of those; a stem has so many letters and so many different words.
LEXICON_SHARE, LEXICON_LEAST, LEXICON_ODDS, LEXICON_OTHER, STEM_LETTERS, STEM_WORDS = 0.015, 4, 30.0, 0.0006, (3, 8), 4
#: A word in so great a share of the other rows (of LEXICON_ROWS at most) is no misspelling.
OWN_WORD_SHARE = 0.0004
FEATURES = ("any", "plain", "quoted", "fuzzy_plain", "fuzzy_quoted", "addressed", "negated", "density")
#: Used where labels are too few to fit: intercept, then one weight for each feature.
DEFAULT_WEIGHTS = (-3.5, 2.0, 3.0, -1.0, 0.8, -0.8, 1.0, -0.5, 0.5)
_TOKEN = re.compile(r"[^\W_](?:[\w*@$!]*[^\W_])?")
#: Tokens whose match a worker remembers.
MEMO_ENTRIES = 200_000


def edits_allowed(term: str) -> int:
    """Edits at which a token still counts as a misspelling of the term."""
    return 0 if len(term) < 5 or term.endswith("*") else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """match(token) -> (term, edits) of the closest term within its edits_allowed(), or None; ties go to the first term.

    own_words are tokens that only look like misspellings: they match nothing but a term that they are.
    """

    _DEAD: frozenset = frozenset()

    def __init__(self, terms: list[str], own_words: list[str] = ()):
        self.terms = sorted(set(terms))
        self.own_words = frozenset(own_words)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.budget: list[int] = [0]
        for number, term in enumerate(self.terms):
            node = 0
            self.budget[0] = max(self.budget[0], edits_allowed(term))
            for letter in term.removesuffix("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.budget.append(0)
                node = self.children[node][letter]
                self.budget[node] = max(self.budget[node], edits_allowed(term))
            # A term that is also a stem counts as the stem, which takes in more.
            if self.ends[node] < 0 or term.endswith("*"):
                self.ends[node] = number
        self.start = self._close({0: 0})
        self.moves: dict[frozenset, dict[str, frozenset]] = {}
        self.memo: dict[str, tuple[str, int] | None] = {}

    def _close(self, reached: dict[int, int]) -> frozenset:
        """Add what skipping letters of a term reaches; keep the fewest edits of each node, within its budget."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = reached[node] + 1
                if edits <= self.budget[child] and edits < reached.get(child, 99):
                    reached[child] = edits
                    todo.append(child)
        return frozenset((n, e) for n, e in reached.items() if e <= self.budget[n])

    def _move(self, state: frozenset, letter: str) -> frozenset:
        reached: dict[int, int] = {}
        for node, edits in state:
            steps = [(child, edits + (key != letter)) for key, child in self.children[node].items()]
            for to, e in [*steps, (node, edits + 1)]:
                if e <= self.budget[to] and e < reached.get(to, 99):
                    reached[to] = e
        return self._close(reached)

    def match(self, token: str) -> tuple[str, int] | None:
        try:
            return self.memo[token]
        except KeyError:
            pass
        state, stems = self.start, []
        for letter in token:
            row = self.moves.setdefault(state, {})
            if letter not in row:
                row[letter] = self._move(state, letter)
            state = row[letter]
            if not state:
                break
            stems += [(0, self.ends[n]) for n, e in state if not e and self.ends[n] >= 0 and self.terms[self.ends[n]].endswith("*")]
        found = stems + [(e, self.ends[n]) for n, e in state if self.ends[n] >= 0 and e <= edits_allowed(self.terms[self.ends[n]])]
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        if token in self.own_words:
            found = [f for f in found if not f[0]]
        self.memo[token] = (self.terms[min(found)[1]], min(found)[0]) if found else None
        return self.memo[token]


def quoted_at(text: str, places: list[int]) -> list[bool]:
    """Whether each of the ascending places stands in quotation marks that close on its line, in one pass over the text."""
    quoted, at = [False] * len(places), 0
    plain, opened, plain_waits, opened_waits = False, [], [], []
    for m in _MARK.finditer(text):
        while at < len(places) and places[at] < m.start():
            if plain:
                plain_waits.append(at)
            if opened:
                opened_waits.append(at)
            at += 1
        mark = m.group()
        if mark == "\n":
            if at == len(places):
                break
            plain, opened, plain_waits, opened_waits = False, [], [], []
        elif mark == _PLAIN:
            plain = not plain
            for i in plain_waits:
                quoted[i] = True
            plain_waits = []
        # The upper mark opens a quotation in English and closes a German one.
        elif mark in _CLOSING or mark == "“" and opened and opened[-1] == "„":
            del opened[-1:]
            for i in opened_waits:
                quoted[i] = True
            opened_waits = []
        else:
            opened.append(mark)
    return quoted


def hits_of(text: str, automaton: LexiconAutomaton) -> tuple[list[dict], int]:
    """Hits (start, end, term, edits, quoted, addressed, negated) in a lower-case text, and its number of tokens."""
    tokens = _TOKEN.findall(text)
    found = {t for t in set(tokens) if automaton.match(t)}
    if not found:
        return [], len(tokens)
    hits = []
    places = [m.span() for m in _TOKEN.finditer(text)]
    at = [i for i, token in enumerate(tokens) if token in found]
    for i, quoted in zip(at, quoted_at(text, [places[i][0] for i in at]), strict=True):
        token = tokens[i]
        before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
        begin, end = places[i]
        term, edits = automaton.match(token)
        hits.append({
            "start": begin, "end": end, "term": term, "edits": edits,
            "quoted": quoted or not REPORTING.isdisjoint(before),
            "addressed": not (ADDRESS.isdisjoint(before) and ADDRESS.isdisjoint(after)),
            "negated": not NEGATION.isdisjoint(before[-2:]),
        })
    return hits, len(tokens)


def features_of(hits: list[dict], n_tokens: int) -> list[float]:
    """The FEATURES of a text."""
    count = lambda quoted, edited: math.log1p(sum(h["quoted"] == quoted and (not edited or h["edits"] > 0) for h in hits))
    return [
        float(bool(hits)), count(False, False), count(True, False), count(False, True), count(True, True), math.log1p(sum(h["addressed"] for h in hits)),
        math.log1p(sum(h["negated"] for h in hits)), math.log1p(100.0 * len(hits) / max(1, n_tokens)),
    ]


_HIT = "struct<start: int, end: int, term: string, edits: int, quoted: boolean, addressed: boolean, negated: boolean>"
_HIT_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("addressed", pa.bool_()), ("negated", pa.bool_())]))


def find_hits(df: DataFrame, terms: list[str], own_words: list[str], id_col: str, text_col: str) -> DataFrame:
    """id_col, hits, n_tokens, features of every whole text; no shuffle. Offsets are in code points of the lower-case text."""
    small_batches(df.sparkSession)
    lexicon = sorted(set(terms))
    made: dict[str, LexiconAutomaton] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = made.setdefault("own", LexiconAutomaton(lexicon, own_words))
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                hits, n = hits_of((text or "").lower(), automaton)
                for column, value in zip(columns, (hits, n, features_of(hits, n)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], _HIT_ARROW), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.float64()))], names=["id", "hits", "n_tokens", "features"])

    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id long, hits array<{_HIT}>, n_tokens long, features array<double>").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5 (and for null ids, which no label names)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, id_col: str, label_col: str, label_id_col: str | None = None) -> DataFrame:
    """id, toxic (0.0 or 1.0) of the rows that may be learned from, one per id (the greatest of conflicting labels)."""
    own = F.col(label_id_col or id_col).cast("long")
    usable = labels.select(F.col(id_col).cast("long").alias("id"), own.alias("own"), F.col(label_col).cast("double").alias("toxic")).where("id is not null and toxic is not null")
    return usable.where(~held_out(F.col("own"))).groupBy("id").agg(F.max("toxic").alias("toxic"))


def learn_terms(docs: DataFrame, train: DataFrame, id_col: str, text_col: str) -> tuple[list[str], list[str]]:
    """(terms, own words) from LEXICON_ROWS rows of each class (the least by hash of the id).

    Terms stand in many toxic and few other rows. Own words look like misspelled terms but stand in several other rows.
    """
    rows = lambda which: train.where(F.col("toxic") == which).orderBy(F.xxhash64("id"), "id").limit(LEXICON_ROWS)
    sample = rows(1.0).unionByName(rows(0.0))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col).cast("string")).alias("text")).join(F.broadcast(sample), "id")
    words = texts.select("id", "toxic", F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0).alias("words"))
    # Copies of one text would teach all its words: of texts with the same least hash of three words one is kept.
    triples = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    own = words.groupBy("toxic", F.array_min(triples).alias("sketch")).agg(F.min_by("words", "id").alias("words"))
    own = materialize(own.select("toxic", F.filter(F.array_distinct("words"), lambda w: F.char_length(w) > STEM_LETTERS[0]).alias("words")), "terms")
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if n_toxic < 20 or n_other < 20:
        release(own)
        return [], []
    stems = lambda w: F.transform(F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.char_length(w), F.lit(STEM_LETTERS[1]))), lambda n: F.struct(F.concat(F.substring(w, F.lit(1), n), F.lit("*")).alias("term"), w.alias("word")))
    both = F.transform("words", lambda w: F.concat(F.array(F.struct(w.alias("term"), w.alias("word"))), stems(w)))
    found = own.select("toxic", F.monotonically_increasing_id().alias("row"), F.explode(F.flatten(both)).alias("t"))
    per_row = found.groupBy("row", "toxic", F.col("t.term").alias("term")).agg(F.min("t.word").alias("low"), F.max("t.word").alias("high"), F.min(F.reverse("t.word")).alias("back"), F.max(F.reverse("t.word")).alias("front"))
    # The words of a stem, counted only among what the rows' extremes show: enough to tell many words from one or two.
    several = F.size(F.array_distinct(F.flatten(F.collect_set(F.array("low", "high", F.reverse("back"), F.reverse("front"))))))
    toxic = per_row.where("toxic = 1").groupBy("term").agg(F.count("*").alias("toxic"), several.alias("several"))
    least = max(LEXICON_LEAST, LEXICON_SHARE * n_toxic)
    candidates = toxic.where((F.col("toxic") >= least) & (~F.col("term").endswith("*") | (F.col("several") >= STEM_WORDS)))
    other = per_row.where("toxic = 0").groupBy("term").agg(F.count("*").alias("other"))
    counts = candidates.join(other, "term", "left").fillna(0, ["other"])
    odds = ((F.col("toxic") + 0.5) / (n_toxic - F.col("toxic") + 0.5)) / ((F.col("other") + 0.5) / (n_other - F.col("other") + 0.5))
    best = counts.where((odds >= LEXICON_ODDS) & (F.col("other") <= LEXICON_OTHER * n_other)).orderBy(F.col("toxic").desc(), "term")
    rows_of = {r["term"]: r["toxic"] for r in best.collect()}
    # Where a longer stem or one word accounts for nearly all of a stem's rows, it is the better term.
    terms = [t for t, n in rows_of.items() if not (t.endswith("*") and any(s not in (t, t[:-1]) and s.startswith(t[:-1]) and m >= 0.9 * n for s, m in rows_of.items()))]
    # A stem takes in its longer stems. Its words, whichever toxic rows have them, stay terms, as a stem allows no edits.
    kept = [s for s in terms if s.endswith("*")]
    terms = [t for t in terms if not (t in kept and any(t != s and t.startswith(s[:-1]) for s in kept))]
    begins = reduce(lambda a, b: a | b, [F.startswith("word", F.lit(s[:-1])) for s in kept], F.lit(False))
    forms = own.where("toxic = 1").select(F.explode("words").alias("word")).where(begins).distinct().collect() if kept else []
    terms = [*terms, *sorted({r["word"] for r in forms if edits_allowed(r["word"])} - set(terms))]
    lexicon = [*SEED_TERMS, *terms]

    @F.pandas_udf("boolean")
    def resembles(words: pd.Series) -> pd.Series:
        automaton = LexiconAutomaton(lexicon)
        return words.map(lambda w: (automaton.match(w) or ("", 0))[1] > 0)

    common = other.where(~F.col("term").endswith("*") & (F.col("other") >= max(1.0, OWN_WORD_SHARE * n_other)))
    own_words = common.where(resembles("term")).orderBy(F.col("other").desc(), "term").collect()
    release(own)
    return terms, [r["term"] for r in own_words]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and weights by Newton's method with a ridge on the weights."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str | None = None) -> DataFrame:
    """id_col, held_out, score, predicted, hits of every row of docs.

    Only the text enters a score. Labels are learned from rows that are not held_out() alone: by id_col, or by label_id_col
    of labels, where that names the documents' own ids beside running keys. Null and empty texts have no
    hits and get the score of a text without hits. Repeated rows are scored alike; an empty table gives an empty result.
    Empty labels, or fewer than 20 of a class, leave the seed terms and DEFAULT_WEIGHTS. Columns not named are not read.
    """
    train = training_labels(labels, id_col, label_col, label_id_col)
    with shuffles_removed(docs.sparkSession):
        learned, own_words = learn_terms(docs, train, id_col, text_col)
    found = materialize(find_hits(docs, [*SEED_TERMS, *learned], own_words, id_col, text_col), "hits")
    known = found.select(F.col(id_col).alias("id"), "features").join(train, "id")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("features", "toxic").toPandas()
    y = sample["toxic"].to_numpy(float)
    weights = list(DEFAULT_WEIGHTS)
    if min(y.sum(), len(y) - y.sum()) >= 20:
        weights = fit_logistic(np.array(sample["features"].tolist(), float), y).tolist()
    total = F.lit(weights[0])
    for i, w in enumerate(weights[1:]):
        total = total + F.lit(w) * F.get("features", F.lit(i))
    scored = found.select(id_col, held_out(F.col(id_col)).alias("held_out"), (1 / (1 + F.exp(-total))).alias("score"), "hits")
    return scored.select(id_col, "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "hits")
