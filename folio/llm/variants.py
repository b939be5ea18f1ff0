"""Spelling variants by forward and backward automata (operator 13).

Two words are near if one insertion, deletion or replacement of a character turns one into the other. Of two near words one half
is the same: if m is the shorter's length, either their first m // 2 characters agree or their last m // 2 do. So every word is
dealt, read forward and backward, to the half it would share, and near words meet in at least one bucket. In a task, words of a
direction form a minimal acyclic automaton whose edges count the words they skip, so that a path spells a word and gives its
number (a perfect hash). A word walks its half exactly and completes with one error; its near words are the distinct numbers found.
A pair that both directions find counts in the forward one.

Words travel with their counts, so a task sums up near words itself, and only a word's number of near words and the most frequent
one are shuffled. Buckets above BUCKET_WORDS words are split by halves of what is left of the words, again read in both
directions; what no half divides is compared block by block.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize, release, shuffle_width

#: Least length of a word, in code points.
MIN_LENGTH = 7
#: Least occurrences of a word.
MIN_COUNT = 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Words of a bucket that are not split further; about as many words are matched at once; and such groups in a partition.
BUCKET_WORDS, GROUP_WORDS, GROUPS = 20_000, 4_000, 4
#: Splits of large buckets; each makes the part that must agree longer by half of the rest.
SPLITS = 3
#: A word is a longest run of these.
RUN = r"[A-Za-z\u00C0-\u00FF]+"
#: One run in so many loses a character (the dataset's planted misspellings).
_DROPPED = 31
#: Most keys of large buckets that are broadcast.
_BROADCAST_KEYS = 1_000_000

_FOUND = "word string, n_near long, near_n long, near string"


class Automaton:
    """Minimal acyclic automaton of sorted distinct words, with perfect-hash numbers.

    A state is final or not and has edges {character: (state, words skipped)}: adding up what is skipped on the path of a word
    gives its number in the sorted list.
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self._count: list[int] = []
        known: dict[tuple, int] = {}
        # States of the last word's path that may still get edges: (final, [(character, state)]).
        open_states: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
        last = ""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                final, out = open_states.pop()
                key = (final[0], tuple(out))
                state = known.get(key)
                if state is None:
                    state = known[key] = self._add(final[0], out)
                open_states[-1][1].append((last[len(open_states) - 1], state))

        for word in words:
            same = 0
            while same < len(last) and last[same] == word[same]:
                same += 1
            close(same)
            open_states.extend(([False], []) for _ in word[same:])
            open_states[-1][0][0] = True
            last = word
        close(0)
        self.start = self._add(open_states[0][0][0], open_states[0][1])

    def _add(self, final: bool, out: list[tuple[str, int]]) -> int:
        skipped = int(final)
        edges = {}
        for c, state in out:
            edges[c] = (state, skipped)
            skipped += self._count[state]
        self.final.append(final)
        self.edges.append(edges)
        self._count.append(skipped)
        return len(self.final) - 1

    def walk(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        """The state and number after text, or None."""
        edges = self.edges
        for c in text:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that agree in the first `exact` characters and differ by one error after them."""
        found: set[int] = set()
        at = self.walk(self.start, 0, word[:exact])
        if at is None:
            return found
        state, number = at
        for i in range(exact, len(word) + 1):
            c, rest = word[i : i + 1], word[i + 1 :]
            for d, (target, skipped) in self.edges[state].items():
                if d != c:
                    # d replaces c, or stands before it. (An inserted c gives the same word when it stands after the run of c.)
                    if c:
                        self._complete(target, number + skipped, rest, found)
                    self._complete(target, number + skipped, word[i:], found)
                elif i + 1 == len(word) or word[i + 1] != c:
                    self._complete(*self._at(state, number, c), word[i:], found)
            if c:
                self._complete(state, number, rest, found)
                step = self.edges[state].get(c)
                if step is None:
                    break
                state, number = step[0], number + step[1]
        return found

    def _at(self, state: int, number: int, c: str) -> tuple[int, int]:
        target, skipped = self.edges[state][c]
        return target, number + skipped

    def _complete(self, state: int, number: int, rest: str, found: set[int]) -> None:
        end = self.walk(state, number, rest)
        if end is not None and self.final[end[0]]:
            found.add(end[1])


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z lower-cased, with the misspellings that the dataset plants.

    A run whose hash with the document's id is divisible by _DROPPED loses the character that the hash points at; rows without an
    id keep their runs. Words of at least MIN_LENGTH characters and MIN_COUNT occurrences are returned. Null and empty texts have
    none, rows that repeat count each. Occurrences are added up before the shuffle, so a frequent word is one row of a task.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), ascii_uppercase, ascii_lowercase), F.lit(RUN), 0)
    long_runs = F.filter(runs, lambda r: F.char_length(r) >= MIN_LENGTH)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(long_runs).alias("run"))
    h = F.coalesce(F.crc32(F.concat("id", F.lit(":"), "run")), F.lit(1))
    at = (h % F.char_length("run")).cast("int")
    spelled = F.when(h % _DROPPED == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return rows.select(spelled.alias("word")).where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _dealt(words: DataFrame) -> DataFrame:
    """Each word (word, n) by the halves that it shares with a near word.

    least is the shorter word's length, exact the characters that agree, view the word read from there on in the directions of
    path. A word is dealt as the shorter (or equal) and as the longer of a pair.
    """
    least = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("least")
    return _split(words.select("word", "n", least).withColumns({"view": F.col("word"), "exact": F.lit(0), "path": F.lit("")}))


def _split(rows: DataFrame) -> DataFrame:
    """Rows dealt once more: half of what is left of the shorter word agrees, read forward (F) or backward (B)."""
    head, rest = F.expr("left(view, exact)"), F.expr("substr(view, exact + 1)")
    ways = F.array(F.struct(F.lit("F").alias("way"), F.col("view").alias("view")), F.struct(F.lit("B").alias("way"), F.concat(head, F.reverse(rest)).alias("view")))
    out = rows.withColumns({"dealt": F.explode(ways), "exact": (F.col("exact") + F.floor((F.col("least") - F.col("exact")) / 2)).cast("int")})
    return out.select("word", "n", "least", "exact", F.concat("path", "dealt.way").alias("path"), F.col("dealt.view").alias("view"))


def first_path(a: str, b: str, least: int, depth: int) -> str:
    """The directions in which two near words count: forward wherever the forward half agrees."""
    out, exact = "", 0
    for _ in range(depth):
        end = exact + (least - exact) // 2
        if a[exact:end] == b[exact:end]:
            out += "F"
        else:
            out += "B"
            a, b = a[:exact] + a[exact:][::-1], b[:exact] + b[exact:][::-1]
        exact = end
    return out


def _matched(group: pd.DataFrame) -> pd.DataFrame:
    """The near words of a group of buckets: one row for each record that has any."""
    out = []
    for path, rows in group.groupby("path", sort=False):
        entries = rows[rows["entry"]].drop_duplicates("view").sort_values("view")
        automaton = Automaton(entries["view"].tolist())
        names, counts = entries["word"].tolist(), entries["n"].tolist()
        for word, view, least, exact in zip(rows["word"], rows["view"], rows["least"], rows["exact"]):
            hits = [k for k in automaton.near(view, exact) if min(len(names[k]), len(word)) == least and first_path(word, names[k], least, len(path)) == path]
            if hits:
                best = min(hits, key=lambda k: (-counts[k], names[k]))
                out.append((word, len(hits), counts[best], names[best]))
    return pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, bucket_words: int = BUCKET_WORDS, splits: int = SPLITS) -> DataFrame:
    """word, n_near, near_n, near: of every word that has near words, their number, and the most frequent one with its count
    (ties: the first in code-point order). words: word, n; distinct."""
    key = ["path", "least", "head"]
    kept = ["word", "n", "least", "exact", "path", "view", "head"]
    headed = lambda rows: rows.withColumn("head", F.expr("left(view, exact)"))
    rows, settled, blocks = headed(_dealt(words)), [], F.lit(1)
    for step in range(splits + 1):
        rows = materialize(rows.select(*kept), "dealt")
        # At most one key for every bucket_words rows.
        large = materialize(rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > bucket_words), "large")
        n_large = large.count()
        if not n_large:
            break
        large = F.broadcast(large) if n_large <= _BROADCAST_KEYS else large
        settled.append(rows.join(large, key, "left_anti").withColumn("blocks", F.lit(1)))
        rows = rows.join(large, key)
        if step == splits:
            blocks = F.ceil(F.col("size") / bucket_words).cast("int")
        else:
            rows = headed(_split(rows))
    rows = rows.withColumn("blocks", blocks).select(*kept, "blocks")
    for part in settled:
        rows = rows.unionByName(part)
    asked = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.withColumn("entry", F.pmod(F.xxhash64("word"), "blocks") == F.col("block"))
    groups = 1 + rows.count() // min(bucket_words, GROUP_WORDS)
    dealt = asked.select("word", "n", "least", "exact", "path", "view", "entry", F.pmod(F.xxhash64(*key, "block"), F.lit(groups)).alias("group"))
    # By number, so that small partitions are not put together again: a task's work is the same at every size.
    dealt = dealt.repartition(max(shuffle_width(words.sparkSession), groups // GROUPS), "group")
    found = dealt.groupBy("group").applyInPandas(lambda g: _matched(g), _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of a forest (word, form): every step doubles how far a word has looked."""
    roots, open_words = materialize(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while open_words:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, roots = roots, materialize(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
        release(last)
        open_words = roots.where("open").count()
    return roots.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, bucket_words: int = BUCKET_WORDS, splits: int = SPLITS) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with counts (word, n).

    A word's form is its most frequent near word (ties: the first in code-point order) if that is at least `ratio` times as
    frequent, else null; root follows forms to the last (the word itself without one). Words without near words have n_near 0.
    Null words are left out, empty and very long ones are words like others; repeated words must be summed up before (words_of
    does). An empty table gives no rows. Extra columns are not returned.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"), "words")
    found = near_words(words, bucket_words, splits)
    counts = F.col("near_n") >= ratio * F.col("n")
    judged = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, F.col("near")).alias("form"), F.when(counts, F.col("near_n")).alias("form_n")
    )
    judged = materialize(judged, "judged")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
