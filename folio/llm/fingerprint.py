"""Document fingerprints by one-permutation MinHash with optimal densification (operator 7), in DataFrame functions only.

Each word shingle is hashed once; the top bits of the hash name its bin, and a bin keeps its least hash. An empty bin
borrows from the non-empty bin that comes first in the empty bin's own pseudo-random order of bins (the limit of probing
bins by a 2-universal hash until one is filled). The low bits of the kept values, packed as hex, are the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import let

#: Bins of a fingerprint (a power of two) and bits kept of each (a multiple of 4).
BINS, BITS, SHINGLE_WORDS = 128, 8, 5
#: Documents (by id) that share a window when each is paired with the next.
BUCKET_IDS = 8192
#: With at most so many buckets (about 40 MB) their successors are broadcast; with more they are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles of `words` whitespace-separated words; a shorter text is one shingle, an empty one too."""
    tokens = F.transform(F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\r\f\x0b", "     "), " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def roll(h: Column) -> Column:
        n = F.size(h) - words + 1
        many = F.transform(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
        return F.when(n >= 1, many).otherwise(F.array(F.xxhash64(F.array_join(h, " "))))

    return let(tokens, roll)


def _bin(h: Column, bins: int) -> Column:
    return F.shiftrightunsigned(h, 64 - (bins.bit_length() - 1)).cast("int")


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, words: int = SHINGLE_WORDS) -> Column:
    """The packed fingerprint as lowercase hex, `bits`/4 digits a bin. Null counts as empty text; equal texts have equal fingerprints."""
    digits = bits // 4

    # Signed order groups each bin's hashes together, least first: the first of each group is the bin's minimum.
    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (_bin(h, bins) != _bin(F.get(ordered, i - 1), bins)))

    def dense(filled: Column) -> Column:
        held = F.map_from_arrays(F.transform(filled, lambda h: _bin(h, bins)), filled)

        def value(own: Column, k: Column) -> Column:
            borrowed = F.array_min(F.transform(filled, lambda h: F.struct(F.hash(k, _bin(h, bins)).alias("order"), h.alias("h"))))["h"]
            return F.coalesce(own, borrowed)

        def pack(table: Column) -> Column:
            low = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: value(F.element_at(table, k), k).bitwiseAND(F.lit((1 << bits) - 1)))
            return F.array_join(F.transform(low, lambda v: F.lpad(F.lower(F.hex(v)), digits, "0")), "")

        return let(held, pack)

    return let(F.sort_array(shingle_hashes(text, words)), lambda o: let(firsts(o), dense))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1: the share of equal bins, less what low-order bits agree by chance."""
    digits = bits // 4
    cells = lambda s: F.regexp_extract_all(s, F.lit("." * digits), 0)
    same = F.size(F.filter(F.zip_with(cells(a), cells(b), lambda x, y: x == y), lambda e: e))
    chance = 1.0 / (1 << bits)
    return F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1.0 - chance))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint of every whole text. No shuffle. Null text is empty; nulls, ties, repeated rows and extra columns pass row by row."""
    return df.select(F.col(id_col), fingerprint(F.col(text_col).cast("string")).alias("fingerprint"))


def _floor_div(c: Column) -> Column:
    """Exact floor(c / BUCKET_IDS) for any long."""
    return F.shiftright(c, BUCKET_IDS.bit_length() - 1)


def _bucket_successors(ids: DataFrame, last: int, highest: int) -> DataFrame:
    """For each occupied bucket of ids the largest id of the next lower occupied one (the lowest: the largest id of all).

    ids: columns doc and bucket (from 0 to `last`). Works level by level: only each bucket's largest id is carried to the next level of
    buckets, BUCKET_IDS times as wide, so no window ever holds more than BUCKET_IDS rows.
    """
    level = ids.groupBy("bucket").agg(F.max("doc").alias("top"))
    base = level
    found: list[DataFrame] = []
    while True:
        up = _floor_div(F.col("bucket"))
        last //= BUCKET_IDS
        linked = level.withColumn("up", up).withColumn("next_top", F.lead("top").over(W.partitionBy("up").orderBy(F.col("bucket").desc())))
        # The least bucket of a group takes the top of the next lower group; the group's key is its greatest bucket.
        found.append(linked)
        if last == 0:
            break
        level = linked.groupBy(F.col("up").alias("bucket")).agg(F.max("top").alias("top"))
    # From the widest level down: a bucket without a successor in its group takes the successor of the group.
    out = None
    for linked in reversed(found):
        if out is None:
            out = linked.select("bucket", F.coalesce("next_top", F.lit(highest)).alias("next_top"))
        else:
            groups = out.select(F.col("bucket").alias("up"), F.col("next_top").alias("group_next"))
            out = linked.join(groups, "up").select("bucket", F.coalesce("next_top", "group_next").alias("next_top"))
    return base.select("bucket").join(out, "bucket")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pair every document with the next in descending id (the last with the first): doc, text, print, next_text, next_print.

    The texts are shuffled once, by bucket of BUCKET_IDS consecutive ids. Each bucket also receives a copy of the document
    that follows its last one, so no pair crosses buckets. Repeated ids are ordered by text; null ids come last. Only
    those two columns are read; an empty table gives an empty result, a single document follows itself.
    """
    base = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = base.agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("rows"), F.count("doc").alias("ids")).first()
    # Null ids stand below every other id; they get an id of their own.
    floor_id = (bounds["lo"] if bounds["lo"] is not None else 0) - 1
    lo = floor_id if bounds["rows"] > bounds["ids"] else bounds["lo"] or 0
    highest = bounds["hi"] if bounds["hi"] is not None else lo
    last = highest // BUCKET_IDS - lo // BUCKET_IDS
    base = base.withColumn("key", F.coalesce("doc", F.lit(floor_id)))
    own = _floor_div(F.col("key")) - F.lit(lo // BUCKET_IDS)
    successors = _bucket_successors(base.select(F.col("key").alias("doc"), own.alias("bucket")), last, highest)
    # next_top -> the buckets that need it; usually one, and the wrap-around adds one more.
    donors = successors.groupBy(F.col("next_top").alias("key")).agg(F.collect_set("bucket").alias("targets"))
    printed = base.withColumn("print", fingerprint(F.col("text")))
    if min(bounds["rows"], last) <= BROADCAST_BUCKETS:
        donors = F.broadcast(donors)
    dealt = printed.join(donors, "key", "left").select(
        "doc", "key", "text", "print",
        F.explode(F.concat(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("donor"))), F.transform(F.coalesce("targets", F.expr("array()").cast("array<long>")), lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("donor"))))).alias("place"),
    )
    w = W.partitionBy("place.bucket").orderBy(F.col("place.donor"), F.col("key").desc(), F.col("text"))
    return dealt.select("doc", "text", "print", "place", F.lead("text").over(w).alias("next_text"), F.lead("print").over(w).alias("next_print")).where("place.donor = 0")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see edited_text), with likenesses to the edited and the next text."""
    pairs = with_next(df, id_col, text_col)
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut))
    staged = pairs.select("doc", n.alias("n_chars"), "print", "next_print", let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e).alias("print"))).alias("edited"))
    return staged.select(
        F.col("doc").alias(id_col),
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited.print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited.print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
