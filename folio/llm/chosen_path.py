"""N-gram Jaccard join by chosen paths (operator 3).

A document is its set of word shingles. In each of RUNS independent runs it walks down a random tree: at a node it samples
a few of its shingles by a hash of node and shingle, and follows each to the child of that name. Two sets meet in a node if
they share a path; similar sets share one in most runs, dissimilar ones hardly ever below the first level. A walk needs
nothing but the set itself, so the recursion costs no shuffle until the leaves.

Documents of equal sets are one (copies are counted, not joined). All that meet in a leaf form a bucket, and buckets are
compared by brute force, large ones block by block in tasks of their own. Two sets that meet in several buckets are compared
for good in the first of these alone, told from the documents' own lists of buckets: so no pair is counted twice and no list
of pairs is ever shuffled. A first step over these lists finds who has any pair to compare in a bucket, and only their texts
travel there. Verified links, and nothing else, are joined to classes. A true link is lost only if its ends meet in no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import spans
from folio.llm.common import materialize, release, shuffle_width
from folio.llm.components import connected_components
from folio.llm.factors import word_symbols

#: Words of a shingle; similarity from which documents are linked, as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Levels of a path; expected children of a node; shingles preselected for a level of a run. Two sets at the threshold share
#: 8 of 9 shingles, so one run misses them with probability 0.48 (a branching process with 1.24 children in common).
DEPTH, BRANCHING, POOL = 3, 1.4, 24
#: 0.48 ** 14 < 1e-4: the target recall of a single link is 0.9999.
RUNS = 14
#: Members of a block of the brute-force comparison, and shingles they may have in all (but one text is never split); a
#: shingle of more members than DENSE is counted by matrix product.
BLOCK, BLOCK_SHINGLES, DENSE = 500, 400_000, 48
#: Members of buckets that one task looks through for pairs; members of a bucket whose pairs are listed one by one there;
#: look-ups done at once.
MEMBERS, FEW, PROBES = 20_000, 32, 2_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and the texts' bounds. A shorter text is one shingle, an empty one none."""
    symbols, bounds = word_symbols(texts)
    size = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    grams = spans._gram_hashes(symbols, words)
    inside = doc_of[: len(grams)] == doc_of[words - 1 :] if len(grams) else np.zeros(0, bool)
    doc, hashes = doc_of[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((size > 0) & (size < words))
    if len(short):
        whole = [np.uint64(xxhash.xxh3_64_intdigest(symbols[bounds[d] : bounds[d + 1]].tobytes())) for d in short]
        doc, hashes = np.append(doc, short.astype(np.uint64)), np.append(hashes, np.array(whole, np.uint64))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if len(doc):
        new = np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))
        doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1, dtype=np.uint64))


def leaf_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every leaf that the documents' walks reach."""
    size = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(size)), size)
    shown = np.minimum(POOL / np.maximum(size, 1), 1.0)
    limit = np.where(shown >= 1, float(2**64 - 2048), shown * 2.0**64).astype(np.uint64)[doc_of]
    chance = np.minimum(BRANCHING / np.maximum(np.minimum(size, POOL), 1), 1.0)
    accept = np.where(chance >= 1, float(2**64 - 2048), chance * 2.0**64).astype(np.uint64)
    mixed = _mix(hashes + _MUL)
    out_doc, out_key = [], []
    for run in range(RUNS):
        node_doc = np.flatnonzero(size > 0)
        node = np.full(len(node_doc), run + 1, np.uint64) * _MUL
        for level in range(DEPTH):
            seed = np.uint64((run * DEPTH + level + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)
            x = (mixed ^ seed) * _MUL
            pool = np.flatnonzero((x ^ (x >> np.uint64(32))) <= limit)
            pool_doc = doc_of[pool]
            first = np.searchsorted(pool_doc, node_doc)
            count = np.searchsorted(pool_doc, node_doc, side="right") - first
            at = np.repeat(np.arange(len(node)), count)
            token = mixed[pool[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + first[at]]]
            child = _mix(node[at] * np.uint64(0x2545F4914F6CDD1D) + token)
            taken = _mix(child + _MUL) <= accept[node_doc[at]]
            node, node_doc = child[taken], node_doc[at[taken]]
        out_doc.append(node_doc)
        out_key.append(node)
    return np.concatenate(out_doc), np.concatenate(out_key)


def _walks(docs: DataFrame) -> DataFrame:
    """doc, sketch (digest of the set), size, keys (of the leaves) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in spans.text_chunks(batches):
            hashes, bounds = shingle_sets(texts)
            doc, key = leaf_keys(hashes, bounds)
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(len(texts) + 1)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(edges), pa.array(key[order].view(np.int64)))
            sketch = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sketch, pa.binary()), pa.array(np.diff(bounds), pa.int64()), keys], names=["doc", "sketch", "size", "keys"])

    return docs.mapInArrow(run, "doc long, sketch binary, size long, keys array<long>")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes but the roots of local edges."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


class _Meetings:
    """Rows (a document in a bucket) with the keys of the document's buckets before that one."""

    def __init__(self, lower: pa.Array):
        edges = np.asarray(lower.offsets, np.int64) - lower.offsets[0].as_py()
        self.keys, self.code = np.unique(np.asarray(lower.flatten(), np.int64), return_inverse=True)
        self.edges, self.size = edges, np.diff(edges)
        self.held = np.repeat(np.arange(len(self.size)), self.size) * max(1, len(self.keys)) + self.code  # ascending: lists are sorted

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the rows a and b of each pair, of one bucket, meet in no bucket before it."""
        out = np.ones(len(a), bool)
        if not len(a) or not len(self.held):
            return out
        total = np.cumsum(self.size[a])
        begin = 0
        while begin < len(a):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + PROBES, side="right")))
            x, y = a[begin:end], b[begin:end]
            count = self.size[x]
            pair = np.repeat(np.arange(len(x)), count)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.edges[x], count)
            probe = y[pair] * len(self.keys) + self.code[at]
            place = np.minimum(np.searchsorted(self.held, probe), len(self.held) - 1)
            out[begin + pair[self.held[place] == probe]] = False
            begin = end
        return out

    def first_between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """first() of all rows of `left` with all of `right`, as a matrix."""
        rows = np.concatenate([left, right])
        count = self.size[rows]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.edges[rows], count)
        row, (names, column) = np.repeat(np.arange(len(rows)), count), np.unique(self.code[at], return_inverse=True)
        shared = np.zeros((len(left), len(right)), bool)
        for i in range(0, len(names), 2048):
            own = (column >= i) & (column < i + 2048)
            m = np.zeros((len(rows), min(2048, len(names) - i)), np.float32)
            m[row[own], column[own] - i] = 1
            shared |= (m[: len(left)] @ m[len(left) :].T) > 0
        return ~shared


_MEMBER = "doc long, key long, copies long, size long, lower array<long>, large boolean, task long, i int, j int, side int"
_PASSED = ["doc", "key", "copies", "size", "lower", "large", "task", "i", "j", "side"]


def _with_pairs(rows: pa.Table) -> pa.Table:
    """The rows of a task that have any pair to compare here: one that meets in no bucket before."""
    key, side = (np.asarray(rows.column(c).to_numpy(), np.int64) for c in ("key", "side"))
    order = np.lexsort((side, key))
    rows, key, side = rows.take(pa.array(order)), key[order], side[order]
    meetings = _Meetings(rows.column("lower").combine_chunks())
    kept = np.zeros(len(key), bool)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(key)))
    split = bool(len(key)) and rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    few = np.repeat((size <= FEW) & ~split, size)
    for gap in range(1, FEW):
        a = np.flatnonzero((key[gap:] == key[:-gap]) & few[gap:])
        if not len(a):
            break
        a = a[meetings.first(a, a + gap)]
        kept[a] = kept[a + gap] = True
    for begin, n in zip(starts[(size > FEW) | split].tolist(), size[(size > FEW) | split].tolist(), strict=True):
        own = np.arange(begin, begin + n)
        if split:  # two blocks of a large bucket; against an empty one there is nothing to compare
            left, right = own[side[own] == 0], own[side[own] == 1]
            pairs = meetings.first_between(left, right)
        else:
            left = right = own
            pairs = np.triu(meetings.first_between(own, own), 1)
        kept[left] |= pairs.any(axis=1)
        kept[right] |= pairs.any(axis=0)
    return rows.select(_PASSED).filter(pa.array(kept))


def common_counts(hashes: np.ndarray, bounds: np.ndarray, left: int) -> np.ndarray:
    """Sizes of the intersections of each of the first `left` sets with each of the others (or with each other, if those are all)."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(hashes, kind="stable")
    token, row = hashes[order], row[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(token)))
    of = np.repeat(np.arange(len(first)), times)
    width = n if left == n else n - left
    shift = 0 if left == n else left
    counts = np.zeros(left * width, np.int32)
    # Shingles of few members: all their pairs, by distance in the sorted list.
    few = (times[of] > 1) & (times[of] <= DENSE)
    r, t = row[few], of[few]
    for gap in range(1, DENSE):
        same = t[gap:] == t[:-gap]
        if not same.any():
            break
        a, b = r[:-gap][same], r[gap:][same]  # a < b: rows ascend within a shingle
        use = (a < left) & (b >= shift) if shift else slice(None)
        counts += np.bincount(a[use] * width + b[use] - shift, minlength=len(counts)).astype(np.int32)
    counts = counts.reshape(left, width)
    # Shingles of many members: a matrix product, a slice of shingles at a time.
    many = np.flatnonzero(times > DENSE)
    for i in range(0, len(many), 2048):
        own = many[i : i + 2048]
        column = np.full(len(first), -1, np.int64)
        column[own] = np.arange(len(own))
        hit = column[of] >= 0
        m = np.zeros((n, len(own)), np.float32)
        m[row[hit], column[of[hit]]] = 1
        part = (m[:left] @ m[shift:].T).astype(np.int32)
        counts += np.triu(part, 1) if left == n else part
    return counts


def _sets_in_chunks(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of many texts, with bounded arrays on the way."""
    parts, edges, begin, held = [], [np.zeros(1, np.int64)], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most or i == len(texts) - 1:
            hashes, bounds = shingle_sets(texts[begin : i + 1])
            parts.append(hashes)
            edges.append(bounds[1:] + edges[-1][-1])
            begin, held = i + 1, 0
    return np.concatenate(parts), np.concatenate(edges)


def _compare(rows: pa.Table) -> pa.Table:
    """Links of the documents of one task that have any: doc, links (copies counted), root (least document that its links reach here)."""
    docs, copies, side, key, size = (np.asarray(rows.column(c).to_numpy(), np.int64) for c in ("doc", "copies", "side", "key", "size"))
    texts = rows.column("text").cast(pa.binary())
    meetings = _Meetings(rows.column("lower").combine_chunks())
    n_links = np.zeros(len(docs), np.int64)
    ends: list[tuple] = []
    # A task holds whole small buckets, in the order of keys cut into blocks, or one or two blocks (sides) of a large one.
    order = np.lexsort((docs, key, side))
    split = bool(len(docs)) and rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    if split:
        work = [(order[side[order] == 0], order[side[order] == 1])]
        work = [w for w in work if len(w[0]) and len(w[1])]
    else:
        edges = [0]
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, np.int64)
        before = np.append(0, np.cumsum(size[order]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=bool(len(starts))):
            if (b - edges[-1] > BLOCK or before[b] - before[edges[-1]] > BLOCK_SHINGLES) and a > edges[-1]:
                edges.append(a)
        work = [(order[a:b],) for a, b in zip(edges, [*edges[1:], len(order)], strict=True)]
    for part in work:
        at = np.concatenate(part)
        hashes, bounds = _sets_in_chunks([texts[int(i)].as_py() for i in at])
        sizes = np.diff(bounds)
        left = len(part[0])
        common = common_counts(hashes, bounds, left)
        shift = 0 if left == len(at) else left
        total = sizes[:left, None] + sizes[None, shift:] - common
        near = DENOMINATOR * common >= NUMERATOR * total
        near &= common > 0
        x, y = np.nonzero(near)
        x, y = at[x], at[y + shift]
        # Small buckets that stand side by side were compared with each other, too; and each pair counts in its first bucket.
        same = key[x] == key[y]
        x, y = x[same], y[same]
        first = meetings.first(x, y)
        x, y = x[first], y[first]
        n_links += np.bincount(x, copies[y], len(docs)).astype(np.int64) + np.bincount(y, copies[x], len(docs)).astype(np.int64)
        ends.append((docs[x], docs[y]))
    a, b = _roots(*(np.concatenate(c) for c in zip(*ends, strict=True))) if ends else (docs[:0], docs[:0])
    root = docs.copy()
    place = np.searchsorted(a, docs)
    if len(a):
        hit = a[np.minimum(place, len(a) - 1)] == docs
        root[hit] = b[place[hit]]
    linked = np.flatnonzero(n_links)
    return pa.table({"doc": pa.array(docs[linked]), "links": pa.array(n_links[linked]), "root": pa.array(root[linked])})


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, class_id long, n_links long, n_copies long, is_representative boolean of every row.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8; classes are the
    connected components, named by their least document, which represents them. n_links counts the other documents linked
    to a row, n_copies those of the same set, itself included.

    Words are separated by white space. A text of fewer than five words is one shingle; null and empty texts have no
    shingle and are copies of each other. Rows that share an id, or have none, are documents of their own (class_id is then
    a running key in the order of id, text). An empty table gives an empty result; other columns are not read.
    """
    docs = spans.keyed(df, id_col, text_col)
    width = shuffle_width(df.sparkSession)
    walks = materialize(_walks(docs.select("doc", "text")), "walks")
    sets = materialize(walks.groupBy("sketch").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size")), "sets")
    leads = materialize(walks.select("doc", "keys").join(sets.select(F.col("rep").alias("doc"), "copies", "size"), "doc"), "leads")
    # Buckets of one set lead to no pair. The counts are combined map-side; the join splits a key that many sets have.
    entries = leads.select("doc", "copies", "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    met = materialize(entries.join(shared, "key"), "met")
    release(leads)
    held = F.sort_array(F.collect_list(F.struct("key", "n", "shingles")))
    lists = met.groupBy("doc", "copies", "size").agg(held.alias("held")).select("doc", "copies", "size", F.transform("held", lambda h: h["key"]).alias("keys"), F.explode("held").alias("h"))
    key, blocks = F.col("h.key"), F.ceil(F.greatest(F.col("h.n") / F.lit(BLOCK), F.col("h.shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    members = lists.select("doc", key.alias("key"), "copies", "size", F.filter("keys", lambda k: k < key).alias("lower"), blocks.alias("blocks"))
    # A small bucket is wholly in one task; block i of a large one meets each other block j in a task of its own.
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own > j, 1).otherwise(0).alias("side")))
    dealt = lambda n: F.when(F.col("large"), F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(n)))
    large = F.col("blocks") > 1
    placed = members.select("doc", "key", "copies", "size", "lower", large.alias("large"), F.explode(F.when(large, cut).otherwise(whole)).alias("p"))
    placed = placed.select("doc", "key", "copies", "size", "lower", "large", dealt(max(width, -(-met.count() // MEMBERS))).alias("task"), "p.i", "p.j", "p.side")
    busy = materialize(placed.groupBy("large", "task", "i", "j").applyInArrow(_with_pairs, _MEMBER), "busy")
    release(met)
    shingles = busy.where("not large").agg(F.sum("size")).first()[0] or 0
    busy_here = busy.withColumn("task", dealt(max(width, -(-shingles // (BLOCK_SHINGLES // 3)))))
    # By a shuffle at every size: the members grow with the corpus.
    texts = docs.select("doc", "text").join(busy_here.hint("merge"), "doc")
    links = materialize(texts.groupBy("large", "task", "i", "j").applyInArrow(_compare, "doc long, links long, root long"), "links")
    release(busy)
    counted = materialize(links.groupBy("doc").agg(F.sum("links").alias("links")), "counted")
    classes = connected_components(links.where("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")))
    release(links)
    per_set = sets.join(counted.select(F.col("doc").alias("rep"), "links"), "rep", "left").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
    per_set = per_set.select("sketch", "copies", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = docs.select("doc", "id").join(walks.select("doc", "sketch").hint("merge"), "doc").join(per_set, "sketch")
    return out.select(
        F.col("id").alias(id_col), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), (F.col("doc") == F.col("class_id")).alias("is_representative")
    )
