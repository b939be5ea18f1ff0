import random
import zlib

from pyspark.sql import functions as F

from folio.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(2)
    terms = list(toxicity.SEED_TERMS)
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(4000):
        token = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(token)), rng.randrange(3)
            token[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdeilmnoprst")]
            token = token or ["x"]
        token = "".join(token)
        fits = [(distance(token, t), t) for t in terms if distance(token, t) <= toxicity.edits_allowed(t)]
        got = automaton.match(token)
        assert (got is None) == (not fits), token
        if fits:
            assert (got[1], got[0]) == min(fits), token


def test_context():
    automaton = toxicity.LexiconAutomaton(list(toxicity.SEED_TERMS))
    (plain,), _ = toxicity.hits_of("you are an idi0t today", automaton)
    assert plain["edits"] == 1 and plain["addressed"] and not plain["quoted"]
    (quoted,), _ = toxicity.hits_of('he yelled "an idiot" at the door', automaton)
    assert quoted["quoted"] and not quoted["addressed"]
    (reported,), n = toxicity.hits_of("she said that moron was rude", automaton)
    assert reported["quoted"] and n == 6
    assert toxicity.hits_of("", automaton) == ([], 0)


def test_quotation_marks_of_long_lines():
    automaton, filler = toxicity.LexiconAutomaton(list(toxicity.SEED_TERMS)), "calm words go on " * 40
    quoted = lambda text: [h["quoted"] for h in toxicity.hits_of(text, automaton)[0]]
    for a, b in ('""', "“”", "«»", "„“"):
        assert quoted(f"{a}{filler} idiot {filler}{b} {filler} moron {filler} {a}fine{b}") == [True, False]
        assert quoted(f"{a}{filler}{b} loser {a}scum{b}\n{a} clown\n{b}") == [False, True, False]
    assert quoted(f"{filler}\" idiot {filler}") == [False]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    hit = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    positive = [r["score"] for r in rows if r["toxic"]]
    negative = [r["score"] for r in rows if not r["toxic"]]
    auc = sum((p > q) + 0.5 * (p == q) for p in positive for q in negative) / (len(positive) * len(negative))
    print("accuracy", hit, "auc", auc)
    assert hit > 0.97 and auc > 0.9


def test_misspellings_and_own_words(spark):
    rng, rows, labels = random.Random(8), [], []
    words = ["river", "stone", "cloud", "verein", "walks", "under", "light", "green"]
    for i in range(400):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(30)] + [f"w{i}"]
        if toxic:
            text.insert(rng.randrange(30), rng.choice(["idiot", "vermin", "frobbel"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, "green light idjot walks"), (1001, "green verein walks"), (1002, "the frobbel again")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    terms, own = toxicity.learn_terms(docs, toxicity.training_labels(known, "doc_id", "toxic"), "doc_id", "text")
    assert "verein" in own and any("frobbel".startswith(t.rstrip("*")) for t in terms)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, known).collect()}
    assert (got[1000], got[1001], got[1002]) == (1, 0, 1)
    assert all(got[i] == y for i, y in labels)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, ""), (3, ""), (None, "fine words " * 50_000), (4, "a calm day")], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["predicted"] == 1 and by[2]["score"] == by[3]["score"] == by[4]["score"] and by[4]["predicted"] == 0 and by[None]["held_out"]
    assert toxicity.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_misspelling_of_a_learned_family(spark):
    rng, rows, labels = random.Random(3), [], []
    words = ["river", "stone", "cloud", "walks", "under", "light", "green"]
    for i in range(400):
        text = [rng.choice(words) for _ in range(20)] + [f"w{i}"]
        if i % 4 == 0:
            text.insert(rng.randrange(20), "frobbel" + ["n", "st", "ung", "heit", "chen", "isch"][i // 4 % 6])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    terms, own = toxicity.learn_terms(docs, toxicity.training_labels(known, "doc_id", "toxic"), "doc_id", "text")
    assert any(t.endswith("*") and "frobbel".startswith(t[:-1]) for t in terms)
    automaton = toxicity.LexiconAutomaton([*toxicity.SEED_TERMS, *terms], own)
    assert automaton.match("frobbelnd")[1] == 0
    assert automaton.match("fropbelung") == ("frobbelung", 1) and automaton.match("vrobbeln") == ("frobbeln", 1)
    assert automaton.match("river") is None


def test_every_common_look_alike_is_kept(spark):
    rng, rows = random.Random(12), []
    alike = [f"{a}{b}orthless" for a in "abcdefghij" for b in "aeioubcdfghklmnpqrstvxyz"] + [f"worthles{a}{b}" for a in "abcdefghij" for b in "aeioubcdfghklmnpqrtvxyz"]
    for i in range(120):
        rows.append((i, "worthless " + " ".join("".join(rng.sample("abcdefghijklmnop", 5)) for _ in range(9)), 1))
    for i in range(240):
        rows.append((1000 + i, " ".join(rng.sample(alike, 120)), 0))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    _, own = toxicity.learn_terms(data, toxicity.training_labels(data, "doc_id", "toxic"), "doc_id", "text")
    assert len(alike) > 400 and set(alike) <= set(own)
