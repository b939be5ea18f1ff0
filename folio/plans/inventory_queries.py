"""The rest of the operator inventory, one query for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.adapters import AS_OF, SCORES_AS_OF
from folio.functions import latex, pdf, scripts
from folio.functions import text as T
from folio.operators import catalog as C
from folio.operators import cost as K
from folio.operators import quality as Q
from folio.operators import state as S
from folio.plans import search
from folio.plans.analytics_queries import _BASE, _D, _OPTIONS, _SCORED, base
from folio.plans.registry import Tables, query
from folio.sources import feeds, images, storage
from folio.streaming import jobs

_T = f"TIMESTAMP '{AS_OF}'"


def _entry() -> Column:
    """A paper as an entry of an Atom feed."""
    title = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), (F.col("seq") + 10000).cast("string"), F.lit("v1</id><title>"), title, F.lit("</title><published>"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("</published><author><name>A</name></author><author><name>B &amp; C</name></author><summary>s</summary></entry>"),
    )


_ENTRIES = "SELECT concat('2401.', CAST(10000 + seq AS STRING)) AS paper, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, strftime(created_at, '%Y-%m-%d') AS published, 2 AS n_authors"


@query("S14_atom_feed", f"{_ENTRIES}, CAST(1 AS BIGINT) AS total, id FROM papers", "papers")
def s14(t: Tables):
    xml = F.concat(F.lit("<feed><opensearch:totalResults x='y'>1</opensearch:totalResults>"), _entry(), F.lit("</feed>"))
    e = t["papers"].select("id", F.explode(feeds.feed_entries(xml)).alias("e"), feeds.feed_total(xml).alias("total"))
    return e.select("id", F.col("e.id").alias("paper"), "e.title", "e.published", F.size("e.authors").alias("n_authors"), "total")


@query("S14_feed_stream", f"{_ENTRIES}, CAST(20 AS BIGINT) AS total FROM papers", "papers")
def s14_stream(t: Tables):
    # Pages of 20 entries and more, put into a folder at two times; the stream takes what is there and then the rest.
    folder, out, checkpoint = (storage.new_path(t.spark, f"feed-{x}") for x in ("pages", "entries", "checkpoint"))
    pages = t["papers"].withColumn("entry", _entry()).groupBy(F.floor(F.col("seq") / 20).alias("page")).agg(F.array_join(F.array_sort(F.collect_list("entry")), "\n").alias("entries"))
    pages = pages.select("page", F.concat(F.lit("<feed>\n<opensearch:totalResults>20</opensearch:totalResults>\n"), "entries", F.lit("</feed>")).alias("value"))
    for half in range(2):
        some = pages.where(F.col("page") % 2 == half)
        some.repartition(8, "page").select("value").write.mode("append").text(folder)
        jobs.run_to_parquet(feeds.entry_stream(t.spark, folder), out, checkpoint)
    entries = t.spark.read.schema(feeds.entry_stream(t.spark, folder).schema).parquet(out)
    return entries.select(F.col("id").alias("paper"), "title", "published", F.size("authors").alias("n_authors"), "total")


@query("S18_blob_keys", "SELECT id, concat('audio/', paper_id, '/', CAST(id AS STRING), '.mp3') AS audio, concat('transcripts/', paper_id, '/', CAST(id AS STRING), '.txt') AS transcript FROM narration_versions", "narration_versions")
def s18(t: Tables):
    return t["narration_versions"].select("id", feeds.audio_key(F.col("paper_id"), F.col("id")).alias("audio"), feeds.transcript_key(F.col("paper_id"), F.col("id")).alias("transcript"))


@query("S21_copy_and_remap", "SELECT id, CASE WHEN status IN ('narrated', 'narrating') THEN 'ready' WHEN status = 'failed' THEN 'error' END AS status FROM papers", "papers")
def s21(t: Tables):
    return t["papers"].select("id", S.remap(F.col("status"), {"narrated": "ready", "narrating": "ready", "failed": "error"}).alias("status"))


@query("P16_price_lookup", "SELECT v.id, coalesce(p.rate, 0) AS rate FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model FROM narration_versions) v LEFT JOIN (VALUES ('gpt-4o', 2.5e0), ('gpt-4o-mini', 0.15e0)) p(model, rate) ON p.model = v.model", "narration_versions")
def p16(t: Tables):
    k = F.col("id") % 3
    asked = t["narration_versions"].select("id", F.when(k == 0, "gpt-4o").when(k == 1, "gpt-4o-mini").otherwise("other").alias("model"), F.lit("openai").alias("provider"))
    return asked.join(F.broadcast(K.price_table(t.spark)), ["provider", "model"], "left").select("id", F.coalesce("input_rate", F.lit(0.0)).alias("rate"))


@query("P20_submit_reasons", f"SELECT s.id, CASE WHEN length(s.title) < 20 THEN 'title too short' WHEN c.n > 2 THEN 'over quota' END AS reason FROM papers s JOIN (SELECT submitted_by_ip, count(*) AS n FROM papers WHERE created_at > {_T} - INTERVAL '1' DAY GROUP BY submitted_by_ip) c USING (submitted_by_ip)", "papers")
def p20(t: Tables):
    recent = t["papers"].where(C.since(F.col("created_at"), AS_OF, 1)).groupBy("submitted_by_ip").agg(F.count("*").alias("n"))
    return t["papers"].join(recent, "submitted_by_ip").select("id", F.when(F.char_length("title") < 20, "title too short").when(F.col("n") > 2, "over quota").alias("reason"))


@query("J1_hits_to_rows", "SELECT id, title, status FROM papers WHERE len(list_filter(string_split_regex(lower(strip_accents(concat(title, ' ', abstract))), '[^\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'thing'))) > 0", "papers")
def j1(t: Tables):
    hits = search.search(t["papers"], "thing", "id", ["title", "abstract"])
    return t["papers"].join(hits, "id").select("id", "title", "status")


@query("J6_scored_versions", f"SELECT id, mode, period FROM ({_BASE}) b", *_SCORED)
def j6(t: Tables):
    return base(t).select("id", "mode", "period")


@query("J7_latest_period_scores", f"SELECT b.id FROM ({_BASE}) b JOIN (SELECT mode, period FROM (SELECT mode, period, row_number() OVER (PARTITION BY mode ORDER BY max(scored_at) DESC, period DESC) AS rn FROM ({_BASE}) c GROUP BY mode, period) x WHERE rn = 1) l ON l.mode = b.mode AND l.period = b.period", *_SCORED)
def j7(t: Tables):
    b = base(t)
    return b.join(Q.current(b).select("mode", "period"), ["mode", "period"]).select("id")


@query(
    "J8_unscored_parsers",
    f"""SELECT commit_hash, tier FROM (SELECT *, CASE WHEN tier = 'base' THEN 'regex' ELSE 'llm' END AS m FROM parser_versions) p WHERE registered_at >= {_D} - INTERVAL '90' DAY
        AND NOT EXISTS (SELECT 1 FROM ({_BASE}) b WHERE b.period = p.commit_hash AND b.mode = p.m AND b.scored_at >= {_D} - INTERVAL '90' DAY)""",
    *_SCORED, "parser_versions",
)
def j8(t: Tables):
    return Q.unscored(base(t), t["parser_versions"], SCORES_AS_OF).select("commit_hash", "tier")


@query("J10_positions_kept", "SELECT o.paper_id FROM (SELECT * FROM listens WHERE user_token = 'u1') o LEFT JOIN (SELECT * FROM listens WHERE user_token = 'u2') n ON n.paper_id = o.paper_id AND n.updated_at >= o.updated_at WHERE n.paper_id IS NULL", "listens")
def j10(t: Tables):
    old, new = (t["listens"].where(F.col("user_token") == u).select("paper_id", F.col("updated_at").alias(a)) for u, a in (("u1", "old_at"), ("u2", "new_at")))
    later = old.join(new, "paper_id").where("new_at >= old_at").select("paper_id")
    return old.join(later, "paper_id", "left_anti").select("paper_id")


@query("J21_figures_to_files", "SELECT list_id, paper_id, position FROM (SELECT list_id, paper_id, position, row_number() OVER (PARTITION BY list_id ORDER BY position, paper_id) AS rn FROM list_items WHERE paper_id IN (SELECT id FROM papers)) x WHERE rn <= 5", "list_items", "papers")
def j21(t: Tables):
    refs = t["list_items"].select("list_id", "position", "paper_id", F.explode(F.array(F.concat(F.lit("fig/"), "paper_id"), F.col("paper_id"))).alias("key"))
    files = t["papers"].select(F.substring_index(F.concat("id", F.lit(".png")), ".", 1).alias("key"))
    found = refs.join(files, "key").dropDuplicates(["list_id", "position", "paper_id"])
    return found.withColumn("rn", F.row_number().over(W.partitionBy("list_id").orderBy("position", "paper_id"))).where("rn <= 5").select("list_id", "paper_id", "position")


@query("J22_reinsert", "SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: '<' || CASE WHEN i % 5 = 0 THEN '' ELSE x END || '>'), '; ') AS body FROM documents")
def j22(t: Tables):
    # Each line of a document is an element's description, every fifth is missing; the body has only placeholders.
    lines = t["documents"].select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    name = lambda i: F.concat(F.lit("TABLE_"), F.format_string("%03d", i))
    bodies = lines.select("doc_id", F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("<" + scripts.PLACEHOLDER), name(i + 1), F.lit(">"))), "; ").alias("body"))
    told = lines.select("doc_id", F.posexplode("lines").alias("i", "told")).where("(i + 1) % 5 <> 0").select("doc_id", name(F.col("i") + 1).alias("element_id"), "told")
    return scripts.reinserted(bodies, told, "doc_id")


_SIZES = "1 + doc_id * 37 % 3000", "1 + doc_id * 53 % 2500"


@query(
    "D8_chosen_images",
    f"""SELECT element, CAST(doc_id AS VARCHAR) AS path, CASE WHEN big > 1568 THEN 'image/png' ELSE media END AS media, CAST(CASE WHEN big > 1568 THEN floor(w * (1568.0e0 / big)) ELSE w END AS INTEGER) AS width,
           CAST(CASE WHEN big > 1568 THEN floor(h * (1568.0e0 / big)) ELSE h END AS INTEGER) AS height, big > 1568 AS downscaled
    FROM (SELECT *, greatest(w, h) AS big, row_number() OVER (PARTITION BY element ORDER BY doc_id DESC) AS n
          FROM (SELECT doc_id, source AS element, {_SIZES[0]} AS w, {_SIZES[1]} AS h, ['image/png', 'image/jpeg', 'image/gif'][doc_id % 4 + 1] AS media,
                       CASE doc_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 34 WHEN 2 THEN 10 ELSE 4 END + octet_length(encode(coalesce(text, ''))) AS size FROM documents) f
          WHERE media IS NOT NULL AND size <= 4000) c WHERE n <= 5""",
)
def d8(t: Tables):
    # A file for each document: a header of one of three kinds (or none), a size in pixels told by its id, and its text as data.
    number = lambda sql, size: F.unhex(F.lpad(F.hex(F.expr(sql)), 2 * size, "0"))
    low_first = lambda sql: F.concat(number(f"({sql}) % 256", 1), number(f"({sql}) div 256", 1))
    (w, h), data, fixed = _SIZES, F.coalesce("text", F.lit("")).cast("binary"), lambda digits: F.unhex(F.lit(digits))
    png = F.concat(fixed(images.PNG + "0000000D49484452"), number(w, 4), number(h, 4), data)
    jpeg = F.concat(fixed(images.JPEG + "FFE000104A46494600010100000100010000FFFFFE0002FFC0001108"), number(h, 2), number(w, 2), data)
    gif = F.concat(fixed(images.GIF + "3961"), low_first(w), low_first(h), data)
    k = F.col("doc_id") % 4
    files = t["documents"].select(F.col("source").alias("element"), "doc_id", F.col("doc_id").cast("string").alias("path"), F.when(k == 0, png).when(k == 1, jpeg).when(k == 2, gif).otherwise(F.concat(fixed("25504446"), data)).alias("content"))
    return images.chosen(files.withColumn("newest", -F.col("doc_id")), "element", ["newest"], most_bytes=4000)


def _refusing(prompt: str, granted: int) -> str:
    if "@" in prompt:
        raise ValueError("a model that takes no addresses")
    return prompt


def _describing(elements: list) -> dict[str, str]:
    if any(int(e.caption) % 7 == 0 for e in elements):
        raise ValueError("a describer that fails on some figures")
    return {e.element_id: f"figure {e.caption}" for e in elements}


@query(
    "D6_routed_scripts",
    """SELECT doc_id, wanted, CASE WHEN wanted = 'llm' AND NOT contains(text, '@') THEN 'llm' WHEN wanted <> 'regex' AND doc_id % 7 <> 0 THEN 'hybrid' ELSE 'regex' END AS used
    FROM (SELECT doc_id, coalesce(text, '') AS text, ['llm', 'hybrid', 'regex'][doc_id % 3 + 1] AS wanted FROM documents) d""",
)
def d6(t: Tables):
    source = F.concat(F.lit("\\begin{document}\\section{One}" + "Prose of its own. " * 20), F.regexp_replace(F.coalesce("text", F.lit("")), "([%$&#])", r"\\$1"), F.lit("\\begin{figure}\\caption{"), F.col("doc_id").cast("string"), F.lit("}\\end{figure}\\end{document}"))
    wanted = F.element_at(F.array(F.lit("llm"), F.lit("hybrid"), F.lit("regex")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = t.spread("documents").select("doc_id", source.alias("source"), wanted.alias("variant"))
    return scripts.routed_scripts(rows, "doc_id", "source", "variant", _refusing, _describing).select("doc_id", "wanted", "used")


@query("A2_visits_per_paper", f"SELECT paper_id, count(*) AS n FROM page_visits WHERE visited_at > {_T} - INTERVAL '7' DAY GROUP BY paper_id", "page_visits")
def a2(t: Tables):
    return t["page_visits"].where(C.since(F.col("visited_at"), AS_OF, 7)).groupBy("paper_id").agg(F.count("*").alias("n"))


@query("A3_items_per_list", "SELECT list_id, count(*) AS n FROM list_items GROUP BY list_id", "list_items")
def a3(t: Tables):
    return t["list_items"].groupBy("list_id").agg(F.count("*").alias("n"))


@query("A9_last_score_per_period", f"SELECT mode, period, max(scored_at) AS last FROM ({_BASE}) b GROUP BY mode, period", *_SCORED)
def a9(t: Tables):
    return base(t).groupBy("mode", "period").agg(F.max("scored_at").alias("last"))


@query("A10_latest_ten", f"SELECT mode, count(*) AS n FROM (SELECT mode, row_number() OVER (PARTITION BY mode ORDER BY scored_at DESC, id DESC) AS rn FROM ({_BASE}) b) x WHERE rn <= 10 GROUP BY mode", *_SCORED)
def a10(t: Tables):
    w = W.partitionBy("mode").orderBy(F.col("scored_at").desc(), F.col("id").desc())
    return base(t).withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("mode").agg(F.count("*").alias("n"))


@query("A19_running_mean_of_two", "SELECT paper_id, list_reduce(list(CAST(stars AS DOUBLE) ORDER BY created_at, id), lambda a, x: (a + x) / 2) AS folded FROM ratings GROUP BY paper_id", "ratings")
def a19(t: Tables):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "stars"))), lambda s: s["stars"].cast("double"))
    grouped = t["ratings"].groupBy("paper_id").agg(ordered.alias("s"))
    return grouped.select("paper_id", F.aggregate(F.slice("s", 2, 1 << 30), F.get("s", F.lit(0)), lambda a, x: (a + x) / 2).alias("folded"))


@query("A21_cost_accumulator", "SELECT paper_id, narration_tier, CAST(sum(CAST(llm_cost AS DECIMAL(28, 12))) AS DOUBLE) AS cost, CAST(sum(script_latency_ms) AS BIGINT) AS tokens, last(scripter_mode ORDER BY id) FILTER (scripter_mode IS NOT NULL) AS model FROM narration_versions GROUP BY paper_id, narration_tier", "narration_versions")
def a21(t: Tables):
    return K.accumulated(t["narration_versions"], ["paper_id", "narration_tier"])


@query("A21_cost_totals", "SELECT paper_id, CAST(sum(CAST(llm_cost AS DECIMAL(28, 12))) AS DOUBLE) AS cost, CAST(sum(script_latency_ms) AS BIGINT) AS tokens, last(scripter_mode ORDER BY id) FILTER (scripter_mode IS NOT NULL) AS model FROM narration_versions GROUP BY paper_id", "narration_versions")
def a21_totals(t: Tables):
    return K.accumulated(t["narration_versions"])


@query("A22_numeric_share", "SELECT doc_id, CAST(len(list_filter(w, lambda t: regexp_matches(t, '^[0-9.,±]+%?$'))) AS INTEGER) AS numbers FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) x")
def a22(t: Tables):
    return t["documents"].select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w.rlike("^[0-9.,±]+%?$"))).alias("numbers"))


_HEAD = "array_to_string(string_split_regex(trim(title), '\\s+')[1:4], ' ')"
_TAIL_OF = "substr(abstract, 501)"


@query(
    "A23_running_title",
    f"""SELECT id, CASE WHEN len(string_split_regex(trim(title), '\\s+')) >= 3 AND len(regexp_extract_all({_TAIL_OF}, '(?i)' || regexp_escape({_HEAD}))) >= 2
          THEN substr(abstract, 1, 500) || regexp_replace({_TAIL_OF}, '(?i)' || regexp_escape({_HEAD}), '', 'g') ELSE abstract END AS text FROM papers""",
    "papers",
)
def a23(t: Tables):
    return t["papers"].select("id", pdf.without_running_title(F.col("abstract"), F.col("title")).alias("text"))


@query("W3_newest_script", "SELECT paper_id, first(id ORDER BY created_at DESC, id DESC) AS id FROM narration_versions WHERE scripter_mode IS NOT NULL GROUP BY paper_id", "narration_versions")
def w3(t: Tables):
    v = t["narration_versions"].where("scripter_mode is not null")
    return C.latest_per_key(v, ["paper_id"], [F.col("created_at").desc(), F.col("id").desc()]).select("paper_id", "id")


@query("W4_ordinals", "SELECT list_id, paper_id, position, CASE WHEN n <= 10 THEN ['First', 'Second', 'Third', 'Fourth', 'Fifth', 'Sixth', 'Seventh', 'Eighth', 'Ninth', 'Tenth'][n] ELSE CAST(n AS STRING) || 'th' END AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY position) AS n FROM list_items) x", "list_items")
def w4(t: Tables):
    from folio.functions.latex import ORDINALS

    n = F.row_number().over(W.partitionBy("list_id").orderBy("position"))
    word = F.coalesce(F.get(F.array(*[F.lit(o) for o in ORDINALS]), F.col("n") - 1), F.concat(F.col("n").cast("string"), F.lit("th")))
    return t["list_items"].withColumn("n", n).select("list_id", "paper_id", "position", word.alias("ordinal"))


@query("O2_visits_then_newest", "SELECT p.id, coalesce(v.n, 0) AS n FROM papers p LEFT JOIN (SELECT paper_id, count(*) AS n FROM page_visits GROUP BY paper_id) v ON v.paper_id = p.id ORDER BY n DESC, p.created_at DESC, p.id DESC LIMIT 30", "papers", "page_visits")
def o2(t: Tables):
    return C.popular(t["papers"], t["page_visits"], AS_OF, 4000, 30).select("id", F.col("visit_count").alias("n"))


@query("O4_name_without_case", "SELECT id, name FROM lists ORDER BY lower(name), id", "lists")
def o4(t: Tables):
    return t["lists"].orderBy(F.lower("name"), "id").select("id", "name")


@query("O8_options_by_rank", f"SELECT id, llm_model, tts_model, quality_rank, total_cost FROM ({_OPTIONS}) o", "papers")
def o8(t: Tables):
    return K.option_matrix(t["papers"]).orderBy(F.col("quality_rank").desc(), "total_cost", "id", "llm_model").select("id", "llm_model", "tts_model", "quality_rank", "total_cost")


@query("O9_tier_order", "SELECT id, CASE narration_tier WHEN 'plus3' THEN 3 WHEN 'plus2' THEN 2 WHEN 'plus1' THEN 1 ELSE 0 END AS tier_rank FROM narration_versions ORDER BY 2 DESC, id", "narration_versions")
def o9(t: Tables):
    rank = T.by_rank(F.col("narration_tier"), [(n, r) for n, _, r, _ in K.VOICE_TIERS])
    return t["narration_versions"].select("id", rank.alias("tier_rank")).orderBy(F.col("tier_rank").desc(), "id")


@query("O13_top_ten", "SELECT paper_id, count(*) AS n FROM page_visits GROUP BY paper_id ORDER BY n DESC, paper_id LIMIT 10", "page_visits")
def o13(t: Tables):
    return t["page_visits"].groupBy("paper_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "paper_id").limit(10)


@query("M4_delete_then_insert", "SELECT paper_id, rater_token, stars FROM ratings WHERE NOT (paper_id = '5' AND (rater_token = 'u5' OR rater_ip = 'ip5')) UNION ALL SELECT '5', 'u5', 4", "ratings")
def m4(t: Tables):
    new = t.spark.sql("select '5' as paper_id, 'u5' as rater_token, cast(4 as bigint) as stars")
    gone = (F.col("paper_id") == "5") & ((F.col("rater_token") == "u5") | (F.col("rater_ip") == "ip5"))
    return t["ratings"].where(~gone).select("paper_id", "rater_token", "stars").unionByName(new)


@query("M14_reset", "SELECT id, CASE WHEN seq % 9 = 0 THEN 'unnarrated' ELSE status END AS status, CASE WHEN seq % 9 = 0 THEN NULL ELSE error_message END AS error_message FROM papers", "papers")
def m14(t: Tables):
    reset = F.col("seq") % 9 == 0
    return t["papers"].select("id", F.when(reset, "unnarrated").otherwise(F.col("status")).alias("status"), F.when(~reset, F.col("error_message")).alias("error_message"))


@query("M15_replace_partial", "SELECT id FROM narration_versions v WHERE audio_key IS NOT NULL OR NOT EXISTS (SELECT 1 FROM narration_versions w WHERE w.paper_id = v.paper_id AND w.narration_tier = v.narration_tier AND w.audio_key IS NOT NULL)", "narration_versions")
def m15(t: Tables):
    v = t["narration_versions"]
    done = v.where("audio_key is not null").select("paper_id", "narration_tier").distinct()
    return v.where("audio_key is not null").select("id").unionByName(v.where("audio_key is null").join(done, ["paper_id", "narration_tier"], "left_anti").select("id"))


@query("M16_backfill_best", "SELECT p.id, b.best FROM papers p LEFT JOIN (SELECT paper_id, max_by(id, quality_rank * 1000000 - id % 1000000) AS best FROM narration_versions GROUP BY paper_id) b ON b.paper_id = p.id WHERE p.status = 'narrated'", "papers", "narration_versions")
def m16(t: Tables):
    best = t["narration_versions"].groupBy(F.col("paper_id").alias("id")).agg(F.max_by("id", F.col("quality_rank") * 1000000 - F.col("id") % 1000000).alias("best"))
    return t["papers"].where("status = 'narrated'").join(best, "id", "left").select("id", "best")


@query("M18_register_once", "SELECT commit_hash, tier FROM parser_versions", "parser_versions")
def m18(t: Tables):
    old = t["parser_versions"].select("commit_hash", "tier")
    return S.insert_absent(old, old.where("commit_hash like '%1'"), ["commit_hash", "tier"])


@query("M21_delete_rating", "SELECT id FROM ratings WHERE NOT (paper_id = '5' AND rater_token = 'u5')", "ratings")
def m21(t: Tables):
    gone = t["ratings"].where("paper_id = '5' and rater_token = 'u5'").select("id")
    return t["ratings"].join(gone, "id", "left_anti").select("id")


@query("M22_patch_lists", "SELECT id, CASE WHEN id % 4 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 8 = 0 THEN 1 ELSE publicly_listed END AS publicly_listed FROM lists", "lists")
def m22(t: Tables):
    patch = t["lists"].where("id % 4 = 0").select("id", F.lit("renamed").alias("new_name"), F.when(F.col("id") % 8 == 0, F.lit(1)).alias("new_flag"))
    return t["lists"].join(patch, "id", "left").select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_flag", "publicly_listed").alias("publicly_listed"))


@query("M23_scalar_set", "SELECT id, CASE WHEN id = '7' THEN 123 ELSE script_char_count END AS script_char_count FROM papers", "papers")
def m23(t: Tables):
    return t["papers"].select("id", F.when(F.col("id") == "7", F.lit(123)).otherwise(F.col("script_char_count")).alias("script_char_count"))


@query("M24_playlist_append", "SELECT list_id, paper_id, position FROM list_items UNION ALL SELECT l.id, 'extra', coalesce(max(i.position), -1) + 1 FROM lists l LEFT JOIN list_items i ON i.list_id = l.id WHERE l.id IN (3, 5) GROUP BY l.id", "lists", "list_items")
def m24(t: Tables):
    chosen = t["lists"].where("id in (3, 5)").select(F.col("id").alias("list_id"), F.lit(0).alias("seq"), F.lit("extra").alias("paper_id"))
    return S.append_items(t["list_items"], chosen)


@query("X19_complexity", "SELECT id, CAST(2 * (seq % 3) + seq % 4 + greatest(0, seq % 3 * 5 + seq % 4 * 2 - 50) // 20 AS BIGINT) AS score FROM papers", "papers")
def x19(t: Tables):
    formula = F.concat(F.repeat(F.lit("\\frac"), (F.col("seq") % 3).cast("int")), F.repeat(F.lit("x^"), (F.col("seq") % 4).cast("int")))
    count = lambda p: F.regexp_count("f", F.lit(p))
    score = 2 * count(r"\\frac") + 2 * count(r"\\(?:sum|prod|int)") + 3 * count(r"\\begin\{") + count(r"\^") + count("_") + F.floor(F.greatest(F.lit(0), F.char_length("f") - 50) / 20)
    return t["papers"].withColumn("f", formula).select("id", score.cast("long").alias("score"))


@query("X48_voice_tiers", "SELECT id, CASE narration_tier WHEN 'plus3' THEN 'Premium' WHEN 'plus2' THEN 'Studio' WHEN 'plus1' THEN 'Enhanced' ELSE 'Standard' END AS shown FROM narration_versions", "narration_versions")
def x48(t: Tables):
    return t["narration_versions"].select("id", S.remap(F.col("narration_tier"), {n: d for n, d, _, _ in K.VOICE_TIERS}, F.lit("Standard")).alias("shown"))


@query("X50_import_tokens", "SELECT list_id, array_to_string(list_distinct(list(concat('2401.', CAST(10000 + CAST(paper_id AS BIGINT) AS STRING)))), '') IS NOT NULL AS ok, count(DISTINCT paper_id) AS n FROM list_items GROUP BY list_id", "list_items")
def x50(t: Tables):
    pasted = F.array_join(F.collect_list(F.concat(F.lit("2401."), (F.col("paper_id").cast("long") + 10000).cast("string"))), " , ;")
    return t["list_items"].groupBy("list_id").agg(pasted.alias("p")).select("list_id", F.lit(True).alias("ok"), F.size(T.import_ids(F.col("p"))).cast("long").alias("n"))


@query("N1_proxy_tokens", "SELECT id, CASE WHEN coalesce(latex_char_count, 0) > 0 THEN latex_char_count / 4e0 + figure_count * 700 ELSE script_char_count / 4e0 * 3e0 END AS tokens_in, script_char_count / 4e0 AS tokens_out FROM papers", "papers")
def n1(t: Tables):
    i, o = K.proxy_tokens(F.col("script_char_count"), F.col("latex_char_count"), F.col("figure_count"), F.lit("anthropic"))
    return t["papers"].select("id", i.alias("tokens_in"), o.alias("tokens_out"))


@query("N3_dot_product", "SELECT id, greatest(0e0, 0.5e0 * latex_char_count + -10e0 * figure_count + 0e0 * coalesce(tar_bytes, 0) + 1e0 * script_char_count + -500e0) AS predicted FROM papers", "papers")
def n3(t: Tables):
    x = [F.col(c) for c in K.FEATURES]
    return t["papers"].select("id", K.dot(F.array(*[F.lit(c) for c in (0.5, -10.0, 0.0, 1.0)]), x, F.lit(-500.0)).alias("predicted"))


@query("N4_longer_scripts", "SELECT id, CAST(ceil(script_char_count * 1.33e0) AS BIGINT) AS chars FROM papers", "papers")
def n4(t: Tables):
    return t["papers"].select("id", F.ceil(F.col("script_char_count") * F.lit(K.SCRIPT_GROWTH)).alias("chars"))


@query("N6_processing_minutes", "SELECT id, concat('~', CAST(greatest(1, CAST(floor(script_char_count / 1000e0 * 3e0 / 60 + 0.5e0) AS BIGINT)) AS STRING), ' min') AS shown FROM papers", "papers")
def n6(t: Tables):
    minutes = F.greatest(F.lit(1).cast("long"), F.floor(F.col("script_char_count") / 1000 * F.lit(3.0) / 60 + F.lit(0.5)))
    return t["papers"].select("id", F.concat(F.lit("~"), minutes.cast("string"), F.lit(" min")).alias("shown"))


@query("N9_gate", "SELECT id, figure_count >= 5 AND script_char_count < 3000 AND latex_char_count < 6000 AS used FROM papers", "papers")
def n9(t: Tables):
    return t["papers"].select("id", K.passes_gate(F.col("figure_count"), F.col("script_char_count"), F.col("latex_char_count"), F.lit(3000), F.lit(6000)).alias("used"))


@query("N12_json_arrays", "SELECT id, concat('[\"', submitted_by_city, '\",\"', status, '\"]') AS encoded, submitted_by_city AS first FROM papers", "papers")
def n12(t: Tables):
    encoded = F.to_json(F.array("submitted_by_city", "status"))
    return t["papers"].select("id", encoded.alias("encoded"), F.get(F.from_json(encoded, "array<string>"), F.lit(0)).alias("first"))


@query("Z3_unique_visits", "SELECT count(*) AS n FROM (SELECT DISTINCT paper_id, visitor_ip FROM page_visits) x", "page_visits")
def z3(t: Tables):
    return t["page_visits"].dropDuplicates(["paper_id", "visitor_ip"]).agg(F.count("*").alias("n"))


@query("Z5_trailing_day_counts", "SELECT id, ip_address, count(*) OVER (PARTITION BY ip_address ORDER BY epoch(submitted_at) RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS n FROM (SELECT id, ip_address, date_trunc('second', submitted_at) AS submitted_at FROM submissions) x", "submissions")
def z5(t: Tables):
    return C.trailing_counts(t["submissions"], "id", "ip_address", "submitted_at", 86400).select("id", "ip_address", "n")


@query("Z5_hot_address", "SELECT id, count(*) OVER (ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS n FROM (SELECT event_id AS id, date_trunc('second', ts) AS ts FROM events) x")
def z5_hot(t: Tables):
    # All events of one address: they are dealt over tasks by hour.
    return C.trailing_counts(t["events"].select(F.col("event_id").alias("id"), F.lit("one").alias("address"), "ts"), "id", "address", "ts", 86400, 3600).select("id", "n")


@query("E1_status_collapse", "SELECT id, CASE status WHEN 'narrated' THEN 'narrated' WHEN 'failed' THEN 'failed' WHEN 'narrating' THEN 'narrating' END AS status FROM papers", "papers")
def e1(t: Tables):
    return t["papers"].select("id", S.remap(F.col("status"), {"narrated": "narrated", "failed": "failed", "narrating": "narrating"}).alias("status"))


@query("E3_value_rename", "SELECT id, CASE WHEN narration_tier = 'base' THEN 'free' ELSE narration_tier END AS tier FROM narration_versions", "narration_versions")
def e3(t: Tables):
    return t["narration_versions"].select("id", S.remap(F.col("narration_tier"), {"base": "free"}, F.col("narration_tier")).alias("tier"))


@query("E5_column_drop", "SELECT * EXCLUDE (llm_cost, script_latency_ms), CASE WHEN scripter_mode IS NULL THEN CASE narration_tier WHEN 'base' THEN 'regex' ELSE 'llm' END ELSE scripter_mode END AS mode FROM narration_versions", "narration_versions")
def e5(t: Tables):
    # A migration that drops columns takes all others along, and what is derived from one before it goes.
    v = t["narration_versions"]
    return v.withColumn("mode", F.coalesce("scripter_mode", F.when(F.col("narration_tier") == "base", "regex").otherwise("llm"))).drop("llm_cost", "script_latency_ms")


@query("E6_array_to_map", "SELECT user_token, count(*) AS n FROM listens GROUP BY user_token", "listens")
def e6(t: Tables):
    as_map = t["listens"].groupBy("user_token").agg(F.map_from_entries(F.collect_list(F.struct("paper_id", F.lit(True)))).alias("m"))
    return as_map.select("user_token", F.size("m").cast("long").alias("n"))


@query("N2_token_costs", """SELECT id, (latex_char_count * CASE seq % 3 WHEN 0 THEN 2.5e0 WHEN 1 THEN 0.15e0 ELSE 0e0 END + figure_count * CASE seq % 3 WHEN 0 THEN 10e0 WHEN 1 THEN 0.6e0 ELSE 0e0 END) / 1000000 AS llm_cost,
    script_char_count * CASE WHEN seq % 2 = 0 THEN 30e0 ELSE 0e0 END / 1000000 AS tts_cost FROM papers""", "papers")  # fmt: skip
def n2(t: Tables):
    k = F.col("seq") % 3
    llm = F.when(k == 0, "openai:gpt-4o").when(k == 1, "openai:gpt-4o-mini").otherwise("openai:unknown")
    model, speech_cost = K.token_costs(F.col("latex_char_count"), F.col("figure_count"), llm, F.col("script_char_count"), F.when(F.col("seq") % 2 == 0, "openai:tts-1-hd"))
    return t["papers"].select("id", model.alias("llm_cost"), speech_cost.alias("tts_cost"))


@query("O11_clamped_page", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS place, count(*) OVER () AS n FROM papers) x WHERE place // 30 = least(100000, (n - 1) // 30)", "papers")
def o11(t: Tables):
    return C.clamped_page(t["papers"], [F.col("created_at").desc(), F.col("id").desc()], 100000, 30).select("id")


@query("X3_from_abstract", r"SELECT doc_id, CASE WHEN doc_id % 100 > 50 THEN '\begin{abstract}' || text ELSE repeat('x', CAST(doc_id % 100 AS INTEGER)) || '\begin{abstract}' || text END AS text FROM documents")
def x3(t: Tables):
    source = F.concat(F.repeat(F.lit("x"), (F.col("doc_id") % 100).cast("int")), F.lit("\\begin{abstract}"), "text")
    return t["documents"].select("doc_id", latex.from_abstract_column(source).alias("text"))


@query("X51_bracket_specs", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('[ht] ' || text || ' [1, 2; 3] [lc|r] [see note]', '\[[htbpH!]+\]', '', 'g'), '\[\d+([,; \t\n\x0B\f\r]*\d+)*\]', '', 'g'), '\[[lcr|p]+\]', '', 'g') AS text FROM documents")
def x51(t: Tables):
    return t["documents"].select("doc_id", latex.without_specifications_column(F.concat(F.lit("[ht] "), "text", F.lit(" [1, 2; 3] [lc|r] [see note]"))).alias("text"))
