"""Queries over the catalog: scans, predicates, joins, aggregates, orders, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.adapters import AS_OF
from folio.operators import catalog as C
from folio.plans.registry import Tables, query
from folio.sources import archives

_T = f"TIMESTAMP '{AS_OF}'"


@query("S1_point_lookup", "SELECT id, title, status FROM papers WHERE id = '17'", "papers")
def s1(t: Tables):
    return C.point_lookup(t["papers"], "id", "17").select("id", "title", "status")


@query("S2_batch_lookup", "SELECT id, title FROM papers WHERE id IN ('3', '17', '99', 'none')", "papers")
def s2(t: Tables):
    return C.batch_lookup(t["papers"], "id", ["3", "17", "99", "none"]).select("id", "title")


@query("S3_newest_page", "SELECT id, created_at FROM papers ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50", "papers")
def s3(t: Tables):
    return C.newest_page(t["papers"], 25, 50).select("id", "created_at")


@query("S4_list_slice", "SELECT paper_id, position FROM list_items WHERE list_id = 7 ORDER BY position", "list_items")
def s4_list(t: Tables):
    return t["list_items"].where("list_id = 7").orderBy("position").select("paper_id", "position")


@query("S4_listen_history", "SELECT paper_id, position, updated_at FROM listens WHERE user_token = 'u5' ORDER BY updated_at DESC, paper_id", "listens")
def s4_history(t: Tables):
    return t["listens"].where("user_token = 'u5'").orderBy(F.col("updated_at").desc(), "paper_id").select("paper_id", "position", "updated_at")


@query("S4_version_of_paper", "SELECT id, narration_tier FROM narration_versions WHERE id = 33 AND paper_id = (SELECT paper_id FROM narration_versions WHERE id = 33)", "narration_versions")
def s4_version(t: Tables):
    v = t["narration_versions"].where("id = 33")
    return v.join(v.select("paper_id"), "paper_id", "left_semi").select("id", "narration_tier")


@query(
    "S15_top_feed",
    """SELECT period, paper_id, upvotes FROM (
         SELECT period, paper_id, upvotes, row_number() OVER (PARTITION BY period ORDER BY upvotes DESC, paper_id) AS rn FROM (
           SELECT CAST(visited_at AS DATE) AS d, CASE extract(day FROM visited_at) % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS period, paper_id, count(*) AS upvotes
           FROM page_visits GROUP BY ALL) x) y WHERE rn <= 25""",
    "page_visits",
)
def s15(t: Tables):
    day = F.dayofmonth("visited_at") % 3
    votes = t["page_visits"].groupBy(F.to_date("visited_at").alias("d"), F.when(day == 0, "daily").when(day == 1, "weekly").otherwise("monthly").alias("period"), "paper_id").agg(F.count("*").alias("upvotes"))
    from pyspark.sql import Window as W

    w = W.partitionBy("period").orderBy(F.col("upvotes").desc(), "paper_id")
    return votes.withColumn("rn", F.row_number().over(w)).where("rn <= 25").select("period", "paper_id", "upvotes")


@query(
    "S13_source_stats",
    """SELECT o_custkey AS paper_id, CAST(sum(CASE WHEN kind = 'tex' THEN size ELSE 0 END) AS BIGINT) AS latex_char_count,
              CAST(sum(CASE WHEN kind IN ('png', 'pdf', 'jpg') THEN 1 ELSE 0 END) AS BIGINT) AS figure_count, CAST(sum(size) AS BIGINT) AS tar_bytes
       FROM (SELECT o_custkey, o_orderkey % 5000 AS size, CASE o_orderkey % 5 WHEN 0 THEN 'tex' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' WHEN 3 THEN 'jpg' ELSE 'bib' END AS kind FROM orders) f
       GROUP BY o_custkey""",
)
def s13(t: Tables):
    k = F.col("o_orderkey") % 5
    files = t["orders"].select(F.col("o_custkey").alias("paper_id"), F.concat(F.lit("f."), F.when(k == 0, "tex").when(k == 1, "png").when(k == 2, "pdf").when(k == 3, "jpg").otherwise("bib")).alias("name"), (F.col("o_orderkey") % 5000).alias("size"))
    return archives.source_stats(files, "paper_id")


_FILES = """SELECT o_custkey AS paper_id, concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'src/' END, CASE WHEN o_orderkey % 4 = 0 THEN 'main' ELSE concat('f', CAST(o_orderkey AS STRING)) END, '.tex') AS name,
    o_orderkey % 2 = 0 AS is_root, o_orderkey % 700 AS body_length FROM {}"""


def _described(t: Tables):
    """The files with contents that have (or lack) a class and a body, comments that don't count, and text of the length."""
    files = t.spark.sql(_FILES.format("{orders}"), orders=t["orders"])
    begun = F.when(F.col("is_root"), "\\documentclass{a}\n\\begin{document}\n").otherwise("")
    content = F.concat(begun, F.lit("50\\% % a comment "), F.repeat(F.lit("c"), (F.col("body_length") * 7 % 300).cast("int")), F.lit("\n"), F.repeat(F.lit("x"), F.col("body_length").cast("int")))
    return archives.described(files.select(F.col("paper_id").alias("path"), "name", content.cast("binary").alias("content")))


@query(
    "S7_root_file_by_body",
    f"""SELECT paper_id, name FROM (SELECT paper_id, name, row_number() OVER (PARTITION BY paper_id ORDER BY is_root DESC, CASE WHEN is_root THEN body_length ELSE 0 END DESC,
        length(name) - length(replace(name, '/', '')), name) AS rn FROM ({_FILES.format("orders")}) f) r WHERE rn = 1""",
)
def s7(t: Tables):
    return archives.root_by_body(_described(t), "path").withColumnRenamed("path", "paper_id")


@query(
    "S8_root_file_by_name",
    f"""SELECT paper_id, name FROM (SELECT paper_id, name, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN name LIKE '%main.tex' THEN 0 WHEN is_root THEN 1 ELSE 2 END,
        length(name) - length(replace(name, '/', '')), name) AS rn FROM ({_FILES.format("orders")}) f) r WHERE rn = 1""",
)
def s8(t: Tables):
    return archives.root_by_name(_described(t), "path").withColumnRenamed("path", "paper_id")


@query(
    "S9_root_file_by_depth",
    f"""SELECT paper_id, name FROM (SELECT paper_id, name, row_number() OVER (PARTITION BY paper_id ORDER BY is_root DESC, CASE WHEN name LIKE '%/%' THEN 1 ELSE 0 END, body_length DESC, name) AS rn
        FROM ({_FILES.format("orders")}) f) r WHERE rn = 1""",
)
def s9(t: Tables):
    return archives.root_by_depth(_described(t), "path").withColumnRenamed("path", "paper_id")


@query("S12_pdf_sniff", "SELECT page_id, starts_with(html, '%PDF-') OR page_id % 10 = 0 AS is_pdf FROM pages")
def s12(t: Tables):
    content = F.concat(F.when(F.col("page_id") % 10 == 0, "%PDF-1.4 ").otherwise(""), "html").cast("binary")
    return t["pages"].select("page_id", archives.is_pdf(content).alias("is_pdf"))


@query(
    "S19_output_name",
    """SELECT id, concat_ws(' - ', strftime(created_at, '%Y-%m-%d'), CASE WHEN figure_count > 0 THEN concat(CAST(figure_count AS STRING), 'm') END,
              nullif(trim(regexp_replace(substr(submitted_by_city, 1, 40), '[^A-Za-z0-9 _-]', '', 'g')), ''), nullif(trim(regexp_replace(substr(title, 1, 60), '[^A-Za-z0-9 _-]', '', 'g')), ''), concat('paper', id)) || '.mp3' AS name FROM papers""",
    "papers",
)
def s19(t: Tables):
    from folio.functions.text import output_name

    dur = F.when(F.col("figure_count") > 0, F.col("figure_count"))
    return t["papers"].select("id", output_name(F.date_format("created_at", "yyyy-MM-dd"), dur, F.col("submitted_by_city"), F.col("title"), F.concat(F.lit("paper"), "id")).alias("name"))


_OUTPUTS = """SELECT concat_ws(' - ', CASE WHEN v.id % 3 > 0 THEN '2024-01-05' END, CASE WHEN v.id % 4 > 0 THEN '12m' END, CASE WHEN v.id % 5 > 0 THEN 'Some - Title' END,
        CASE WHEN v.id % 2 = 0 THEN upper(concat('Paper', v.paper_id)) ELSE concat('paper', v.paper_id) END) || CASE WHEN v.id % 11 = 0 THEN '.wav' ELSE '.mp3' END AS name FROM {} v WHERE audio_key IS NOT NULL"""


@query(
    "S20_pending",
    f"SELECT id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM ({_OUTPUTS.format('narration_versions')}) o WHERE ends_with(lower(name), concat(' - paper', p.id, '.mp3')))", "papers", "narration_versions",
)
def s20(t: Tables):
    outputs = t.spark.sql(_OUTPUTS.format("{v}"), v=t["narration_versions"])
    return C.pending(t["papers"].select("id", F.concat(F.lit("paper"), "id").alias("stem")), outputs).select("id")


@query("S22_seed_first_wins", "SELECT paper_id, visitor_ip, min(id) AS id FROM page_visits GROUP BY paper_id, visitor_ip", "page_visits")
def s22(t: Tables):
    return C.latest_per_key(t["page_visits"], ["paper_id", "visitor_ip"], [F.col("id")]).select("paper_id", "visitor_ip", "id")


@query("P1_by_status", "SELECT id FROM papers WHERE status = 'failed'", "papers")
def p1(t: Tables):
    return t["papers"].where(F.col("status") == "failed").select("id")


@query("P2_optional_status", "SELECT id FROM papers WHERE status = 'narrated' ORDER BY created_at DESC, id DESC LIMIT 20", "papers")
def p2(t: Tables):
    return C.newest_page(t["papers"], 20, 0, "narrated").select("id")


@query("P3_recent_visits", f"SELECT id, paper_id FROM page_visits WHERE visited_at > {_T} - INTERVAL '7' DAY", "page_visits")
def p3(t: Tables):
    return t["page_visits"].where(C.since(F.col("visited_at"), AS_OF, 7)).select("id", "paper_id")


@query("P4_since_midnight", f"SELECT id, paper_id FROM page_visits WHERE visited_at >= CAST(CAST({_T} AS DATE) - INTERVAL '3' DAY AS TIMESTAMP)", "page_visits")
def p4(t: Tables):
    return t["page_visits"].where(C.since_midnight(F.col("visited_at"), AS_OF, 3)).select("id", "paper_id")


@query(
    "P5_public_lists",
    """SELECT l.id, l.name, c.item_count FROM lists l JOIN (SELECT list_id, count(*) AS item_count FROM list_items GROUP BY list_id) c ON c.list_id = l.id
       WHERE l.name NOT IN ('', 'Untitled Collection') AND l.publicly_listed = 1 ORDER BY lower(l.name), l.id""",
    "lists", "list_items",
)
def p5(t: Tables):
    return C.public_lists(t["lists"], t["list_items"]).select("id", "name", "item_count")


@query("P6_training_eligible", "SELECT id FROM training_rows WHERE actual_input_tokens IS NOT NULL AND actual_output_tokens IS NOT NULL", "training_rows")
def p6(t: Tables):
    return t["training_rows"].dropna(subset=["actual_input_tokens", "actual_output_tokens"]).select("id")


@query("P7_owner", "SELECT id FROM papers WHERE coalesce(submitted_by_token = 'tok3', FALSE) OR submitted_by_ip = 'ip5'", "papers")
def p7(t: Tables):
    return t["papers"].where(F.coalesce(F.col("submitted_by_token") == "tok3", F.lit(False)) | (F.col("submitted_by_ip") == "ip5")).select("id")


@query("P8_response", "SELECT id, concat('https://arxiv.org/abs/', id) AS url, CASE WHEN completed_at IS NOT NULL THEN concat('/audio/', id) END AS audio_url, coalesce(retry_count, 0) AS retry_count FROM papers", "papers")
def p8(t: Tables):
    from folio.functions.text import abs_url

    return t["papers"].select("id", abs_url(F.col("id")).alias("url"), F.when(F.col("completed_at").isNotNull(), F.concat(F.lit("/audio/"), "id")).alias("audio_url"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"))


@query("P11_admin_facets", "SELECT id FROM papers WHERE status = 'failed' AND (contains(lower(title), 'th') OR contains(id, 'th'))", "papers")
def p11(t: Tables):
    return t["papers"].where((F.col("status") == "failed") & (F.lower("title").contains("th") | F.col("id").contains("th"))).select("id")


@query("P12_upgraded", "SELECT paper_id, id, quality_rank FROM narration_versions WHERE narration_tier <> 'base' ORDER BY quality_rank DESC, id", "narration_versions")
def p12(t: Tables):
    return t["narration_versions"].where("narration_tier <> 'base'").orderBy(F.col("quality_rank").desc(), "id").select("paper_id", "id", "quality_rank")


@query("P13_unread", "SELECT id FROM papers WHERE id NOT IN (SELECT paper_id FROM listens WHERE user_token = 'u5')", "papers", "listens")
def p13(t: Tables):
    read = t["listens"].where("user_token = 'u5'").select(F.col("paper_id").alias("id"))
    return t["papers"].join(read, "id", "left_anti").select("id")


@query("P14_validation", "SELECT id, greatest(1, figure_count) AS page, least(50, greatest(1, n)) AS per_page, CASE WHEN stars BETWEEN 1 AND 5 THEN NULL ELSE 'bad stars' END AS problem FROM (SELECT id, figure_count, script_char_count % 90 AS n, script_char_count % 8 AS stars FROM papers) x", "papers")
def p14(t: Tables):
    n, stars = F.col("script_char_count") % 90, F.col("script_char_count") % 8
    return t["papers"].select("id", F.greatest(F.lit(1), "figure_count").alias("page"), F.least(F.lit(50), F.greatest(F.lit(1), n)).alias("per_page"), F.when(~stars.between(1, 5), "bad stars").alias("problem"))


@query("P15_key_format", "SELECT id, coalesce(regexp_matches(audio_key, '^audio/[0-9]+[.]mp3$'), FALSE) AS valid FROM narration_versions", "narration_versions")
def p15(t: Tables):
    return t["narration_versions"].select("id", F.coalesce(F.col("audio_key").rlike(r"\Aaudio/[0-9]+[.]mp3\z"), F.lit(False)).alias("valid"))


_BEST = "SELECT paper_id, max_by(id, CAST(quality_rank AS BIGINT) * 1000000000 - id) AS best_version_id FROM narration_versions WHERE audio_key IS NOT NULL GROUP BY paper_id"


@query(
    "P17_best_tier",
    f"""SELECT p.id AS paper_id, coalesce(v.narration_tier, o.tier, 'base') AS tier FROM papers p LEFT JOIN ({_BEST}) b ON b.paper_id = p.id LEFT JOIN narration_versions v ON v.id = b.best_version_id
        LEFT JOIN (SELECT paper_id, max_by(narration_tier, CAST(quality_rank AS BIGINT) * 1000000000 + id) AS tier FROM narration_versions WHERE narration_tier <> 'base' GROUP BY paper_id) o ON o.paper_id = p.id""",
    "papers", "narration_versions",
)
def p17(t: Tables):
    v = t["narration_versions"]
    best = v.where("audio_key is not null").groupBy("paper_id").agg(F.max_by("id", F.struct("quality_rank", (-F.col("id")).alias("low"))).alias("best_version_id"))
    return C.best_tier(t["papers"], v, best)


@query(
    "P18_audio_key",
    f"""SELECT p.id, coalesce(v.audio_key, concat('legacy/', p.id, '.mp3')) AS audio_key FROM papers p LEFT JOIN ({_BEST}) b ON b.paper_id = p.id LEFT JOIN narration_versions v ON v.id = b.best_version_id WHERE p.status = 'narrated'""",
    "papers", "narration_versions",
)
def p18(t: Tables):
    v = t["narration_versions"]
    best = v.where("audio_key is not null").groupBy(F.col("paper_id").alias("id")).agg(F.max_by("audio_key", F.struct("quality_rank", (-F.col("id")).alias("low"))).alias("own"))
    return t["papers"].where("status = 'narrated'").join(best, "id", "left").select("id", F.coalesce("own", F.concat(F.lit("legacy/"), "id", F.lit(".mp3"))).alias("audio_key"))


@query("P19_place_label", "SELECT id, CASE WHEN concat_ws(', ', submitted_by_city, submitted_by_country) = '' THEN 'Unknown' ELSE concat_ws(', ', submitted_by_city, submitted_by_country) END AS place FROM papers", "papers")
def p19(t: Tables):
    return t["papers"].select("id", C.place_label(F.col("submitted_by_country"), F.col("submitted_by_city")).alias("place"))


@query(
    "J2_popular",
    f"""SELECT p.id, p.title, coalesce(v.n, 0) AS visit_count FROM papers p LEFT JOIN (SELECT paper_id, count(*) AS n FROM page_visits WHERE visited_at > {_T} - INTERVAL '7' DAY GROUP BY paper_id) v ON v.paper_id = p.id
        ORDER BY coalesce(v.n, 0) DESC, p.created_at DESC, p.id DESC LIMIT 50""",
    "papers", "page_visits",
)
def j2(t: Tables):
    return C.popular(t["papers"], t["page_visits"], AS_OF, 7, 50).select("id", "title", "visit_count")


@query("J3_lists_with_counts", "SELECT l.id, l.name, coalesce(c.n, 0) AS item_count FROM lists l LEFT JOIN (SELECT list_id, count(*) AS n FROM list_items GROUP BY list_id) c ON c.list_id = l.id", "lists", "list_items")
def j3(t: Tables):
    return C.with_item_counts(t["lists"], t["list_items"]).select("id", "name", "item_count")


@query("J4_best_version", f"SELECT p.id, v.id AS version_id, v.narration_tier FROM papers p LEFT JOIN ({_BEST}) b ON b.paper_id = p.id LEFT JOIN narration_versions v ON v.id = b.best_version_id", "papers", "narration_versions")
def j4(t: Tables):
    best = t["narration_versions"].where("audio_key is not null").groupBy(F.col("paper_id").alias("id")).agg(F.max_by(F.struct(F.col("id").alias("version_id"), "narration_tier"), F.struct("quality_rank", (-F.col("id")).alias("low"))).alias("b"))
    return t["papers"].join(best, "id", "left").select("id", "b.version_id", "b.narration_tier")


@query("J9_any_low_rating", "SELECT paper_id, max(CASE WHEN stars <= 3 THEN 1 ELSE 0 END) AS has_low_rating FROM ratings GROUP BY paper_id", "ratings")
def j9(t: Tables):
    return C.rating_summary(t["ratings"]).select("paper_id", "has_low_rating")


@query("J11_training_set", "SELECT v.id, v.paper_id, p.script_char_count FROM narration_versions v JOIN papers p ON p.id = v.paper_id WHERE v.scripter_mode IS NOT NULL AND p.tar_bytes IS NOT NULL ORDER BY v.created_at DESC, v.id DESC", "papers", "narration_versions")
def j11(t: Tables):
    p = t["papers"].where("tar_bytes is not null").select(F.col("id").alias("paper_id"), "script_char_count")
    return t["narration_versions"].where("scripter_mode is not null").join(p, "paper_id").orderBy(F.col("created_at").desc(), F.col("id").desc()).select("id", "paper_id", "script_char_count")


@query("J12_hydrate", "SELECT i.list_id, i.position, i.paper_id, p.title, p.status, p.title IS NULL AS not_found FROM list_items i LEFT JOIN papers p ON p.id = i.paper_id", "papers", "list_items")
def j12(t: Tables):
    return C.hydrate(t["list_items"], t["papers"])


@query(
    "J13_federate",
    """SELECT id, rank, title, src FROM (
         SELECT id, seq AS rank, title, 0 AS src FROM papers WHERE seq % 3 = 0
         UNION ALL SELECT id, 1000000 - seq AS rank, title, 1 AS src FROM papers WHERE seq % 2 = 0 AND seq % 3 <> 0) x ORDER BY src, rank, id""",
    "papers",
)
def j13(t: Tables):
    p = t["papers"]
    return C.federate(p.where("seq % 3 = 0").select("id", F.col("seq").alias("rank"), "title"), p.where("seq % 2 = 0").select("id", (F.lit(1000000) - F.col("seq")).alias("rank"), "title"))


@query(
    "J14_my_additions",
    """SELECT id, src FROM (SELECT id, 0 AS src FROM papers WHERE submitted_by_token = 'tok5' UNION ALL
       SELECT id, 1 AS src FROM papers WHERE submitted_by_ip = 'ip5' AND id NOT IN (SELECT id FROM papers WHERE submitted_by_token = 'tok5')) x""",
    "papers",
)
def j14(t: Tables):
    p = t["papers"].select("id", "submitted_by_token", "submitted_by_ip")
    return C.first_source_wins([p.where("submitted_by_token = 'tok5'"), p.where("submitted_by_ip = 'ip5'")], "id").select("id", "src")


@query(
    "J15_import",
    """SELECT owner, id, CASE WHEN known THEN 'exists' WHEN rn <= 20 THEN 'new' ELSE 'over limit' END AS outcome FROM (
         SELECT owner, id, known, row_number() OVER (PARTITION BY owner, known ORDER BY id) AS rn FROM (
           SELECT DISTINCT v.visitor_ip AS owner, v.paper_id AS id, p.id IS NOT NULL AS known FROM page_visits v LEFT JOIN papers p ON p.id = v.paper_id AND p.status <> 'failed') a) b""",
    "papers", "page_visits",
)
def j15(t: Tables):
    from pyspark.sql import Window as W

    asked = t["page_visits"].select(F.col("visitor_ip").alias("owner"), F.col("paper_id").alias("id")).distinct()
    have = t["papers"].where("status <> 'failed'").select("id", F.lit(True).alias("known"))
    both = asked.join(have, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rn = F.row_number().over(W.partitionBy("owner", "known").orderBy("id"))
    return both.withColumn("rn", rn).select("owner", "id", F.when(F.col("known"), "exists").when(F.col("rn") <= 20, "new").otherwise("over limit").alias("outcome"))


@query(
    "J16_curate",
    "SELECT paper_id FROM (SELECT paper_id, count(*) AS n FROM page_visits WHERE paper_id NOT IN (SELECT id FROM papers) GROUP BY paper_id) x ORDER BY n DESC, paper_id LIMIT 1",
    "papers", "page_visits",
)
def j16(t: Tables):
    votes = t["page_visits"].groupBy("paper_id").agg(F.count("*").alias("n"))
    return votes.join(t["papers"].select(F.col("id").alias("paper_id")), "paper_id", "left_anti").orderBy(F.col("n").desc(), "paper_id").limit(1).select("paper_id")


@query(
    "J19_client_merge",
    """SELECT coalesce(l.paper_id, r.paper_id) AS paper_id, coalesce(l.position, r.position) AS position, r.paper_id IS NULL AS push
       FROM (SELECT paper_id, position FROM listens WHERE user_token = 'u5') l FULL OUTER JOIN (SELECT paper_id, position FROM listens WHERE user_token = 'u6') r ON l.paper_id = r.paper_id""",
    "listens",
)
def j19(t: Tables):
    side = lambda u, a: t["listens"].where(F.col("user_token") == u).select("paper_id", F.col("position").alias(a), F.lit(True).alias(f"has_{a}"))
    both = side("u5", "mine").join(side("u6", "theirs"), "paper_id", "full_outer")
    return both.select("paper_id", F.coalesce("mine", "theirs").alias("position"), F.col("has_theirs").isNull().alias("push"))


@query("J20_refresh", "SELECT p.id, coalesce(n.status, p.status) AS status FROM papers p LEFT JOIN (SELECT id, 'narrated' AS status FROM papers WHERE retry_count = 2) n ON n.id = p.id", "papers")
def j20(t: Tables):
    polled = t["papers"].where("retry_count = 2").select("id", F.lit("narrated").alias("new_status"))
    return t["papers"].join(polled, "id", "left").select("id", F.coalesce("new_status", "status").alias("status"))


@query("A1_rate_counts", f"SELECT ip_address, count(*) AS n FROM submissions WHERE submitted_at > {_T} - INTERVAL '1' DAY GROUP BY ip_address", "submissions")
def a1(t: Tables):
    return t["submissions"].where(C.since(F.col("submitted_at"), AS_OF, 1)).groupBy("ip_address").agg(F.count("*").alias("n"))


@query(
    "A4_top_contributors",
    """SELECT contributor, paper_count, country, city FROM (SELECT coalesce(submitted_by_token, submitted_by_ip) AS contributor, count(*) AS paper_count,
         first(submitted_by_country ORDER BY created_at, id) AS country, first(submitted_by_city ORDER BY created_at, id) AS city FROM papers GROUP BY 1) x ORDER BY paper_count DESC, contributor LIMIT 10""",
    "papers",
)
def a4(t: Tables):
    return C.top_contributors(t["papers"], 10)


@query("A5_bayesian", "SELECT paper_id, count(*) AS rating_count, CAST(sum(stars) AS BIGINT) AS rating_sum, (6.0 + sum(stars)) / (2.0 + count(*)) AS bayesian_avg FROM ratings GROUP BY paper_id", "ratings")
def a5(t: Tables):
    return C.rating_summary(t["ratings"]).select("paper_id", "rating_count", "rating_sum", "bayesian_avg")


@query("A6_next_position", "SELECT l.id, coalesce(max(i.position), -1) + 1 AS next_position FROM lists l LEFT JOIN list_items i ON i.list_id = l.id GROUP BY l.id", "lists", "list_items")
def a6(t: Tables):
    last = t["list_items"].groupBy(F.col("list_id").alias("id")).agg(F.max("position").alias("last"))
    return t["lists"].join(last, "id", "left").select("id", (F.coalesce("last", F.lit(-1)) + 1).alias("next_position"))


@query("A17_best_audio_per_tier", "SELECT paper_id, narration_tier, max_by(id, CAST(quality_rank AS BIGINT) * 1000000000 - id) AS id FROM narration_versions WHERE audio_key IS NOT NULL GROUP BY paper_id, narration_tier", "narration_versions")
def a17(t: Tables):
    return t["narration_versions"].where("audio_key is not null").groupBy("paper_id", "narration_tier").agg(F.max_by("id", F.struct("quality_rank", (-F.col("id")).alias("low"))).alias("id"))


@query("O3_nulls_last", "SELECT p.id, r.a AS bayesian_avg FROM papers p LEFT JOIN (SELECT paper_id, (6.0 + sum(stars)) / (2.0 + count(*)) AS a FROM ratings GROUP BY paper_id) r ON r.paper_id = p.id ORDER BY r.a ASC NULLS LAST, p.created_at DESC, p.id DESC", "papers", "ratings")
def o3(t: Tables):
    return C.with_ratings(t["papers"], t["ratings"]).select("id", "bayesian_avg")


@query("O5_worst_ratings", "SELECT id, stars FROM ratings WHERE paper_id = '5' ORDER BY stars, created_at DESC, id", "ratings")
def o5(t: Tables):
    return t["ratings"].where("paper_id = '5'").orderBy("stars", F.col("created_at").desc(), "id").select("id", "stars")


@query("O6_versions_by_rank", "SELECT id, quality_rank FROM narration_versions WHERE paper_id = '30' ORDER BY quality_rank DESC, created_at DESC, id", "narration_versions")
def o6(t: Tables):
    return t["narration_versions"].where("paper_id = '30'").orderBy(F.col("quality_rank").desc(), F.col("created_at").desc(), "id").select("id", "quality_rank")


@query(
    "O10_admin_page",
    "SELECT id, status FROM papers ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'narrating' THEN 1 WHEN 'narrated' THEN 2 ELSE 3 END, created_at DESC, id DESC LIMIT 40 OFFSET 80",
    "papers",
)
def o10(t: Tables):
    return C.clamped_page(t["papers"], C.admin_order(t["papers"]), 2, 40).select("id", "status")


@query("O12_shortest_first", "SELECT id, script_char_count FROM papers ORDER BY script_char_count, seq", "papers")
def o12(t: Tables):
    return t["papers"].orderBy("script_char_count", "seq").select("id", "script_char_count")


@query("U2_ordered_distinct", "SELECT list_id, string_agg(paper_id, ',' ORDER BY p) AS papers FROM (SELECT list_id, paper_id, min(position) AS p FROM list_items GROUP BY list_id, paper_id) x GROUP BY list_id", "list_items")
def u2(t: Tables):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "paper_id"))), lambda s: s["paper_id"])
    return t["list_items"].groupBy("list_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("papers"))


@query("U3_set_difference", "SELECT paper_id FROM listens WHERE user_token = 'u5' AND paper_id NOT IN (SELECT paper_id FROM listens WHERE user_token = 'u6')", "listens")
def u3(t: Tables):
    of = lambda u: t["listens"].where(F.col("user_token") == u).select("paper_id")
    return of("u5").join(of("u6"), "paper_id", "left_anti")


@query("N13_positions_map", "SELECT user_token, string_agg(paper_id || '=' || CAST(CAST(floor(position) AS BIGINT) AS STRING), ',' ORDER BY paper_id) AS positions FROM listens WHERE position IS NOT NULL GROUP BY user_token", "listens")
def n13(t: Tables):
    pairs = t["listens"].where("position is not null").groupBy("user_token").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("paper_id", "position")))).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], F.floor(e["value"]).cast("string")))
    return pairs.select("user_token", F.array_join(shown, ",").alias("positions"))
