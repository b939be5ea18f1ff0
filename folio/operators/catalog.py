"""Catalog look-ups, pages, popularity, lists, ratings and history (DataFrame in, DataFrame out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Prior weight and prior mean of the rating average, the highest rating that counts as low.
PRIOR_WEIGHT, PRIOR_MEAN, LOW_STARS = 2.0, 3.0, 3
#: Names that hide a list from the public page.
BLANK_NAMES = ("", "Untitled Collection")
#: Fixed value: display order of job states.
STATUS_ORDER = ("failed", "narrating", "narrated", "unnarrated")


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one key."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def batch_lookup(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows of the keys given (a bounded request list); none for an empty list."""
    return df.where(F.col(key).isin(list(values))) if values else df.limit(0)


def since(ts: Column, as_of: str, days: int) -> Column:
    """Strictly later than `days` days before the instant."""
    return ts > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def since_midnight(ts: Column, as_of: str, days: int) -> Column:
    """Not before the midnight `days` days before the instant's date."""
    return ts >= F.date_sub(F.to_date(F.lit(as_of)), days).cast("timestamp")


def newest_page(df: DataFrame, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
    """A page, newest first; the status filter applies only when given. Ties go by id."""
    if status is not None:
        df = df.where(F.col("status") == status)
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def popular(papers: DataFrame, visits: DataFrame, as_of: str, days: int, limit: int, offset: int = 0) -> DataFrame:
    """Papers with their visits of the last days (0 if none), most visited first. Visits are counted before the join."""
    counts = visits.where(since(F.col("visited_at"), as_of, days)).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("visit_count"))
    joined = papers.join(counts, "id", "left").withColumn("visit_count", F.coalesce("visit_count", F.lit(0)))
    return joined.orderBy(F.col("visit_count").desc(), F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def with_item_counts(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Lists with their number of items, 0 if none."""
    counts = items.groupBy(F.col("list_id").alias("id")).agg(F.count("*").alias("item_count"))
    return lists.join(counts, "id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def public_lists(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Listed, named, non-empty lists, by name without regard to case."""
    shown = with_item_counts(lists.where(~F.col("name").isin(*BLANK_NAMES) & (F.col("publicly_listed") == 1)), items)
    return shown.where("item_count >= 1").withColumn("sort_name", F.lower("name")).orderBy("sort_name", "id")


def rating_summary(ratings: DataFrame) -> DataFrame:
    """Per paper: count, sum, Bayesian average and whether any rating is low."""
    agg = ratings.groupBy("paper_id").agg(F.count("*").alias("rating_count"), F.sum("stars").alias("rating_sum"), F.max((F.col("stars") <= LOW_STARS).cast("int")).alias("has_low_rating"))
    return agg.withColumn("bayesian_avg", (F.lit(PRIOR_WEIGHT * PRIOR_MEAN) + F.col("rating_sum")) / (F.lit(PRIOR_WEIGHT) + F.col("rating_count")))


def with_ratings(papers: DataFrame, ratings: DataFrame) -> DataFrame:
    """Papers with their ratings, worst average first, unrated last."""
    joined = papers.join(rating_summary(ratings).withColumnRenamed("paper_id", "id"), "id", "left")
    return joined.orderBy(F.col("bayesian_avg").asc_nulls_last(), F.col("created_at").desc(), F.col("id").desc())


def top_contributors(papers: DataFrame, limit: int) -> DataFrame:
    """Submitters (token, else ip) by number of papers, with the place of their first submission."""
    named = papers.where(F.col("submitted_by_ip").isNotNull()).withColumn("contributor", F.coalesce("submitted_by_token", "submitted_by_ip"))
    first = F.min(F.struct("created_at", "id", "submitted_by_country", "submitted_by_city"))
    agg = named.groupBy("contributor").agg(F.count("*").alias("paper_count"), first.alias("f"))
    out = agg.select("contributor", "paper_count", F.col("f.submitted_by_country").alias("country"), F.col("f.submitted_by_city").alias("city"))
    return out.orderBy(F.col("paper_count").desc(), "contributor").limit(limit)


def place_label(country: Column, city: Column) -> Column:
    """`city, country` of what is known, else Unknown."""
    known = F.concat_ws(", ", city, country)
    return F.when(known == "", "Unknown").otherwise(known)


def hydrate(items: DataFrame, papers: DataFrame) -> DataFrame:
    """List items in order with their papers; items without one are marked."""
    p = papers.select(F.col("id").alias("paper_id"), "title", "status")
    return items.join(p, "paper_id", "left").select("list_id", "position", "paper_id", "title", "status", F.col("title").isNull().alias("not_found"))


def first_source_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all frames, of each key only those of the first frame that has it; src is the frame's number."""
    tagged = [f.withColumn("src", F.lit(i)) for i, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f)
    return both.withColumn("first", F.min("src").over(W.partitionBy(key))).where("src = first").drop("first")


def federate(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local hits first, then remote hits that are not local; a remote hit keeps its rank. Columns id, rank, title."""
    new = remote.join(local.select("id"), "id", "left_anti")
    return local.select("id", "rank", "title", F.lit(0).alias("src")).unionByName(new.select("id", "rank", "title", F.lit(1).alias("src"))).orderBy("src", "rank", "id")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def best_tier(papers: DataFrame, versions: DataFrame, best: DataFrame) -> DataFrame:
    """paper_id, tier: of the best version, else of the highest-ranked other than base, else base. best: paper_id, best_version_id."""
    own = best.join(versions.select(F.col("id").alias("best_version_id"), F.col("narration_tier").alias("own")), "best_version_id", "left").select("paper_id", "own")
    other = versions.where("narration_tier <> 'base'").groupBy("paper_id").agg(F.max(F.struct("quality_rank", "id", "narration_tier"))["narration_tier"].alias("other"))
    ids = papers.select(F.col("id").alias("paper_id"))
    return ids.join(own, "paper_id", "left").join(other, "paper_id", "left").select("paper_id", F.coalesce("own", "other", F.lit("base")).alias("tier"))


def admin_order(df: DataFrame) -> list[Column]:
    """Job states in display order, then newest, then id."""
    state = F.lit(len(STATUS_ORDER))
    for i, name in reversed(list(enumerate(STATUS_ORDER))):
        state = F.when(F.col("status") == name, i).otherwise(state)
    return [state, F.col("created_at").desc(), F.col("id").desc()]


def clamped_page(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """Page `page` (from 0) of `per_page` rows, the last page if there are fewer."""
    pages = max(1, -(-df.count() // per_page))
    return df.orderBy(*order).offset(min(max(page, 0), pages - 1) * per_page).limit(per_page)


def pending(stems: DataFrame, outputs: DataFrame, stem_col: str = "stem", name_col: str = "name", ending: str = ".mp3") -> DataFrame:
    """stems without an output: no name that ends with ` - `, the stem and the ending, in any case.

    A name can only end so behind one of its ` - `, so these few endings are what stems are looked up among: one shuffle by
    ending, repeated ones combined before it, and no comparison of every stem with every name.
    """
    places = F.split(F.lower(F.col(name_col)), "(?<= - )")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(places), F.lit(2))), lambda i: F.array_join(F.slice(places, i, F.size(places)), ""))
    made = outputs.select(F.explode(tails).alias("tail")).where("tail <> ''").distinct()
    wanted = stems.withColumn("tail", F.concat(F.lower(F.col(stem_col)), F.lit(ending.lower())))
    return wanted.join(made, "tail", "left_anti").drop("tail")


def trailing_counts(events: DataFrame, id_col: str, key: str, ts: str, seconds: int, bucket: int = 21600) -> DataFrame:
    """id_col, key, n: how many events of the same key came in the `seconds` before each (whole seconds; those of its own second
    don't count). Ids must be distinct; events without a time have 0.

    That is a difference of two ranks: the key's events before the event, and before the span's begin. A rank is what lies in
    earlier buckets of time, from a table of counts by key and bucket, and what lies earlier in the same bucket, from a window
    over (key, bucket). So a key that most events bear is dealt over its buckets, and only counts meet by key.
    """
    at = F.unix_timestamp(ts)
    asks = F.array(*[F.struct(F.lit(sign).alias("sign"), (at - back).alias("moment")) for sign, back in ((1, 0), (-1, seconds))])
    dealt = events.select(id_col, key, F.explode(asks).alias("ask")).select(id_col, key, "ask.*").withColumn("place", F.floor(F.col("moment") / bucket))
    event = F.col("sign") == 1
    held = dealt.groupBy(key, "place").agg(F.sum(F.when(event, 1).otherwise(0)).alias("k"))
    held = held.select(F.col(key).alias("_key"), F.col("place").alias("_place"), (F.sum("k").over(W.partitionBy(key).orderBy("place")) - F.col("k")).alias("earlier"))
    inside = F.sum(F.when(event, 1).otherwise(0)).over(W.partitionBy(key, "place").orderBy("moment").rangeBetween(W.unboundedPreceding, -1))
    ranked = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(held, F.col(key).eqNullSafe(F.col("_key")) & (F.col("place") == F.col("_place")), "left")
    n = F.sum(F.col("sign") * (F.col("inside") + F.col("earlier")))
    return ranked.groupBy(id_col, key).agg(F.coalesce(n, F.lit(0)).alias("n"))
