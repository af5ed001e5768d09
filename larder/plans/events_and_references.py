"""Queries on events, packed fields, references and hot keys (problems 3, 4, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.numeric import steady_round, steady_sql
from larder.operators.entity_features import NO_DATE, EntityFeatures, EventColumns
from larder.operators.hot_keys import per_key_stats, value_changes
from larder.operators.orphans import OrphanTracker, parent_rows, references, track
from larder.operators.packed_values import split_packed
from larder.plans.registry import Registry, table
from larder.session import broadcast_if_small, scratch_path

R = Registry()

# ---------------------------------------------------------------------------------------------------------------- p3

_ONCE = """
once AS (SELECT interaction_id, min(user_id) user_id, min(event_type) event_type, min(rating) rating,
                min(sentiment_score) sentiment_score, min(date_id) date_id
         FROM fact_interactions WHERE interaction_id IS NOT NULL GROUP BY interaction_id),
ev AS (SELECT o.*, d.full_date FROM once o LEFT JOIN dim_date d USING (date_id) WHERE user_id IS NOT NULL)
"""


#: The history is brought in twice: rows loaded by this moment, then the rest.
FIRST_LOAD = "2024-01-01 00:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "dim_date").select("date_id", "full_date")
    return table(spark, sf, "fact_interactions").join(broadcast_if_small(days), "date_id", "left")


def _feature_state(spark: SparkSession, sf: str) -> EntityFeatures:
    """The state after two refreshes: the second one sees by the load time which buckets got rows, and recomputes those."""
    facts = _events(spark, sf)
    state = EntityFeatures(spark, scratch_path(spark, "features"), EventColumns(loaded="loaded_at"), bucket_days=365)
    state.refresh(facts.filter(F.col("loaded_at") <= F.lit(FIRST_LOAD).cast("timestamp")))
    state.refresh(facts)
    return state


@R.add(
    "p3_found",
    f"""WITH {_ONCE},
    f AS (SELECT user_id, count(rating) review_count, avg(sentiment_score) s, max(full_date) last_date FROM ev GROUP BY user_id)
    SELECT u.user_id FROM dim_user u LEFT JOIN f USING (user_id)
    WHERE (u.review_count IS NOT NULL AND u.review_count <> coalesce(f.review_count, 0))
       OR (u.avg_sentiment_score IS NOT NULL AND (f.s IS NULL OR abs(u.avg_sentiment_score - f.s) > 0.01))
       OR (u.last_review_date IS NOT NULL AND u.last_review_date IS DISTINCT FROM f.last_date)""",
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose stored features differ from those derived from their events."""
    derived = _feature_state(spark, sf).features().select(
        "entity", F.col("review_count").alias("_n"), F.col("avg_score").alias("_s"), F.col("last_day").alias("_last")
    )
    stored = table(spark, sf, "dim_user").select("user_id", "review_count", "avg_sentiment_score", "last_review_date")
    both = stored.join(derived, stored["user_id"] == derived["entity"], "left")
    s = F.nanvl("avg_sentiment_score", F.lit(None))
    wrong_n = F.col("review_count").isNotNull() & (F.col("review_count") != F.coalesce("_n", F.lit(0)))
    wrong_s = s.isNotNull() & (F.col("_s").isNull() | (F.abs(s - F.col("_s")) > 0.01))
    wrong_d = F.col("last_review_date").isNotNull() & ~F.col("last_review_date").eqNullSafe(F.col("_last"))
    return both.filter(wrong_n | wrong_s | wrong_d).select("user_id").distinct()


@R.add(
    "p3_user_features",
    f"""WITH {_ONCE}
    SELECT user_id, count(*) n_events, count(rating) review_count, sum(rating)::DOUBLE rating_total,
           {steady_sql('avg(sentiment_score)')} AS avg_sentiment, min(full_date) first_day, max(full_date) last_day,
           count(DISTINCT event_type) n_types
    FROM ev GROUP BY user_id""",
)
def p3_user_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature row of every user; the per-type features as their number."""
    return _feature_state(spark, sf).features().select(
        F.col("entity").alias("user_id"), "n_events", "review_count", "rating_total",
        steady_round(F.col("avg_score")).alias("avg_sentiment"), "first_day", "last_day",
        F.size("by_type").cast("bigint").alias("n_types"),
    )


@R.add(
    "p3_user_type_features",
    f"""WITH {_ONCE}
    SELECT user_id, event_type, count(*) n, sum(rating)::DOUBLE rating_total, max(full_date) last_day
    FROM ev WHERE event_type IS NOT NULL GROUP BY user_id, event_type""",
)
def p3_user_type_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features of every user and event type, one row each."""
    f = _feature_state(spark, sf).features()
    return f.select(F.col("entity").alias("user_id"), F.explode("by_type").alias("event_type", "v")).select(
        "user_id", "event_type", F.col("v.n").alias("n"), F.col("v.rating_total").alias("rating_total"), F.col("v.last_day").alias("last_day")
    )


_RANGE = ("2021-03-10", "2023-08-20")


@R.add(
    "p3_range_features",
    f"""WITH {_ONCE}
    SELECT user_id, count(*) n_events, count(rating) review_count, sum(rating)::DOUBLE rating_total, min(full_date) first_day, max(full_date) last_day
    FROM ev WHERE full_date BETWEEN DATE '{_RANGE[0]}' AND DATE '{_RANGE[1]}' GROUP BY user_id""",
)
def p3_range_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a range of days that cuts two buckets: whole buckets from the state, boundary events from the facts."""
    return _feature_state(spark, sf).features(*_RANGE, _events(spark, sf)).select(
        F.col("entity").alias("user_id"), "n_events", "review_count", "rating_total", "first_day", "last_day"
    )


@R.add(
    "p3_changed_buckets",
    f"""SELECT CAST(floor((full_date - DATE '1970-01-01') / 365) AS INTEGER) bucket, bool_or(loaded_at > TIMESTAMPTZ '{FIRST_LOAD}+00') changed
    FROM fact_interactions JOIN dim_date USING (date_id) GROUP BY 1""",
)
def p3_changed_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Which time buckets the second of two loads changed: those the load brought rows for, the others keep their state."""
    facts = _events(spark, sf)
    state = EntityFeatures(spark, scratch_path(spark, "features"), EventColumns(loaded="loaded_at"), bucket_days=365)
    first = state.refresh(facts.filter(F.col("loaded_at") <= F.lit(FIRST_LOAD).cast("timestamp")))
    again = state.refresh(facts)
    rows = [(b, b in again) for b in sorted({*first, *again}) if b != NO_DATE]
    return spark.createDataFrame(rows, "bucket int, changed boolean")


# ---------------------------------------------------------------------------------------------------------------- p4

_VALUE = r"""[\p{L}\p{M}\p{N}\-&%.][\p{L}\p{M}\p{N}\-&%.'' ]*"""
PACKED_SQL = rf"""
s AS (SELECT recipe_id, 'top_ingredients' field_name, top_ingredients t FROM dim_recipe
      UNION ALL SELECT recipe_id, 'tags', tags FROM dim_recipe),
m AS (SELECT recipe_id, field_name, regexp_extract_all(t, '"(?:\\["'']|""|[^"])*(?:"|$)|''(?:\\["'']|''''|[^''])*(?:''|$)|{_VALUE}') toks
      FROM s WHERE t IS NOT NULL),
u AS (SELECT recipe_id, field_name, unnest(toks) tok, generate_subscripts(toks, 1) i FROM m),
w AS (SELECT recipe_id, field_name, i, trim(CASE
        WHEN tok[1] = '"' THEN regexp_replace(tok[2:-2], '\\(["''])|"(")', '\1\2', 'g')
        WHEN tok[1] = '''' THEN regexp_replace(tok[2:-2], '\\(["''])|''('')', '\1\2', 'g')
        ELSE tok END, e' \t\r\n') v FROM u),
packed AS (SELECT recipe_id, field_name, CAST(row_number() OVER (PARTITION BY recipe_id, field_name ORDER BY i) AS INTEGER) item_pos,
                  v item_value FROM w WHERE v <> '')
"""


def packed_values(spark: SparkSession, sf: str, fields: tuple[str, ...] = ("top_ingredients", "tags")) -> DataFrame:
    return split_packed(table(spark, sf, "dim_recipe"), "recipe_id", list(fields))


@R.add("p4_found", f"WITH {PACKED_SQL} SELECT recipe_id, field_name, item_pos, item_value FROM packed")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the packed fields of recipes, with its place."""
    return packed_values(spark, sf)


# ---------------------------------------------------------------------------------------------------------------- p6

_REFS = """
refs AS (SELECT interaction_id, 'recipe_id' ref_field, recipe_id AS key, loaded_at FROM fact_interactions
         UNION ALL SELECT interaction_id, 'user_id', user_id, loaded_at FROM fact_interactions
         UNION ALL SELECT interaction_id, 'date_id', date_id, loaded_at FROM fact_interactions),
parents AS (SELECT 'recipe_id' ref_field, recipe_id AS key, loaded_at born, deleted_at gone FROM dim_recipe
            UNION ALL SELECT 'user_id', user_id, loaded_at, deleted_at FROM dim_user
            UNION ALL SELECT 'date_id', date_id, TIMESTAMPTZ '0001-01-01 00:00:00+00', NULL FROM dim_date),
orphans AS (SELECT * FROM refs r WHERE key IS NOT NULL AND loaded_at IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM parents p WHERE p.ref_field = r.ref_field AND p.key = r.key AND p.born <= r.loaded_at
                 AND (p.gone IS NULL OR p.gone > r.loaded_at)))
"""
REF_FIELDS = ["recipe_id", "user_id", "date_id"]


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return references(table(spark, sf, "fact_interactions"), "interaction_id", "loaded_at", REF_FIELDS)


def _tracked(spark: SparkSession, sf: str) -> OrphanTracker:
    parents = (
        parent_rows(table(spark, sf, "dim_recipe"), "recipe_id", "recipe_id", "loaded_at", "deleted_at")
        .unionByName(parent_rows(table(spark, sf, "dim_user"), "user_id", "user_id", "loaded_at", "deleted_at"))
        .unionByName(parent_rows(table(spark, sf, "dim_date"), "date_id", "date_id"))
    )
    return track(_refs(spark, sf), parents)


@R.add("p6_found", f"WITH {_REFS} SELECT DISTINCT interaction_id, ref_field FROM orphans")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions with a delivered reference that had no live row when it was loaded."""
    return _tracked(spark, sf).found().select("interaction_id", "ref_field").distinct()


@R.add(
    "p6_report",
    f"""WITH {_REFS},
    o AS (SELECT ref_field, CAST(date_trunc('month', loaded_at) AS DATE) AS month, count(*) n_orphans, count(DISTINCT key) n_keys
          FROM orphans GROUP BY ALL),
    t AS (SELECT ref_field, CAST(date_trunc('month', loaded_at) AS DATE) AS month, count(*) n_refs
          FROM refs WHERE key IS NOT NULL AND loaded_at IS NOT NULL GROUP BY ALL)
    SELECT t.ref_field, t.month, n_refs, coalesce(n_orphans, 0) n_orphans, coalesce(n_keys, 0) n_keys
    FROM t LEFT JOIN o USING (ref_field, month)""",
)
def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """References and orphans per dimension and month of loading."""
    month = F.trunc(F.col("ref_at").cast("date"), "month").alias("month")
    totals = _refs(spark, sf).filter("ref_at is not null").groupBy("ref_field", month).agg(
        F.count(F.lit(1)).alias("n_refs")
    )
    found = (
        _tracked(spark, sf).found()
        .groupBy("ref_field", month, "key").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("ref_field", "month").agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_keys"))
    )
    out = totals.join(found, ["ref_field", "month"], "left").fillna(0, ["n_orphans", "n_keys"])
    return out.select("ref_field", "month", "n_refs", "n_orphans", "n_keys")


#: Cuts of the replay, the state of each key at each cut, and what changed in between.
_STATE = f"""{_REFS},
ends AS (SELECT epoch_us(min(loaded_at)) lo, epoch_us(max(loaded_at)) hi FROM refs WHERE key IS NOT NULL),
cuts AS (SELECT i AS n, make_timestamptz(lo + (hi - lo) * i // 3) t FROM ends, (SELECT unnest([1, 2, 3]) i)),
k AS (SELECT DISTINCT ref_field, key FROM refs WHERE key IS NOT NULL AND loaded_at IS NOT NULL),
alive AS (SELECT DISTINCT n, ref_field, key FROM parents, cuts WHERE born <= t AND (gone IS NULL OR gone > t)),
was AS (SELECT n, ref_field, key, count(*) n_refs FROM refs, cuts WHERE key IS NOT NULL AND loaded_at <= t GROUP BY ALL),
came AS (SELECT n, ref_field, key, count(*) n_found FROM orphans, cuts WHERE loaded_at <= t AND NOT EXISTS (
           SELECT 1 FROM cuts c WHERE c.n = cuts.n - 1 AND loaded_at <= c.t) GROUP BY ALL),
s AS (SELECT cuts.n, t, k.ref_field, k.key, coalesce(n_refs, 0) n_refs, coalesce(n_found, 0) n_found, a.n IS NOT NULL lives
      FROM k CROSS JOIN cuts LEFT JOIN was w ON w.n = cuts.n AND w.ref_field = k.ref_field AND w.key = k.key
      LEFT JOIN came c ON c.n = cuts.n AND c.ref_field = k.ref_field AND c.key = k.key
      LEFT JOIN alive a ON a.n = cuts.n AND a.ref_field = k.ref_field AND a.key = k.key),
w AS (SELECT *, CASE WHEN lives THEN 0 ELSE n_refs END n_waiting FROM s),
d AS (SELECT *, n_found + coalesce(lag(n_waiting) OVER (PARTITION BY ref_field, key ORDER BY n), 0) n_open FROM w)
"""


@R.add(
    "p6_pending",
    f"WITH {_STATE} SELECT ref_field, key AS key_id, n_refs, n_waiting FROM w WHERE n = 3 AND n_waiting > 0",
)
def p6_pending(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that references still wait for at the end of the replayed history, with the number of references."""
    return _tracked(spark, sf).pending().withColumnRenamed("key", "key_id")


@R.add(
    "p6_snapshots",
    f"""WITH {_STATE} SELECT ref_field, t AS until, sum(n_found)::BIGINT n_new, sum(CASE WHEN lives THEN n_open ELSE 0 END)::BIGINT n_resolved,
    sum(CASE WHEN lives THEN 0 ELSE n_refs - n_open END)::BIGINT n_reopened, sum(n_waiting)::BIGINT n_waiting FROM d
    WHERE EXISTS (SELECT 1 FROM w x WHERE x.ref_field = d.ref_field AND x.n <= d.n AND x.n_refs > 0) GROUP BY ref_field, t""",
)
def p6_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """New, resolved, reopened and waiting references after each batch of the replayed history."""
    return _tracked(spark, sf).snapshot()


# ---------------------------------------------------------------------------------------------------------------- p7

_KEYS = """
k AS (SELECT 'user_id' field_name, user_id key_id, rating, sentiment_score FROM fact_interactions
      UNION ALL SELECT 'recipe_id', recipe_id, rating, sentiment_score FROM fact_interactions)
"""


def _key_stats(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "fact_interactions")
    return per_key_stats(facts, ["user_id", "recipe_id"], ["rating", "sentiment_score"])


@R.add(
    "p7_found",
    f"""WITH {_KEYS} SELECT field_name, key_id FROM k WHERE key_id IS NOT NULL GROUP BY ALL
    HAVING count(*) * 50 >= (SELECT count(*) FROM fact_interactions)""",
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that hold at least 2 % of all delivered rows; all of them are heavy, so their rows went through the chunks."""
    total = table(spark, sf, "fact_interactions").count()
    return _key_stats(spark, sf).filter(F.col("n_rows") * 50 >= total).select("field_name", "key_id")


@R.add(
    "p7_key_stats",
    f"""WITH {_KEYS} SELECT field_name, key_id, count(*) n_rows,
    {steady_sql('avg(rating)')} AS mean_rating,
    {steady_sql('avg(sentiment_score)')} AS mean_sentiment
    FROM k WHERE key_id IS NOT NULL GROUP BY ALL""",
)
def p7_key_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean rating and mean sentiment of every key."""
    r4 = lambda c: steady_round(F.col(c))
    return _key_stats(spark, sf).select(
        "field_name", "key_id", "n_rows", r4("mean_rating").alias("mean_rating"), r4("mean_sentiment_score").alias("mean_sentiment")
    )


@R.add(
    "p7_rating_changes",
    """WITH k AS (SELECT 'user_id' field_name, user_id key_id, rating, loaded_at, interaction_id FROM fact_interactions
      UNION ALL SELECT 'recipe_id', recipe_id, rating, loaded_at, interaction_id FROM fact_interactions),
    w AS (SELECT *, row_number() OVER o rn, lag(rating) OVER o before FROM k WHERE key_id IS NOT NULL
          WINDOW o AS (PARTITION BY field_name, key_id ORDER BY loaded_at NULLS FIRST, interaction_id NULLS FIRST, rating NULLS FIRST))
    SELECT field_name, key_id, count(*) n_rows, count(*) FILTER (rn > 1 AND rating IS DISTINCT FROM before) n_changes FROM w GROUP BY ALL""",
)
def p7_rating_changes(spark: SparkSession, sf: str) -> DataFrame:
    """How often the rating of a key differs from the one before in order of loading: a result that hangs on the order of a
    key's rows, merged from the boundary states of its chunks."""
    facts = table(spark, sf, "fact_interactions")
    out = value_changes(facts, ["user_id", "recipe_id"], "rating", ["loaded_at", "interaction_id"])
    return out.select("field_name", "key_id", "n_rows", "n_changes")


R.plain("p3_user_features", dates=("first_day", "last_day"))
R.plain("p3_user_type_features", dates=("last_day",))
R.plain("p3_range_features", dates=("first_day", "last_day"))
R.plain("p6_report", dates=("month",))
R.plain("p6_snapshots", micros=("until",))
