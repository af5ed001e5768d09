"""Wiring of the stages from raw tables to the warehouse: one lazy plan per output, actions only at the sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.config import Config
from larder.functions import text as X
from larder.operators import quality as Q
from larder.operators import ratings as A
from larder.operators import sentiment as S
from larder.operators import warehouse as W
from larder.sources.readers import has_new_rows, read_if_there
from larder.sources.tables import read_table
from larder.sources.writers import replace_parquet, write_new_only, write_upsert


def clean_interactions(raw: DataFrame, c: Config) -> DataFrame:
    """Raw reviews (user_id, recipe_id, date, rating, review) through all rules, in order."""
    Q.require_columns(raw, ["user_id", "recipe_id", "date", "rating", "review"])
    rows = Q.parse_dates(raw, "date").dropna(subset=["user_id", "recipe_id"])
    rows = Q.not_after(rows.withColumn("rating", Q.coerce_rating(F.col("rating").cast("string"))), "date", c.as_of)
    rows = Q.keep_first(rows.filter("rating is not null"), ["user_id", "recipe_id", "date"], ["rating", "review"])
    rows = rows.withColumn("review", X.short_as_null(X.nfc(X.clean_review(F.col("review")))))
    return Q.drop_users(rows, Q.busy_users(rows, "user_id", F.col("date").cast("date"), c.bot_rows_per_day), "user_id")


def clean_recipes(raw: DataFrame) -> DataFrame:
    """Raw recipes (id, name, minutes, nutrition, ingredients) to typed rows, one per id."""
    Q.require_columns(raw, ["id", "name", "minutes", "nutrition", "ingredients"])
    norm = lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")
    items = F.transform(X.list_literal(F.col("ingredients")), norm)
    rows = raw.filter("id is not null").select(
        "id", Q.clean_name(F.col("name")).alias("name"), Q.clean_minutes(F.col("minutes")).alias("minutes"), items.alias("ingredients"), *Q.parse_nutrition(F.col("nutrition"))
    )
    rows = Q.keep_first(rows.filter("name is not null"), ["id"], ["name", "minutes"])
    return rows.withColumns(
        {n: Q.negative_as_null(F.col(n)) for n in Q.NUTRITION} | {
            "ingredient_count": F.when(F.col("ingredients").isNotNull(), F.size("ingredients"))
        }
    )


@dataclass
class Pipeline:
    """Stages by name in order; each gets the outputs so far. A stage whose output is None keeps what was there."""

    spark: SparkSession
    config: Config
    stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame | None]]] = field(default_factory=list)

    def add(self, name: str, f: Callable[[dict[str, DataFrame]], DataFrame | None]) -> Pipeline:
        self.stages.append((name, f))
        return self

    def run(self, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        done = dict(inputs)
        for name, f in self.stages:
            out = f(done)
            if out is not None:
                done[name] = out
        return done


def warehouse_pipeline(spark: SparkSession, c: Config) -> Pipeline:
    """interactions + recipes -> clean -> sentiment -> users and ratings -> dimensions and facts under output_dir."""

    def load(name: str, keys: list[str], update: list[str] | None = None, of: str = "") -> Callable:
        def put(t: dict[str, DataFrame]) -> DataFrame:
            path = f"{c.output_dir}/{name}"
            if update is None:
                write_new_only(t[of], path, keys)
            else:
                write_upsert(t[of], path, keys, update)
            return read_table(spark, path)

        return put

    def facts(t: dict[str, DataFrame]) -> DataFrame:
        return W.fact_interactions(t["scored"], t["dim_date"])

    p = Pipeline(spark, c)
    p.add("clean", lambda t: clean_interactions(t["interactions"], c))
    p.add("scored", lambda t: t["clean"].withColumn("sentiment_score", S.lexicon_score(F.col("review"))))
    p.add("clean_recipes", lambda t: clean_recipes(t["recipes"]))
    p.add("users", lambda t: A.user_stats(t["scored"].withColumn("date", F.col("date").cast("date"))))
    p.add("ratings", lambda t: A.bayes_rating(t["scored"], "recipe_id", "user_id", "sentiment_score", c.pseudo_count))
    p.add("dates", lambda t: W.new_dates(t["scored"], "date", read_if_there(spark, f"{c.output_dir}/dim_date")))
    p.add("dim_date", load("dim_date", ["full_date"], None, "dates"))
    p.add("dim_user", load("dim_user", ["user_id"], ["review_count", "avg_rating_given", "std_rating_given", "recipe_diversity", "avg_sentiment_score", "avg_rating_gap",
                                                     "pct_positive_sentiment", "active_days", "last_review_date"], "users"))
    p.add(
        "recipe_rows",
        lambda t: t["clean_recipes"].join(
            t["ratings"].withColumnsRenamed(
                {
                    "recipe_id": "id", "rating": "sentiment_rating", "weight": "weighted_review_count",
                    "n": "review_count"
                }
            ),
            "id", "left"
        )
    )
    p.add(
        "dim_recipe",
        load(
            "dim_recipe", ["id"],
            ["minutes", "ingredients", "ingredient_count", "sentiment_rating", "weighted_review_count", "review_count"],
            "recipe_rows"
        )
    )
    p.add("facts", facts)
    p.add(
        "fact_interactions",
        load(
            "fact_interactions", ["interaction_id"],
            ["sentiment_score", "rating_normalized", "rating_sentiment_gap", "source"], "facts"
        )
    )
    return p


# Tables of the app and of search signals with their columns, keys, and the columns that a load renews.
# A table without such columns takes new keys only.
APP_TABLES = {
    "dim_canonical_ingredient_nutrients": (
        "canonical_ingredient string, calories_per_100g double, protein_g_per_100g double, fat_g_per_100g double, "
        "saturated_fat_g_per_100g double, sugar_g_per_100g double, sodium_g_per_100g double, carbs_g_per_100g double, "
        "computed_date date",
        ["canonical_ingredient"],
        ["calories_per_100g", "protein_g_per_100g", "fat_g_per_100g", "saturated_fat_g_per_100g", "sugar_g_per_100g",
         "sodium_g_per_100g", "carbs_g_per_100g", "computed_date"],
    ),
    "fact_substitution_recommendations": (
        "candidate_ingredient string, substitute_ingredient string, substitute_similarity double, recommendation_score double, "
        "rating_delta double, sentiment_delta double, protein_delta double, saturated_fat_delta double, sugar_delta double, "
        "sodium_delta double, calories_delta double, health_delta double, updated_at timestamp",
        ["candidate_ingredient", "substitute_ingredient"],
        ["substitute_similarity", "recommendation_score", "rating_delta", "sentiment_delta", "protein_delta",
         "saturated_fat_delta", "sugar_delta", "sodium_delta", "calories_delta", "health_delta", "updated_at"],
    ),
    "recipe_gap_analysis": (
        "source string, raw_term string, canonical_term string, source_score double, best_term string, similarity double, "
        "match_status string, gap_score double, top_gap_rank bigint, opportunity_label string, insight_summary string, "
        "gap_reason string, matching_method string, fetched_date date",
        ["source", "canonical_term"],
        ["raw_term", "source_score", "best_term", "similarity", "match_status", "gap_score", "top_gap_rank",
         "opportunity_label", "insight_summary", "gap_reason", "matching_method", "fetched_date"],
    ),
    "recipe_term_clusters": (
        "cluster_id bigint, cluster_label string, representative_term string, source_terms string, sources_present string, "
        "dominant_tags string, avg_gap_score double, max_gap_score double, best_match string, coverage_count bigint, "
        "explanation string",
        ["representative_term"],
        ["cluster_id", "cluster_label", "source_terms", "sources_present", "dominant_tags", "avg_gap_score", "max_gap_score",
         "best_match", "coverage_count", "explanation"],
    ),
    "google_trends_raw": (
        "seed_query string, related_query string, query_type string, fetched_date date, raw_value bigint",
        ["seed_query", "related_query", "query_type", "fetched_date"], ["raw_value"],
    ),
    "google_trends_normalised": (
        "seed_query string, related_query string, query_type string, fetched_date date, raw_value bigint, normalised_score double",
        ["seed_query", "related_query", "query_type", "fetched_date"], ["raw_value", "normalised_score"],
    ),
    "ai_mode_raw": (
        "seed_query string, block_index int, body string, fetched_date date",
        ["seed_query", "block_index", "fetched_date"], ["body"],
    ),
    "ai_mode_term_scores": (
        "term string, raw_frequency bigint, normalised_score double, fetched_date date",
        ["term", "fetched_date"], ["raw_frequency", "normalised_score"],
    ),
    "gap_analysis": (
        "term string, combined_score double, recipe_count bigint, gap_score double, opportunity_tier string, computed_date date",
        ["term", "computed_date"], ["combined_score", "recipe_count", "gap_score", "opportunity_tier"],
    ),
    "recipe_tags": (
        "recipe_id bigint, tag string, dimension string, matched_term string, canonical_term string, source string",
        ["recipe_id", "tag", "matched_term", "canonical_term", "source"], [],
    ),
    "signal_tags": (
        "term string, data_source string, tag string, dimension string, matched_term string", ["term", "data_source", "tag"], [],
    ),
}


def load_app_table(spark: SparkSession, c: Config, name: str, rows: DataFrame) -> DataFrame:
    """Loads ``rows`` (unique by the table's keys) into a table of ``APP_TABLES`` and returns the table."""
    columns, keys, update = APP_TABLES[name]
    path = f"{c.output_dir}/{name}"
    ready = W.conform(rows, T._parse_datatype_string(columns))
    if update:
        write_upsert(ready, path, keys, update)
    else:
        write_new_only(ready, path, keys)
    return read_table(spark, path)


def run_if_new(
    spark: SparkSession, c: Config, interactions: DataFrame, recipes: DataFrame, block: bool = False
) -> dict[str, DataFrame] | None:
    """Runs the pipeline; with ``block`` only if a clean (user, recipe, date) is not stored yet. An empty input keeps the old tables."""
    if interactions.isEmpty():
        return None
    if block and not c.rebuild:
        stored = read_if_there(spark, f"{c.output_dir}/fact_interactions")
        days = read_if_there(spark, f"{c.output_dir}/dim_date")
        if stored is not None and days is not None:
            new = clean_interactions(interactions, c).select(
                W.interaction_id(F.col("user_id"), F.col("recipe_id"), F.col("date")).alias("interaction_id")
            )
            if not has_new_rows(new, stored, ["interaction_id"]):
                return None
    return warehouse_pipeline(spark, c).run({"interactions": interactions, "recipes": recipes})


def build_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at ``path``; made and stored if missing or ``rebuild`` is set."""
    had = None if rebuild else read_if_there(spark, path)
    if had is not None:
        return had
    replace_parquet(make(), path)
    return read_table(spark, path)
