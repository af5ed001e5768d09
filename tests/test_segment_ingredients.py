from larder.plans.analytics import segment_top_ingredients


def test_users_and_lists_of_ingredients_are_not_broadcast(spark, tmp_path, rows):
    """Spark estimates the lists at 20 bytes each, whatever they hold, so small files would be broadcast at any real size."""
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("dim_date", [(1, "2024-01-01")], "date_id int, full_date string")
    facts = [(k, u, r, 1, 5, None) for k, (u, r) in enumerate([(1, 10), (1, 11), (2, 10), (3, 11), (4, 10), (1, 12)])]
    save("fact_interactions", facts, "interaction_id bigint, user_id bigint, recipe_id bigint, date_id int, rating int, loaded_at string")
    save("dim_user", [(1, 0), (2, 0), (3, 1), (4, None)], "user_id bigint, cluster_id int")
    lists = [(10, ["salt", "oat"] + [f"z{i}" for i in range(2000)]), (11, ["salt", "salt"]), (12, [])]
    save("recipes_clean", [(i, x, "2020-01-01") for i, x in lists], "id bigint, ingredients_canonical_list array<string>, extract_date string")
    df = segment_top_ingredients(spark, str(tmp_path))
    assert rows(df) == [(0, "oat", 1, 2), (0, "salt", 3, 1), (0, "z0", 1, 3), (0, "z1", 1, 4), (0, "z10", 1, 5), (1, "salt", 2, 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [user_id" in plan and "SortMergeJoin [id" in plan
    assert "BroadcastHashJoin [user_id" not in plan and "BroadcastHashJoin [id" not in plan
