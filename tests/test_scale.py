"""Plans of queries with costly work on each row: spread over all cores, and done once."""
import pytest

import __spark_entry__ as entry
from shelfgrade.operators.linkage import identify
from shelfgrade.session import spread

SF = "/root/testdata/sf0.001"


def plan(spark, name, kind="optimizedPlan"):
    return getattr(entry.queries()[name](spark, SF)._jdf.queryExecution(), kind)().toString()


def test_spread_keeps_rows_and_leaves_wide_tables_alone(spark):
    few = spark.range(0, 100, 1, 1)
    assert spread(few).rdd.getNumPartitions() == 4 and sorted(r[0] for r in spread(few).collect()) == list(range(100))
    assert spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9


@pytest.mark.parametrize("name", [
    "selected_prices", "element_sections", "shop_heading_sections", "element_texts", "inline_sections", "faq_pairs", "indexed_tabs",
    "assembled_products", "external_products", "page_extractions"])
def test_page_work_is_spread(spark, name):
    """The table is one file; its pages are not one task's."""
    assert "RoundRobinPartitioning(4)" in plan(spark, name, "executedPlan")


@pytest.mark.parametrize("name", ["element_lists", "list_candidates", "resolved_links"])
def test_page_work_is_done_once(spark, name):
    """No filter repeats what a projection above or a generator computes."""
    filters = [line for line in plan(spark, name).split("\n") if "Filter " in line[:40]]
    assert not [f for f in filters if "transform(" in f or "aggregate(" in f]


def test_a_page_is_cut_into_tokens_once(spark):
    """Filters on the assembled rows do not repeat the assembly."""
    assert plan(spark, "page_extractions").count("<(/?[a-zA-Z][a-zA-Z0-9-]*)([^>]*)>([^<]*), 0)") == 1


@pytest.mark.parametrize("name", [
    "audience_ages", "hair_types", "allergen_summaries", "validated_word_lists", "gold_gate", "gold_gaps", "gold_applied", "gold_funnel"])
def test_text_work_is_spread(spark, name):
    assert "RoundRobinPartitioning(4)" in plan(spark, name, "executedPlan")


@pytest.mark.parametrize("name", ["name_matches", "identified_products"])
def test_matching_is_spread(spark, name):
    assert "RoundRobinPartitioning(4)" in plan(spark, name, "executedPlan")


def test_alike_queries_are_ranked_once(spark):
    """Results are ranked per spelling and volume, not per query: no rows of alike queries times alike products."""
    q = spark.sql("SELECT id AS query_id, 'b' AS brand_slug, CAST(NULL AS STRING) AS ean, 'Oleo Fino' AS product_name_text, CASE WHEN id < 30 THEN '50 ml' END AS volume_text FROM range(40)")
    p = spark.sql("SELECT id AS product_id, 'b' AS brand_slug, CAST(NULL AS STRING) AS ean, 'oleo fino' AS product_name, CASE WHEN id % 10 = 9 THEN '50ml' ELSE '70ml' END AS size_volume FROM range(50)")
    got = identify(q, p)
    assert "windowspecdefinition(query_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append((r["product_id"], r["confidence"]))
    assert all(rows[i] == [(9, 1.0), (19, 1.0), (29, 1.0), (39, 1.0)] for i in range(30))
    assert all(rows[i] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)] for i in range(30, 40))


def test_rules_meet_entries_of_usable_products_only(spark, monkeypatch):
    """Entries of products that cannot be an alternative go before each entry meets a rule for every hair type."""
    from shelfgrade.plans import scoring

    frames, staged = [], scoring.staged
    monkeypatch.setattr(scoring, "staged", lambda d: frames.append(d) or staged(d))
    assert entry.queries()["alternatives"](spark, SF).count() > 0
    facts = [d for d in frames if "hair_type" in d.columns]
    assert len(facts) == 1 and "Join LeftSemi, (product_id" in facts[0]._jdf.queryExecution().optimizedPlan().toString()
