"""Plans that have to hold at size: work dealt over tasks, and each table shuffled once."""

import itertools
import re

from textveil.plans import function_queries, gateway_queries, vault_queries

FOLDER = "/root/testdata/sf0.001"


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_texts_of_slim_tables_are_dealt(spark):
    """A customer file is one task; what is made of its rows is not."""
    for query in (vault_queries.mask_markdown, function_queries.QUERIES["find_card_in_letters"], vault_queries.coref_sweep):
        assert query(spark, FOLDER).rdd.getNumPartitions() >= 8


def test_spans_are_matched_after_one_shuffle(spark):
    assert _exchanges(vault_queries.eval_mistakes(spark, FOLDER)) == 1
    # One for the spans, one for the counts.
    assert _exchanges(vault_queries.threshold_sweep(spark, FOLDER)) == 2
    rows = vault_queries.threshold_sweep(spark, FOLDER).collect()
    assert len(rows) == 12


def _broadcast_unshuffled(df):
    """Sides of joins that are broadcast as they are stored: behind an exchange their size is known before, and a large one is not."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[ :+-]*", x)[0]) for x in lines]
    below = [[x for x, _ in itertools.takewhile(lambda y, i=i: y[1] > depth[i], zip(lines[i + 1 :], depth[i + 1 :], strict=True))] for i in range(len(lines))]
    return [x for x, under in zip(lines, below, strict=True) if "BroadcastExchange" in x and not any("- Exchange " in y for y in under)]


def test_stored_rows_are_not_broadcast_by_estimate(spark):
    """Events and spans that generators made of some rows of input are as many as they are: no join sends them through the driver."""
    entities = vault_queries.vault._held(vault_queries.vault.new_entities(vault_queries._mentions(spark, FOLDER)))
    mentions = vault_queries._mentions(spark, FOLDER)
    letters = vault_queries._pseudonymised(spark, FOLDER)
    plans = {
        "streams": gateway_queries.responses_stream_events(spark, FOLDER), "letters": letters.texts, "entries": letters.entries,
        "restore": vault_queries.vault.restore_entries(mentions, entities, []), "forms": vault_queries.vault.surface_forms(mentions, entities, []),
        "outcomes": vault_queries.vault.outcomes(letters.entries, letters.entries, entities), "adopted": vault_queries.vault.adopted(letters.entries, entities, letters.entries),
    }
    assert {k: x for k, df in plans.items() if (x := _broadcast_unshuffled(df))} == {}
    assert plans["streams"].count() == 1650


def test_values_are_found_without_a_broadcast_of_entities(spark):
    """Entries meet entities, digests meet those asked for, and placeholders meet values: all three are shuffled."""
    plan = vault_queries.encrypted_values(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3
