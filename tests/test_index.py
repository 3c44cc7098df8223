import random

import pytest

from tidings.functions.boolean import predicate
from tidings.operators.index import SearchIndex

QUERIES = ["oats", "oats rye", "oats and rye", "oats and not rye", "not oats", '"rye bread"', '"rye bread crust"', '"oats rye"~2', '"rye oats bread"~0', "bre*", "(oats or corn) and -bread", "crust and bre*", '"bread rye bread"']
WORDS = "oats rye bread breads crust corn".split()


def text(rng):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", "\n", "  ", "-"]) for _ in range(rng.randint(0, 9)))


def scan(spark, state, query, exact):
    df = spark.createDataFrame([(i, t) for i, t in state.items()], "stories_id long, text string")
    return {r.stories_id for r in df.filter(predicate(query, exact=exact)).collect()}


def test_equal_to_the_scan_after_updates_and_deletes(spark):
    rng, state, index = random.Random(4), {}, SearchIndex(spark, fan=3)
    for batch in range(5):
        changes = {}
        for i in rng.sample(range(60), 25 if batch else 60):
            gone = batch > 0 and rng.random() < 0.3
            changes[i] = (i, None if gone else text(rng), gone)
            if gone:
                state.pop(i, None)
            else:
                state[i] = changes[i][1]
        index.add(spark.createDataFrame(list(changes.values()), "stories_id long, text string, deleted boolean"), batch)
    assert len(index.runs) < 5 and max(r.level for r in index.runs) == 1
    index.add(spark.createDataFrame([(1, "oats only", False)], "stories_id long, text string, deleted boolean"), 4)  # redone: nothing changes
    opened = SearchIndex(spark, index.path, fan=3)
    assert opened.runs == index.runs and opened.batches == index.batches
    for k, q in enumerate(QUERIES):
        for exact in (True, False) if k in (0, 7, 9) else (True,):
            assert {r.stories_id for r in (opened if k % 2 else index).search(q, exact).collect()} == scan(spark, state, q, exact), (q, exact)


def test_newest_change_and_odd_rows(spark):
    index = SearchIndex(spark)
    index.add(spark.createDataFrame([(1, "old oats", 1), (1, "new rye", 2), (None, "oats", 1), (2, None, 1), (3, "", 1)], "stories_id long, text string, changed int"))
    assert [r.stories_id for r in index.search("rye").collect()] == [1]
    assert index.search("oats").count() == 0
    assert sorted(r.stories_id for r in index.search("not rye").collect()) == [2, 3]
    assert SearchIndex(spark).search("rye").count() == 0


def test_a_search_reads_postings_only(spark):
    index = SearchIndex(spark)
    index.add(spark.createDataFrame([(i, f"word{i} shared", False) for i in range(50)], "stories_id long, text string, deleted boolean"))
    plan = index.search("word7 and shared")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Or(EqualTo(word,shared),EqualTo(word,word7))" in plan or "In(word" in plan, plan
    assert "ReadSchema: struct<stories_id:bigint,word:string,place:int>" in plan and "text" not in plan.replace("context", "")


@pytest.mark.parametrize("query", ["", "language:en"])
def test_no_text_clause(spark, query):
    with pytest.raises(ValueError):
        SearchIndex(spark).search(query)
