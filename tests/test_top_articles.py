import random

import pytest

from reelspan.operators.articles import top_articles


def words(text):
    return {w for w in (text or "").lower().split() if len(w) > 2}


def brute(entities, articles, k):
    out = []
    for entity in {e for e, _ in entities}:
        asked = set().union(*(words(q) for e, q in entities if e == entity))
        scored = [(-len(asked & words(t)), t, p) for p, t in set(articles) if asked & words(t)]
        out += [(entity, p, t, -s, rank + 1) for rank, (s, t, p) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3])
def test_top_articles_equal_all_pairs_with_words_of_every_title(spark, k):
    r = random.Random(k)
    vocabulary = ["the", "and", *(f"word{int(40 * r.random() ** 3)}" for _ in range(60))]
    title = lambda: " ".join(["The", *r.choices(vocabulary, k=r.randrange(0, 5))])
    articles = [(p, title()) for p in range(150)] + [(900, None), (901, ""), (902, "The"), (3, "The word1")]
    articles += articles[:5]
    entities = [(f"e{i}", " ".join(r.choices([*vocabulary, "The", "unheard", "of"], k=r.randrange(0, 7)))) for i in range(120)]
    entities += [("e0", "the word1"), ("null", None), ("e1", None), ("same", entities[2][1]), ("all", " ".join(vocabulary))]
    got = top_articles(spark.createDataFrame(entities, "entity string, query string"), spark.createDataFrame(articles, "page_id long, title string"), k)
    assert sorted(map(tuple, got.collect())) == brute(entities, articles, k)


def test_no_all_pairs_on_a_word_of_every_title(spark):
    """Entities that ask for a word of every title and a rare one: no join makes a row for every article."""
    n = 3000
    articles = spark.range(n).selectExpr("id AS page_id", "concat('The rare', id div 4) AS title")
    entities = spark.range(400).selectExpr("concat('e', id) AS entity", "concat('the rare', id) AS query")
    got = top_articles(entities, articles)
    rows = got.collect()
    assert len(rows) == 1200 and all(r["score"] == 2 for r in rows)
    made = []

    def walk(node):
        if "SortMergeJoin" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if node.nodeName() in ("AdaptiveSparkPlan",):
            walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())

    walk(got._jdf.queryExecution().executedPlan())
    assert 1200 <= max(made) <= 4 * 1600, made


def test_empty_tables(spark):
    entities, articles = spark.createDataFrame([("e", "the war")], "entity string, query string"), spark.createDataFrame([(1, "The War")], "page_id long, title string")
    assert top_articles(entities, articles.limit(0)).count() == 0 and top_articles(entities.limit(0), articles).count() == 0
    assert [tuple(r) for r in top_articles(entities, articles).collect()] == [("e", 1, "The War", 2, 1)]
