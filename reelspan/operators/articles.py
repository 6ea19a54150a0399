"""Which reference article an entity means: search terms, candidates, decisions, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.scoring import confidence_action, match_quality
from reelspan.operators.ordering import number_rows


def validate_titles(queries: DataFrame, articles: DataFrame, redirects: DataFrame) -> DataFrame:
    """Check query titles (…, query) against articles and redirects: valid, canonical.

    Each title is looked up once. Where ``articles`` has a null ``found`` (the lookup failed), the title
    counts as valid.
    """
    names = queries.select("query").distinct()
    known = articles.select(F.col("title"), F.coalesce("found", F.lit(True)).alias("ok")).unionByName(redirects.select(F.col("from_title").alias("title"), F.lit(True).alias("ok")))
    known = known.groupBy("title").agg(F.max("ok").alias("ok"))
    to = redirects.groupBy(F.col("from_title").alias("title")).agg(F.min("to_title").alias("to_title"))
    checked = names.join(known.hint("merge"), names["query"] == known["title"], "left").drop("title").join(to.hint("merge"), F.col("query") == F.col("title"), "left")
    result = checked.select(F.col("query"), F.coalesce("ok", F.lit(False)).alias("valid"), F.coalesce("to_title", "query").alias("canonical"))
    return queries.join(result.hint("merge"), "query")


def validated_strategies(checked: DataFrame) -> DataFrame:
    """Per entity its valid queries in order; without any, the entity's own name and status ``fallback``."""
    rows = F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct("query_no", "query"))))
    grouped = checked.groupBy("transcript_id", "entity").agg(F.transform(rows, lambda x: x["query"]).alias("queries"))
    none = F.size("queries") == 0
    return grouped.select("transcript_id", "entity", F.when(none, F.array("entity")).otherwise(F.col("queries")).alias("queries"), F.when(none, "fallback").otherwise("validated").alias("status"))


def search_terms(entity: Column, best_title: Column, best_valid: Column, queries: Column) -> Column:
    """Terms in the order to try: a valid best title, valid queries, the entity's name; each once."""
    first = F.when(F.coalesce(best_valid, F.lit(False)) & (F.coalesce(best_title, F.lit("")) != ""), F.array(best_title)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(first, F.coalesce(queries, F.expr("cast(array() as array<string>)")), F.array(entity)))


def terms_by_confidence(confidence: Column, title: Column, terms: Column) -> Column:
    """A sure title alone; a less sure one before the other terms; without a title the terms."""
    return F.when(title.isNull(), terms).when(confidence >= 7, F.array(title)).otherwise(F.array_distinct(F.concat(F.array(title), terms)))


def first_usable(terms: DataFrame, usable: DataFrame) -> DataFrame:
    """Per entity the first of its terms that is among the ``usable`` (term)."""
    each = terms.select("transcript_id", "entity", F.posexplode("terms").alias("pos", "term"))
    return each.join(usable.select("term").distinct().hint("merge"), "term", "left_semi").groupBy("transcript_id", "entity").agg(F.min_by("term", "pos").alias("matched"), F.min("pos").alias("pos"))


def strategy_label(matched: Column, best_title: Column, queries: Column, entity: Column) -> Column:
    place = F.array_position(queries, matched)
    return F.when(matched.isNull(), "failed").when(matched == best_title, "best_title").when(place > 0, F.concat(F.lit("query_"), place)).when(matched == entity, "fallback").otherwise("unknown")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: F.char_length(w) > 2))


def _postings(articles: DataFrame, k: int) -> DataFrame:
    """Word, and each article whose title holds it; under the word behind ``_FIRST`` only the first ``k`` of these by title."""
    titles = articles.select("page_id", "title").distinct().withColumn("tokens", tokens(F.col("title")))
    words = titles.select(F.explode("tokens").alias("word"), "page_id", "title", "tokens")
    first = F.row_number().over(Window.partitionBy("word").orderBy("title", "page_id"))
    firsts = words.withColumn("k", first).where(F.col("k") <= k).select(F.concat(F.lit(_FIRST), "word").alias("word"), "page_id", "title", "tokens")
    return words.unionByName(firsts)


#: Signs before a word that no word holds: the head of a list of articles, and a row that brings its article along.
_FIRST, _KNOWN = "\x01", "\x02"


def top_articles(entities: DataFrame, articles: DataFrame, k: int = 3) -> DataFrame:
    """The k articles that share most words with each entity's queries; ties go to the title, then the page_id.

    An inverted index read by impact, rarest words first, with scores on whole titles. The rarer half of a set of m
    words gives a k-th best score s, and an article that holds none of them and yet comes up to s must hold one of
    the first m - s + 1 words, as its s words can't all be among the last s - 1; so only these are looked up, often
    none. Of the articles of the last, most frequent word the first k by title do: any other one that shares that word
    alone comes after them. So a word of every title is read whole only for sets that hold a more frequent one yet and
    that rarer words leave open. Equal sets of words are looked up once.

    ``entities`` has entity and query, a row for each query; ``articles`` page_id and title. Repeated articles count once;
    entities without a word of any title have no rows. Null queries and titles have no words.
    """
    none = F.expr("cast(array() as array<string>)")
    asked = entities.groupBy("entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(tokens(F.col("query")), none))))).alias("words"))
    asked = asked.where(F.size("words") > 0).withColumn("asked", F.array_join("words", " "))
    postings = _postings(articles, k)
    often = postings.where(~F.startswith("word", F.lit(_FIRST))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    word = asked.select("asked", F.explode("words").alias("word")).distinct().join(often.hint("merge"), "word")
    sets = word.groupBy("asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))

    m, rarer = F.size("words"), F.floor(F.size("words") / 2).cast("int")
    score = F.size(F.array_intersect("words", "tokens")).cast("bigint")
    better = F.struct((-F.col("score")).alias("less"), "title", "page_id")
    found = sets.select("asked", "words", F.explode(F.slice("words", F.lit(1), rarer)).alias("word")).join(postings.hint("merge"), "word")
    found = found.select("asked", "page_id", "title", score.alias("score")).distinct()
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("asked").orderBy(better))).where(F.col("k") <= k)
    best = found.groupBy("asked").agg(F.array_sort(F.collect_list(better)).alias("best"))

    known = sets.join(best.hint("merge"), "asked", "left")
    kth = F.when(F.size("best") >= k, -F.get(F.col("best"), F.lit(k - 1))["less"]).otherwise(1).cast("int")
    probes = F.slice("words", rarer + 1, F.greatest(m - kth + 1 - rarer, F.lit(0)))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("page_id", dict(articles.dtypes)["page_id"]), ("title", "string"), ("score", "bigint"))]
    probe = lambda w: F.struct(F.when(w == F.element_at("words", -1), F.concat(F.lit(_FIRST), w)).otherwise(w).alias("word"), *nothing)
    keep = lambda b: F.struct(F.concat(F.lit(_KNOWN), F.coalesce(b["title"], F.lit(""))).alias("word"), b["page_id"].alias("page_id"), b["title"].alias("title"), (-b["less"]).alias("score"))
    rows = known.select("asked", "words", F.explode(F.concat(F.coalesce(F.transform("best", keep), F.array().cast("array<struct<word:string,page_id:" + dict(articles.dtypes)["page_id"] + ",title:string,score:bigint>>")), F.transform(probes, probe))).alias("x")).select("asked", "words", "x.*")
    met = rows.alias("r").join(postings.alias("p").hint("merge"), F.col("r.word") == F.col("p.word"), "left")
    own = F.col("r.score").isNotNull()
    met = met.select("asked", *[F.when(own, F.col(f"r.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in ("page_id", "title")], F.when(own, F.col("r.score")).otherwise(score).alias("score"))
    ranked = met.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "title", "page_id"))).where(F.col("rank") <= k)
    return asked.select("entity", "asked").join(ranked.hint("merge"), "asked").select("entity", "page_id", "title", "score", "rank")


def context_score(context: Column, summary: Column, era_end: Column, years: Column) -> Column:
    """0 to 10: shared words of context and summary, five of them full marks; halved if all years lie after the era. Our own stand-in where no model decided."""
    shared = F.size(F.array_intersect(tokens(context), tokens(summary)))
    late = era_end.isNotNull() & (F.size(years) > 0) & F.forall(years, lambda y: y > era_end)
    score = F.least(shared * 2, F.lit(10))
    return F.when(late, F.floor(score / 2)).otherwise(score).cast("int")


def ingest_decisions(entities: DataFrame, candidates: DataFrame, model: DataFrame) -> DataFrame:
    """One decision per entity: none without hits, 7 and medium for a single clear hit, to resolve for a single ambiguous one, the model's for several.

    ``candidates`` has entity, title, is_disambiguation; ``model`` entity, title, confidence.
    """
    hits = candidates.groupBy("entity").agg(F.count(F.lit(1)).alias("hits"), F.min("title").alias("only"), F.max("is_disambiguation").alias("ambiguous"))
    joined = entities.join(hits.hint("merge"), "entity", "left").join(model.select("entity", F.col("title").alias("model_title"), F.col("confidence").alias("model_confidence")).hint("merge"), "entity", "left")
    n = F.coalesce("hits", F.lit(0))
    source = F.when(n == 0, "no_results").when((n == 1) & ~F.col("ambiguous"), "single_result").when(n == 1, "disambiguation_page").otherwise("model")
    confidence = F.when(source == "single_result", 7).when(source == "model", F.coalesce("model_confidence", F.lit(0))).otherwise(0)
    quality = F.when(source == "single_result", "medium").otherwise(match_quality(confidence))
    title = F.when(source == "single_result", F.col("only")).when(source == "model", F.col("model_title"))
    return joined.select(*entities.columns, source.alias("source"), title.alias("title"), confidence.cast("int").alias("confidence"), quality.alias("match_quality"), confidence_action(confidence).alias("action"))


def resolve_disambiguation(starts: DataFrame, articles: DataFrame, hops: int = 3, links: int = 5) -> DataFrame:
    """Follow disambiguation pages to an article: of a page's first ``links``, the ones that are no such page themselves; the first of these in title order.

    ``starts`` has entity and page_id; ``articles`` page_id, title, is_disambiguation, links. A page whose links
    are all ambiguous leads on to the first of them. One join per hop for all entities at once; pages still
    ambiguous after ``hops`` have no article (null).
    """
    pages = articles.select("page_id", "title", "is_disambiguation", F.slice("links", 1, links).alias("links"))
    now = starts.join(pages.hint("merge"), "page_id").select("entity", "page_id", "title", "is_disambiguation", "links", F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        todo = now.where("is_disambiguation").select("entity", F.posexplode("links").alias("pos", "page_id"))
        choice = F.struct(F.col("is_disambiguation"), F.when(~F.col("is_disambiguation"), F.col("title")).alias("by_title"), F.col("pos"), F.col("page_id"), F.col("title"), F.col("links"))
        best = todo.join(pages.hint("merge"), "page_id").groupBy("entity").agg(F.min(choice).alias("c"))
        moved = best.select("entity", "c.page_id", "c.title", "c.is_disambiguation", "c.links", F.lit(hop).alias("hops"))
        now = now.where("not is_disambiguation").unionByName(moved)
    done = ~F.col("is_disambiguation")
    return now.select("entity", F.when(done, F.col("page_id")).alias("page_id"), F.when(done, F.col("title")).alias("title"), "hops")


def apply_overrides(decisions: DataFrame, overrides: DataFrame, override_first: bool = False) -> DataFrame:
    """An earlier decision before a manual override before nothing, or the override first; overrides are sure."""
    joined = decisions.join(overrides.select("entity", F.col("title").alias("manual")).hint("merge"), "entity", "left")
    use = F.col("manual").isNotNull() & (F.lit(override_first) | F.col("title").isNull())
    return joined.select(
        *[c for c in decisions.columns if c not in ("title", "confidence", "match_quality", "source")],
        F.when(use, F.col("manual")).otherwise(F.col("title")).alias("title"),
        F.when(use, 10).otherwise(F.col("confidence")).cast("int").alias("confidence"),
        F.when(use, "high").otherwise(F.col("match_quality")).alias("match_quality"),
        F.when(use, "manual_override").otherwise(F.col("source")).alias("source"),
    )


def merge_overrides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both maps of (entity, title); the new one wins."""
    return old.select("entity", F.col("title").alias("before")).join(new.hint("merge"), "entity", "full_outer").select("entity", F.coalesce("title", "before").alias("title"))


def review_queue(decisions: DataFrame) -> DataFrame:
    """Flagged decisions, least sure first, numbered from 1."""
    return number_rows(decisions.where(confidence_action(F.col("confidence")) == "flag"), ["confidence"], "seq")


def request_batches(entities: DataFrame, size: int = 7, context: int = 150) -> DataFrame:
    """Entities in batches for an outside scorer: transcript_id, batch, request."""
    batch = F.floor((F.row_number().over(Window.partitionBy("transcript_id").orderBy("entity_seq")) - 1) / size).cast("int")
    line = F.format_string("%s (%s): %s", "entity", "entity_type", F.substring(F.coalesce("context", F.lit("")), 1, context))
    rows = F.array_sort(F.collect_list(F.struct("entity_seq", line.alias("line"))))
    return entities.withColumn("batch", batch).groupBy("transcript_id", "batch").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("request"))
