"""Structured search of a parts catalog: lexical overlap plus fitment, for a DataFrame of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.columns import computed
from quarry.operators.ground import grounding
from quarry.plans.shared import written

# Fixed values.
STOP_WORDS = "a an and does fit fits for is part the which".split()
YEAR = r"\b(?:19|20)\d{2}\b"
LEAST_SCORE, FULL_CONFIDENCE = 2.0, 10.0


def tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), T.strings(STOP_WORDS))


def years(text: Column) -> Column:
    """Distinct years, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))))


def within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Active parts of a catalog file, {"parts": [...]}, each with the catalog's version."""
    schema = "parts ARRAY<STRUCT<part_id: STRING, name: STRING, description: STRING, compatible_with: ARRAY<STRING>, source_id: STRING, catalog_version: STRING, deleted: BOOLEAN>>"
    return active_parts(spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("parts").alias("p")).select("p.*"))


def active_parts(parts: DataFrame) -> DataFrame:
    return parts.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def catalog_version(parts: DataFrame) -> DataFrame:
    return parts.agg(F.max("catalog_version").alias("catalog_version"), F.count("*").alias("n_parts"))


def vocabulary(parts: DataFrame) -> DataFrame:
    """(token) of all fitments that is not a number: the terms that name vehicles."""
    each = parts.select(F.explode("compatible_with").alias("f")).select(F.explode(tokens(F.col("f"))).alias("token"))
    return each.where(~F.col("token").rlike("^[0-9]+$")).distinct()


def fitments(texts: Column) -> Column:
    """Each fitment as its tokens, those of the model (without years), and its first and last year: once per part, not per pair."""

    def one(f: Column) -> Column:
        own = years(f)
        return F.struct(tokens(f).alias("tokens"), tokens(F.regexp_replace(f, YEAR, "")).alias("model"), F.get(own, 0).alias("low"), F.get(own, F.size(own) - 1).alias("high"))

    return F.transform(texts, one)


def fitment_fold(fits: Column, terms: Column, words: Column, asked: Column) -> Column:
    """(matched, score) over the fitments in order: three for each matched term, the best counts; two more when the whole model matches.

    A fitment counts if a term other than the years (words) matches it and no year is asked for, or one in its range.
    """

    def judged(fitment: Column) -> Column:
        whole = within(fitment["model"], terms)
        return F.struct(F.array_intersect(words, fitment["tokens"]).alias("match"), F.when(whole, 2.0).otherwise(0.0).alias("more"))

    def step(state: Column, fitment: Column) -> Column:
        score = F.greatest(state["score"], F.size(fitment["match"]) * 3.0) + fitment["more"]
        return F.struct(F.array_union(state["matched"], fitment["match"]).alias("matched"), score.alias("score"))

    in_years = F.filter(fits, lambda f: (F.size(asked) == 0) | F.exists(asked, lambda y: (y >= f["low"]) & (y <= f["high"])))
    start = F.struct(F.array().cast("array<string>").alias("matched"), F.lit(0.0).alias("score"))
    return F.aggregate(F.filter(F.transform(in_years, judged), lambda f: F.size(f["match"]) > 0), start, step)


def candidates(asked: DataFrame, fits: DataFrame) -> DataFrame:
    """(query_id, fit_id) of the questions about a vehicle and the fitments that can match them, each once.

    asked: query_id, words (terms that are no year asked for), asked (years); fits: fit_id, fits. A fitment has to share a term with
    the question, and cover a year it asks for, if it asks for any: they meet on (term, year), of which a fitment has a row for each
    year that it covers.
    """
    words = asked.withColumn("token", F.explode("words"))
    each = fits.select("fit_id", F.explode("fits").alias("f")).select("fit_id", F.explode("f.tokens").alias("token"), "f.low", "f.high")
    yearly = each.where("low is not null").select("fit_id", "token", F.explode(F.sequence("low", "high")).alias("year")).distinct()
    dated = words.where("size(asked) > 0").select("query_id", "token", F.explode("asked").alias("year"))
    undated = words.where("size(asked) = 0").select("query_id", "token")
    pairs = dated.join(yearly, ["token", "year"]).select("query_id", "fit_id")
    return pairs.unionByName(undated.join(each.select("fit_id", "token").distinct(), "token").select("query_id", "fit_id")).distinct()


def _key(*columns: str) -> Column:
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))


def named_parts(ids: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, part_id) where all terms of the id are asked for. ids: part_id, id_terms, known (those that anybody asks for).

    They meet on the term of an id that is in the fewest of the ids that can be named.
    """
    whole = ids.where("size(known) = size(id_terms)").select("part_id", "id_terms", F.explode("id_terms").alias("token"))
    often = whole.groupBy("token").agg(F.count("*").alias("often"))
    rarest = whole.join(often.hint("merge"), "token").groupBy("part_id").agg(F.min(F.struct("often", "token")).alias("least"), F.any_value("id_terms").alias("id_terms"))
    words = queries.select("query_id", "terms", F.explode("terms").alias("token"))
    met = rarest.select("part_id", "id_terms", "least.token").hint("merge").join(words, "token")
    return met.where(within(F.col("id_terms"), F.col("terms"))).select("query_id", "part_id").distinct()


def hopeful(folded: DataFrame, limit: int) -> DataFrame:
    """Of (query_id, fit_id, least, most, n: the bounds of its n parts' scores), those that can have one of the best parts."""
    over = Window.partitionBy("query_id").orderBy(F.desc("least"), "fit_id").rowsBetween(Window.unboundedPreceding, -1)
    needed = F.coalesce(F.sum("n").over(over), F.lit(0)) < limit  # fewer parts than are wanted are surely at least as good
    ranked = folded.withColumn("bar", F.when(needed, F.col("least")))
    enough = F.sum("n").over(Window.partitionBy("query_id")) >= limit
    bar = F.min("bar").over(Window.partitionBy("query_id"))
    return ranked.withColumn("bar", F.when(enough, bar)).where("bar is null or most >= bar").drop("bar", "least", "most", "n")


def search(requests: DataFrame, parts: DataFrame, limit: int = 5, least: float = LEAST_SCORE) -> DataFrame:
    """request_id, part_id, score, confidence, matched_terms, rank; best first, ties by part_id.

    A query that names parts by id gets those only; one with vehicle terms gets parts with a fitment that matches them.

    Equal questions are answered once. Parts that no question can tell apart (the same fitments, terms, and terms of the id that
    anybody asks for) are a kind, of which the first `limit` ids can be among the best. A vehicle's question is compared with each
    distinct list of fitments that can match; only lists whose parts could reach the best scores go on to their kinds. All of
    this is exact. Tables of the size of parts are never broadcast.
    """
    asked = requests.select("request_id", F.array_sort(tokens(F.col("query"))).alias("terms"), years(F.col("query")).alias("asked")).withColumn("query_id", _key("terms", "asked"))
    asked = written(asked, "asked")
    each = asked.select("query_id", "terms", "asked").dropDuplicates(["query_id"])
    named_by = parts.where("part_id is not null").select("part_id", tokens(F.col("part_id")).alias("id_terms"))
    words = written(each.select(F.explode("terms").alias("token")).distinct(), "asked-words")
    known = named_by.select("part_id", "id_terms", F.explode("id_terms").alias("token")).join(words, "token", "left_semi").groupBy("part_id").agg(F.any_value("id_terms").alias("id_terms"), F.collect_set("token").alias("known"))
    known = written(known, "known-ids")
    named = written(named_parts(known, each), "named")
    only = named.select("query_id").distinct().withColumn("only_named", F.lit(True))

    fit_id = F.when(F.col("compatible_with").isNotNull(), _key("compatible_with"))
    rows = parts.where("part_id is not null and compatible_with is not null").select("part_id", fit_id.alias("fit_id"), tokens(F.concat_ws(" ", "name", "description", F.array_join("compatible_with", " "))).alias("body"))
    lists = parts.where("compatible_with is not null").select(fit_id.alias("fit_id"), "compatible_with").dropDuplicates(["fit_id"])
    lists = written(lists.select("fit_id", "compatible_with", fitments(F.col("compatible_with")).alias("fits"), tokens(F.array_join("compatible_with", " ")).alias("fit_terms")), "fitments")
    vehicle = each.select("query_id", F.explode("terms").alias("token")).join(vocabulary(lists), "token", "left_semi").select("query_id").distinct().withColumn("vehicle", F.lit(True))
    years_asked = F.transform("asked", lambda y: y.cast("string"))
    queries = each.join(vehicle, "query_id", "left").join(only, "query_id", "left").select("query_id", "terms", F.array_except("terms", years_asked).alias("words"), "asked", F.coalesce("vehicle", F.lit(False)).alias("vehicle"), F.coalesce("only_named", F.lit(False)).alias("only_named"))
    queries = written(queries, "queries")
    free = queries.where("not only_named").drop("only_named")

    said = written(free.select(F.explode("terms").alias("token")).distinct(), "free-words")
    own = known.select("part_id", F.explode("known").alias("token")).join(said, "token", "left_semi").groupBy("part_id").agg(F.array_sort(F.collect_set("token")).alias("own"))
    none = F.array().cast("array<string>")
    told = rows.join(own.hint("merge"), "part_id", "left").select("part_id", "fit_id", F.array_sort(F.array_union("body", F.coalesce("own", none))).alias("part_terms")).withColumn("kind_id", _key("fit_id", "part_terms"))
    members = told.withColumn("place", F.row_number().over(Window.partitionBy("kind_id").orderBy("part_id"))).where(F.col("place") <= limit)
    members = written(members, "kinds")
    kinds = members.where("place = 1").select("kind_id", "fit_id", "part_terms")

    fold = lambda: fitment_fold(F.col("fits"), F.col("terms"), F.col("words"), F.col("asked"))
    about = free.where("vehicle").drop("vehicle")
    met = candidates(about, lists).join(lists.drop("compatible_with"), "fit_id").join(about, "query_id")
    met = computed(met, fold=fold(), both=F.size(F.array_intersect("terms", "fit_terms"))).where(F.size("fold.matched") > 0)
    bounds = met.select("query_id", "fit_id", "fold", (F.col("fold.score") + F.col("both")).alias("least"), (F.col("fold.score") + F.size("terms")).alias("most"))
    sizes = members.groupBy("fit_id").agg(F.count("*").alias("n"))
    fitting = hopeful(bounds.join(sizes, "fit_id"), limit).join(kinds.hint("merge"), "fit_id").join(about.select("query_id", "terms"), "query_id")

    others = free.where("not vehicle").drop("vehicle")
    share = others.select("query_id", F.explode("terms").alias("token")).join(kinds.select("kind_id", F.explode("part_terms").alias("token")).hint("merge"), "token").select("query_id", "kind_id").distinct()
    sharing = computed(share.join(kinds.hint("merge"), "kind_id").join(lists.drop("compatible_with"), "fit_id").join(others, "query_id"), fold=fold())

    of_kinds = computed(fitting.select("query_id", "kind_id", "terms", "part_terms", "fold").unionByName(sharing.select("query_id", "kind_id", "terms", "part_terms", "fold")), lexical=F.array_intersect("terms", "part_terms"))
    of_kinds = of_kinds.select("query_id", "kind_id", "lexical", "fold").join(members.select("kind_id", "part_id").hint("merge"), "kind_id").drop("kind_id")
    by_id = rows.join(named.hint("merge"), "part_id").withColumn("part_terms", F.array_union("body", tokens(F.col("part_id")))).join(lists.drop("compatible_with"), "fit_id").join(queries.where("only_named"), "query_id")
    by_id = computed(by_id, fold=fold(), lexical=F.array_intersect("terms", "part_terms")).where(~F.col("vehicle") | (F.size("fold.matched") > 0))

    pairs = of_kinds.unionByName(by_id.select("query_id", "part_id", "lexical", "fold"))
    scored = pairs.select("query_id", "part_id", (F.size("lexical") + F.col("fold.score")).alias("score"), "lexical", "fold.matched").where(F.col("score") >= least)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "part_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    found = ranked.select("query_id", "part_id", "score", F.least(F.lit(1.0), F.col("score") / FULL_CONFIDENCE).alias("confidence"), F.array_sort(F.array_union("lexical", "matched")).alias("matched_terms"), "rank")
    return asked.select("request_id", "query_id").hint("merge").join(found.hint("merge"), "query_id").drop("query_id")


def answer(requests: DataFrame, parts: DataFrame, limit: int = 5) -> DataFrame:
    """request_id, outcome, answer, cited, retrieval_score: a line for each hit with its id in brackets, checked like any answer."""
    hits = search(requests, parts, limit).join(parts.select("part_id", "name").hint("merge"), "part_id")
    line = F.struct("rank", F.concat(F.lit("- "), F.col("name"), F.lit(" ["), F.col("part_id"), F.lit("]")).alias("line"))
    found = hits.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("answer"), F.collect_set("part_id").alias("allowed"), F.max("confidence").alias("retrieval_score"))
    cited = T.citations(F.col("answer"), T.PART_CITATION_PATTERN)
    joined = requests.select("request_id").join(found.hint("merge"), "request_id", "left")
    outcome = F.when(F.col("answer").isNull(), "no_evidence").otherwise(grounding(cited, F.col("allowed")))
    return joined.select("request_id", outcome.alias("outcome"), "answer", F.coalesce(cited, F.array().cast("array<string>")).alias("cited"), F.coalesce("retrieval_score", F.lit(0.0)).alias("retrieval_score"))


def freshness(loaded_at: Column, now: Column, max_age: int) -> Column:
    """fresh or stale, by the age in seconds."""
    return F.when(F.unix_micros(now) - F.unix_micros(loaded_at) > max_age * 1_000_000, "stale").otherwise("fresh")


def gate(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row: n, passed, pass_rate, open. cases: id, expected_id (null: must abstain); results: id, found_id."""
    joined = cases.join(results.hint("merge"), "id", "left").select((F.col("expected_id").eqNullSafe(F.col("found_id"))).alias("ok"))
    return joined.agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("double")).alias("pass_rate")).withColumn("open", F.col("pass_rate") >= 1.0)
