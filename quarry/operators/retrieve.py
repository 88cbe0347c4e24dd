"""Retrieval for a DataFrame of requests: access first, then lexical and dense ranking, then fusion.

requests: request_id, query, grants, source_ids, top_k, and vector for dense ranking.
chunks: chunk_id, document_id, source_id, acl_labels, text, and embedding (may be null).

What requests may read is decided between two small tables: the distinct scopes of the requests
(grants and sources) and the access classes of the chunks (labels and source). Corpus statistics are
aggregated by class and summed by scope, so no request is ever paired with every chunk for them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions import access as A
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.functions.columns import computed
from quarry.plans.shared import written

# Fixed values of the ranking formulas.
K1, B, FUSION_K, DENSE_FLOOR, TRIGRAM_FLOOR = 1.2, 0.75, 60, 0.15, 0.3
POOL_FACTOR, POOL_LEAST = 5, 25
DENSITY = 0.1
#: Decimals to which scores are compared: sums of floats differ in the last bits with their order.
PLACES = 9


def scoped(requests: DataFrame) -> DataFrame:
    """Requests with their scope; those without grants are gone, they read nothing."""
    scope = F.concat_ws("|", F.array_join(F.array_sort("grants"), ","), F.array_join(F.array_sort("source_ids"), ","))
    return requests.where(F.size("grants") > 0).withColumn("scope", scope)


def classed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("access", A.access_class(F.col("acl_labels"), F.col("source_id")))


def readable_classes(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(scope, access): an equi-join of grants and labels, over distinct scopes and classes."""
    wanted = scoped(requests).select("scope", "grants", "source_ids").dropDuplicates(["scope"]).select("scope", "source_ids", F.explode("grants").alias("label"))
    there = classed(chunks).select("access", "source_id", "acl_labels").dropDuplicates(["access"]).select("access", "source_id", F.explode("acl_labels").alias("label"))
    return wanted.join(there, "label").where(A.in_sources(F.col("source_id"), F.col("source_ids"))).select("scope", "access").distinct()


def readable(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, chunk_id) of everything that may be read."""
    return scoped(requests).select("request_id", "scope").join(readable_classes(requests, chunks), "scope").join(classed(chunks).select("chunk_id", "access"), "access").select("request_id", "chunk_id")


def query_terms(requests: DataFrame) -> DataFrame:
    return scoped(requests).select("request_id", "scope", F.explode(F.array_distinct(T.analyze(F.col("query")))).alias("term"))


def analysed(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """(chunk_id, access, length, terms) of chunks; what is analysed already stays as it is."""
    if {"access", "length", "terms"} <= set(chunks.columns):
        return chunks
    rows = classed(chunks).select("chunk_id", "access", T.analyze(F.col("text") if text is None else text).alias("terms"))
    return rows.select("chunk_id", "access", F.greatest(F.lit(1), F.size("terms")).alias("length"), "terms")


def term_counts(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """(chunk_id, access, length, term, tf): the postings."""
    rows = analysed(chunks, text).select("chunk_id", "access", "length", F.explode("terms").alias("term"))
    return rows.groupBy("chunk_id", "access", "length", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(requests: DataFrame, chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(scope, n, average_length) over what each scope may read. terms: the chunks analysed."""
    by_class = (analysed(chunks) if terms is None else terms).groupBy("access").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    return readable_classes(requests, chunks).join(by_class, "access").groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("average_length"))


def postings(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """Of analysed chunks, the postings of the requests' terms."""
    return term_counts(terms).join(query_terms(requests).select("term").distinct(), "term", "left_semi")


def document_frequencies(requests: DataFrame, chunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(scope, term, df) of the requests' terms over what each scope may read. hits: their postings."""
    hits = postings(requests, analysed(chunks)) if hits is None else hits
    by_class = hits.groupBy("access", "term").agg(F.count("*").alias("df"))
    found = by_class.join(readable_classes(requests, chunks), "access").groupBy("scope", "term").agg(F.sum("df").alias("df"))
    return found.join(query_terms(requests).select("scope", "term").distinct(), ["scope", "term"], "left_semi")


def bm25(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, chunk_id, lexical_score) of every readable chunk with a positive score.

    Texts are analysed once: the analysed chunks are written, and the postings of the requests' terms.
    """
    analysis = written(analysed(chunks), "analysed")
    hits = written(postings(requests, analysis), "postings")
    classes = written(readable_classes(requests, chunks), "classes")
    paired = hits.join(query_terms(requests), "term").join(classes, ["scope", "access"], "left_semi")
    stats = corpus_statistics(requests, chunks, analysis)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average_length")))
    return (
        paired.join(document_frequencies(requests, chunks, hits), ["scope", "term"])
        .join(F.broadcast(stats), "scope")  # a row for each scope
        .groupBy("request_id", "chunk_id")
        .agg(F.sum(idf * share).alias("lexical_score"))
        .where("lexical_score > 0")
    )


def dense(requests: DataFrame, chunks: DataFrame, floor: float = DENSE_FLOOR) -> DataFrame:
    """(request_id, chunk_id, dense_score) of readable chunks with a vector that is similar enough."""
    asked = scoped(requests).where(F.col("vector").isNotNull()).select("request_id", "scope", "vector")
    open_ = asked.join(readable_classes(requests, chunks), "scope").select("request_id", "vector", "access")
    vectors = classed(chunks).where(F.col("embedding").isNotNull()).select("chunk_id", "access", "embedding")
    scored = computed(vectors.join(open_, "access").select("request_id", "chunk_id", "vector", "embedding"), dense_score=V.dot(F.col("vector"), F.col("embedding")))
    return scored.select("request_id", "chunk_id", "dense_score").where(F.col("dense_score") >= floor)


def by_score(score: str) -> Window:
    return Window.partitionBy("request_id").orderBy(F.round(score, PLACES).desc(), "chunk_id")


def top(scores: DataFrame, score: str, limit: Column, rank: str) -> DataFrame:
    """The best rows of each request; tasks keep only that many of theirs before the shuffle."""
    return scores.withColumn(rank, F.row_number().over(by_score(score))).where(F.col(rank) <= limit)


def pool(top_k: Column) -> Column:
    return F.greatest(top_k * POOL_FACTOR, F.lit(POOL_LEAST))


def bm25_top(requests: DataFrame, chunks: DataFrame, most: int = 50) -> DataFrame:
    limits = requests.select("request_id", "top_k")
    best = top(bm25(requests, chunks), "lexical_score", F.lit(most), "lexical_rank")
    return best.join(limits, "request_id").where("lexical_rank <= top_k").drop("top_k")


def dense_top(requests: DataFrame, chunks: DataFrame, floor: float = DENSE_FLOOR) -> DataFrame:
    limits = requests.select("request_id", "top_k")
    return top(dense(requests, chunks, floor).join(limits, "request_id"), "dense_score", pool(F.col("top_k")), "dense_rank").drop("top_k")


def hybrid(requests: DataFrame, chunks: DataFrame, most: int = 50) -> DataFrame:
    """Reciprocal rank fusion: request_id, chunk_id, score, ranks and scores of both branches, rank.

    Lexical ranks count all readable hits. They are needed for the best of the lexical branch and for the
    dense pool only: the former come from a top list, the latter from counting the hits ahead, so no
    request's hits are ever sorted in one task. Both branches are used several times: they are written once.
    """
    lexical = written(bm25(requests, chunks), "lexical")
    near = written(dense_top(requests, chunks), "dense")
    best = top(lexical, "lexical_score", F.lit(most), "lexical_rank")
    both = lexical.join(near.select("request_id", "chunk_id"), ["request_id", "chunk_id"])
    mine = both.select("request_id", F.col("chunk_id").alias("own_id"), F.round("lexical_score", PLACES).alias("own"))
    other = F.round("lexical_score", PLACES)
    ahead = (other > F.col("own")) | ((other == F.col("own")) & (F.col("chunk_id") <= F.col("own_id")))
    counted = lexical.join(mine, "request_id").groupBy("request_id", "own_id").agg(F.count_if(ahead).cast("int").alias("lexical_rank"))
    ranked = counted.withColumnRenamed("own_id", "chunk_id").join(both, ["request_id", "chunk_id"])
    lexical_side = best.unionByName(ranked.select(best.columns)).dropDuplicates(["request_id", "chunk_id"])
    joined = lexical_side.join(near, ["request_id", "chunk_id"], "full_outer")
    part = lambda rank: F.coalesce(F.expr(f"1D / ({FUSION_K} + {rank})"), F.lit(0.0))
    scored = joined.select(
        "request_id", "chunk_id", (part("lexical_rank") + part("dense_rank")).alias("score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), "lexical_rank", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), "dense_rank"
    )
    return top(scored.join(requests.select("request_id", "top_k"), "request_id"), "score", F.col("top_k"), "rank").drop("top_k")


def with_terms(hits: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's columns, matched_terms, n_terms (of the query) and supported: wide rows are joined after the ranking."""
    asked = requests.select("request_id", F.array_distinct(T.analyze(F.col("query"))).alias("asked"))
    wide = hits.join(chunks.select("chunk_id", "document_id", "source_id", "text"), "chunk_id").join(asked, "request_id")
    matched = F.array_sort(F.array_intersect("asked", T.analyze(F.col("text"))))
    return wide.withColumn("matched_terms", matched).withColumn("n_terms", F.size("asked")).drop("asked").withColumn("supported", (F.size("matched_terms") > 0) | F.col("dense_rank").isNotNull())


# ---- web-search syntax and trigrams ----


def clauses(query: Column) -> Column:
    """A query as clauses that must all hold: (negated, alternatives), an alternative being a term or a quoted phrase.

    Terms are and-ed, `or` joins its neighbours, a hyphen in front negates. Parts without terms are left out.
    """
    words = F.regexp_extract_all(F.lower(query), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    empty = F.lit([]).cast("array<struct<negated:boolean,alternatives:array<string>>>")
    start = F.struct(empty.alias("done"), F.lit(False).alias("either"))

    def step(state: Column, word: Column) -> Column:
        terms = F.array_join(T.analyze(word), " ")
        done, size = state["done"], F.size(state["done"])
        last = F.get(done, size - 1)
        more = F.array(F.struct(word.startswith("-").alias("negated"), F.array(terms).alias("alternatives")))
        joined = F.concat(F.slice(done, 1, F.greatest(size - 1, F.lit(0))), F.array(F.struct(last["negated"].alias("negated"), F.concat(last["alternatives"], F.array(terms)).alias("alternatives"))))
        after = F.when(terms == "", done).when(state["either"] & (size > 0), joined).otherwise(F.concat(done, more))
        return F.when(word == "or", F.struct(done.alias("done"), F.lit(True).alias("either"))).otherwise(F.struct(after.alias("done"), F.lit(False).alias("either")))

    return F.aggregate(words, start, step, lambda s: s["done"])


def full_text(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, chunk_id) of readable chunks in which all clauses hold.

    Candidates come from an equi-join on the first words of one positive clause's alternatives, the clause whose words are in the
    fewest chunks; all clauses are tested on them. Queries without a positive clause match nothing. Texts are analysed once.
    """
    parsed = scoped(requests).select("request_id", "scope", clauses(F.col("query")).alias("clauses"))
    positive = parsed.select("request_id", "scope", F.posexplode(F.filter("clauses", lambda c: ~c["negated"])).alias("clause", "c"))
    keys = positive.select("request_id", "scope", "clause", F.explode("c.alternatives").alias("a")).select("request_id", "scope", "clause", F.substring_index("a", " ", 1).alias("term")).distinct()
    analysis = written(analysed(chunks), "analysed")
    hits = analysis.select("chunk_id", "access", F.explode(F.array_distinct("terms")).alias("term"))
    hits = written(hits.join(keys.select("term").distinct(), "term", "left_semi"), "postings")
    often = keys.join(hits.groupBy("term").agg(F.count("*").alias("n")), "term", "left").groupBy("request_id", "clause").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = often.groupBy("request_id").agg(F.min(F.struct("n", "clause")).alias("least")).select("request_id", "least.clause")
    found = hits.join(keys.join(rarest, ["request_id", "clause"], "left_semi"), "term").join(readable_classes(requests, chunks), ["scope", "access"], "left_semi").select("request_id", "chunk_id").distinct()
    lines = analysis.select("chunk_id", F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" ")).alias("line"))
    there = lambda a: F.contains(F.col("line"), F.concat(F.lit(" "), a, F.lit(" ")))
    holds = F.forall("clauses", lambda c: F.exists(c["alternatives"], there) != c["negated"])
    return found.join(lines, "chunk_id").join(parsed.drop("scope"), "request_id").where(holds).select("request_id", "chunk_id")


@F.pandas_udf(DoubleType())
def cover_density(asked: pd.Series, terms: pd.Series) -> pd.Series:
    """Of (alternatives of each clause, terms of a text): the sum of DENSITY / (1 + other terms inside) over the covers.

    A cover is a stretch that has an alternative of each clause and no shorter one inside. One pass over the terms.
    """

    def one(groups, words) -> float:
        words = list(words)
        phrases = [[str(a).split(" ") for a in g] for g in groups]
        known = {w for g in phrases for p in g for w in p}
        last, before, total, newest = [-1] * len(phrases), [0], 0.0, -1
        for end, word in enumerate(words):
            before.append(before[-1] + (word in known))
            if word not in known:
                continue
            for c, g in enumerate(phrases):
                last[c] = max([last[c], *(end + 1 - len(p) for p in g if word == p[-1] and words[max(0, end + 1 - len(p)) : end + 1] == p)])
            start = min(last, default=-1)
            if start > newest:
                newest = start
                total += DENSITY / (1 + (end + 1 - start) - (before[end + 1] - before[start]))
        return total

    return pd.Series([one(a, t) for a, t in zip(asked, terms, strict=True)], dtype="float64")


def density_top(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, chunk_id, score, rank): full-text hits by cover density, as many of each request as its pool has; ties by chunk_id."""
    own = F.transform(F.filter(clauses(F.col("query")), lambda c: ~c["negated"]), lambda c: c["alternatives"])
    asked = requests.select("request_id", "top_k", own.alias("own"))
    pairs = full_text(requests, chunks).join(asked, "request_id").join(analysed(chunks).select("chunk_id", "terms"), "chunk_id")
    return top(pairs.withColumn("score", cover_density("own", "terms")), "score", pool(F.col("top_k")), "rank").select("request_id", "chunk_id", "score", "rank")


def trigram_hits(requests: DataFrame, chunks: DataFrame, floor: float = TRIGRAM_FLOOR) -> DataFrame:
    """(request_id, chunk_id, score) of readable chunks by the trigrams they share.

    Each distinct text is compared once, under its digest. A request meets texts on its rarest trigrams only: as many of its
    most frequent ones are spared as could not reach the score alone. Pairs that could reach it with all the spared ones,
    few as a rule, are then compared in full, so the result is exact.
    """
    asked = scoped(requests).select("request_id", "scope", T.trigrams(F.col("query")).alias("own"))
    rows = classed(chunks).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = written(rows.dropDuplicates(["access", "digest"]).select("access", "digest", T.trigrams(F.col("text")).alias("grams")), "grams")
    there = texts.select("access", "digest", F.size("grams").alias("n_there"), F.explode("grams").alias("gram"))
    each = asked.select("request_id", "scope", F.size("own").alias("n_asked"), F.explode("own").alias("gram"))
    often = there.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    # a score of floor takes floor * n_asked shared ones; far less than one is left for rounding
    spared = F.greatest(F.lit(0), (F.ceil(F.lit(floor) * F.col("n_asked") - 1e-9) - 1).cast("int"))
    ordered = each.join(often, "gram").groupBy("request_id", "scope", "n_asked").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("known"))
    rare = ordered.withColumn("spared", F.least(spared, F.size("known"))).withColumn("g", F.explode(F.slice("known", 1, F.size("known") - F.col("spared")))).select("request_id", "scope", "n_asked", "spared", "g.gram")
    fits = F.least("n_asked", "n_there") / F.greatest("n_asked", "n_there") >= floor  # the score is this at most
    met = there.join(rare, "gram").where(fits).join(readable_classes(requests, chunks), ["scope", "access"], "left_semi").groupBy("request_id", "access", "digest", "n_asked", "n_there", "spared").agg(F.count("*").alias("n"))
    score = lambda n: n / (F.col("n_asked") + F.col("n_there") - n)
    hopeful = met.where(score(F.least(F.col("n") + F.col("spared"), "n_asked", "n_there")) >= floor).drop("n", "spared")
    exact = computed(hopeful.join(texts, ["access", "digest"]).join(asked.drop("scope"), "request_id"), n=F.size(F.array_intersect("own", "grams")))
    near = exact.select("request_id", "access", "digest", score(F.col("n")).alias("score")).where(F.col("score") >= floor)
    return rows.select("access", "digest", "chunk_id").join(near, ["access", "digest"]).select("request_id", "chunk_id", "score")


#: Most requests whose ids are sent to every executor; beyond it their join shuffles.
BROADCAST_REQUESTS = 200_000
#: Copies of a text that are listed together, and rows that are listed by a task, about.
COPIES, LISTED = 256, 4_000_000


def lexical_with_fallback(requests: DataFrame, chunks: DataFrame, places: int | None = None) -> DataFrame:
    """Full-text hits, and trigram hits of the requests that have none: request_id, chunk_id, score (to that many places), mode.

    Equal queries of a scope are asked once, and of equal texts of an access class one; pairs of those, with their scores, are
    written. What is left is to list them for each copy: chunks first, then requests, so that the whole result is never shuffled
    while the requests' ids are few enough to be broadcast. The listing makes many rows of few, so its tasks follow the rows that
    are due, not the bytes read: copies are dealt out in blocks of a text, and each pair goes to all blocks of its text.
    """
    asked = scoped(requests).select("request_id", "query", "grants", "source_ids", "scope")
    rows = classed(chunks).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    questions = written(asked.dropDuplicates(["scope", "query"]).withColumn("request_id", F.expr("uuid()")), "questions")
    alone = rows.groupBy("access", "digest").agg(*(F.first(c).alias(c) for c in ("source_id", "acl_labels", "text")), F.count("*").alias("copies"))
    kinds = written(alone.withColumn("chunk_id", F.expr("uuid()")), "texts")
    texts = kinds.drop("copies")
    exact = written(full_text(questions, texts), "full-text")
    open_ = written(questions.join(exact.select("request_id").distinct(), "request_id", "left_anti"), "unanswered")
    found = exact.select("request_id", "chunk_id", F.lit(1.0).alias("score"), F.lit("full_text").alias("mode")).unionByName(trigram_hits(open_, texts).withColumn("mode", F.lit("trigram")))
    score = F.col("score") if places is None else F.round("score", places)
    pairs = written(found.select(F.col("request_id").alias("question"), F.col("chunk_id").alias("of_text"), score.alias("score"), "mode"), "pairs")
    asking = written(asked.select("request_id", "scope", "query").join(questions.select("scope", "query", F.col("request_id").alias("question")), ["scope", "query"]).select("question", "request_id"), "asking")
    sizes = kinds.select(F.col("chunk_id").alias("of_text"), "access", "digest", "copies", F.ceil(F.col("copies") / COPIES).alias("blocks"))
    sized = pairs.join(sizes.select("of_text", "copies", "blocks"), "of_text")
    due = sized.join(asking.groupBy("question").agg(F.count("*").alias("asked")), "question").agg(F.sum(F.col("copies") * F.col("asked"))).first()[0] or 0
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, -(-due // LISTED))
    block = F.pmod(F.xxhash64("chunk_id"), F.col("blocks"))
    copies = rows.select("chunk_id", "access", "digest").join(sizes, ["access", "digest"]).select("of_text", block.alias("block"), "chunk_id")
    dealt = sized.select("question", "of_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "score", "mode")
    key = ["of_text", "block"]
    listed = dealt.repartition(tasks, *key).hint("merge").join(copies.repartition(tasks, *key), key)
    if asking.count() <= BROADCAST_REQUESTS:
        asking = F.broadcast(asking)
    return listed.join(asking, "question").select("request_id", "chunk_id", "score", "mode")
