"""How the given tables stand in for a corpus, its readers and its index, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import access as A
from quarry.functions.text import STOP_WORDS, TERM_PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: one chunk each, labels by the number of the source, vectors where there are any."""
    n = F.substring("source", 4, 10).cast("long")
    chunk_id = F.concat_ws(":", "source", "doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", chunk_id.alias("chunk_id"), chunk_id.alias("document_id"), F.col("source").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), "lang",
        A.acl_labels(F.col("source"), F.concat(F.lit("u"), (n % 3).cast("string")), F.when(n % 5 == 0, "public").when(n % 5 == 1, "shared").otherwise("private")).alias("acl_labels"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a request; who asks goes by its number, its vector is the one of that number."""
    kind = F.col("item_id") % 4
    none = F.array().cast("array<string>")
    grants = F.when(kind == 1, F.array(F.lit("owner:u1"), F.lit("public"))).when(kind == 2, none).otherwise(F.array(F.lit("owner:u0"), F.lit("public")))
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("request_id"), F.col("text").alias("query"), grants.alias("grants"),
        F.when(kind == 3, F.array(F.lit("src0"), F.lit("src3"))).otherwise(none).alias("source_ids"), F.lit(8).alias("top_k"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "item_id", "left")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog with two fitments each."""
    year = F.col("p_size") + 1970
    make = F.replace("p_brand", F.lit("#"), F.lit(""))  # one token
    fit = lambda a, b: F.concat(make, F.lit(" "), F.col("p_type"), F.lit(" "), (year + a).cast("string"), F.lit("-"), (year + b).cast("string"))
    rows = table(spark, sf_dir, "part")
    return rows.select(
        F.concat(F.lit("PRT-"), F.col("p_partkey").cast("string")).alias("part_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        F.array(fit(0, 6), F.concat(fit(4, 9), F.lit(" sport"))).alias("compatible_with"), F.concat(F.lit("supplier-"), (F.col("p_partkey") % 7).cast("string")).alias("source_id"),
        F.concat(F.lit("2026-"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0")).alias("catalog_version"), (F.col("p_partkey") % 13 == 5).alias("deleted"),
    )


def part_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every part whose number is divisible by 20."""
    rows = table(spark, sf_dir, "part").where("p_partkey % 20 = 0")
    year = (F.col("p_size") + 1970 + F.col("p_partkey") % 3 * 5).cast("string")
    make = F.replace("p_brand", F.lit("#"), F.lit(""))
    asked = F.concat(F.lit("Which "), F.col("p_name"), F.lit(" fits "), make, F.lit(" "), F.col("p_type"), F.lit(" "), year, F.lit("?"))
    by_id = F.concat(F.lit("Does PRT-"), F.col("p_partkey").cast("string"), F.lit(" fit "), make, F.lit(" "), year, F.lit("?"))
    return rows.select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("request_id"), F.when(F.col("p_partkey") % 60 == 0, by_id).otherwise(asked).alias("query"))


# ---- the same as common table expressions ----

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{TERM_PATTERN}'), lambda t: len(t) > 1 AND NOT list_contains([{_STOP}], t))"


CTES = {
    "docs": "SELECT doc_id, coalesce(text, '') AS text, source, lang, CAST(substr(source, 4) AS BIGINT) AS n, source || ':' || doc_id AS chunk_id FROM documents",
    "corpus": f"SELECT *, list_concat(['source:' || source, 'owner:u' || (n % 3)], CASE WHEN n % 5 = 0 THEN ['public'] WHEN n % 5 = 1 THEN ['shared:' || source] ELSE [] END) AS acl, {terms_sql('text')} AS terms FROM docs",
    "reqs": f"""SELECT item_id, 'r' || item_id AS request_id, text AS query, CASE item_id % 4 WHEN 1 THEN ['owner:u1', 'public'] WHEN 2 THEN [] ELSE ['owner:u0', 'public'] END AS grants,
        CASE WHEN item_id % 4 = 3 THEN ['src0', 'src3'] ELSE [] END AS source_ids, list_distinct({terms_sql('text')}) AS asked FROM benchmark""",
    "readable": "SELECT r.request_id, c.chunk_id FROM reqs r JOIN corpus c ON list_has_any(c.acl, r.grants) AND (len(r.source_ids) = 0 OR list_contains(r.source_ids, c.source))",
    "tf": "SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT chunk_id, greatest(1, len(terms)) AS length, unnest(terms) AS term FROM corpus) GROUP BY chunk_id, term",
    "asked": "SELECT request_id, unnest(asked) AS term FROM reqs",
    # covers of the two least terms of a request
    "pairs": "SELECT request_id, chunk_id, list_slice(list_sort(asked), 1, 2) AS two, terms FROM reqs JOIN readable USING (request_id) JOIN corpus USING (chunk_id) WHERE len(asked) > 0 AND list_has_all(terms, list_slice(list_sort(asked), 1, 2))",
    "places": "SELECT request_id, chunk_id, pos, term, len(two) AS n_two, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY pos) AS k FROM (SELECT request_id, chunk_id, two, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM pairs) WHERE list_contains(two, term)",
    "ends": "SELECT a.request_id, a.chunk_id, a.pos AS e, a.k AS ke, any_value(a.n_two) AS n_two, b.term, max(b.pos) AS p, max(b.k) AS kp FROM places a JOIN places b ON a.request_id = b.request_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY a.request_id, a.chunk_id, a.pos, a.k, b.term",
    "covers": "SELECT request_id, chunk_id, e, min(p) AS s, ke - min(kp) + 1 AS n FROM ends GROUP BY request_id, chunk_id, e, ke HAVING count(*) = any_value(n_two)",
    "minimal": "SELECT request_id, chunk_id, s, min(e) AS e, arg_min(n, e) AS n FROM covers GROUP BY request_id, chunk_id, s",
    "stats": "SELECT request_id, count(*) AS n, avg(greatest(1, len(terms))) AS average_length FROM readable JOIN corpus USING (chunk_id) GROUP BY request_id",
    "df": "SELECT request_id, term, count(*) AS df FROM readable JOIN tf USING (chunk_id) JOIN asked USING (request_id, term) GROUP BY request_id, term",
    "bm25": """SELECT request_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average_length))) AS lexical_score
        FROM readable JOIN tf USING (chunk_id) JOIN df USING (request_id, term) JOIN stats USING (request_id) GROUP BY request_id, chunk_id""",
    "lexical": "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(lexical_score, 9) DESC, chunk_id) AS lexical_rank FROM bm25 WHERE lexical_score > 0",
    "near": """SELECT r.request_id, c.chunk_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dense_score
        FROM readable JOIN reqs r USING (request_id) JOIN corpus c USING (chunk_id) JOIN embeddings q ON q.vec_id = r.item_id JOIN embeddings e ON e.vec_id = c.doc_id""",
    "dense": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(dense_score, 9) DESC, chunk_id) AS dense_rank FROM near WHERE dense_score >= 0.15) WHERE dense_rank <= 40",
    "fused": """SELECT coalesce(l.request_id, d.request_id) AS request_id, coalesce(l.chunk_id, d.chunk_id) AS chunk_id,
        coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS score,
        coalesce(lexical_score, 0) AS lexical_score, lexical_rank, coalesce(dense_score, 0) AS dense_score, dense_rank
        FROM lexical l FULL OUTER JOIN dense d ON l.request_id = d.request_id AND l.chunk_id = d.chunk_id""",
    "hits": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) WHERE rank <= 8",
    "wide": """SELECT h.*, c.source, c.text, list_sort(list_filter(r.asked, lambda t: list_contains(c.terms, t))) AS matched, len(r.asked) AS n_terms FROM hits h JOIN corpus c USING (chunk_id) JOIN reqs r USING (request_id)""",
    "confidence": "SELECT request_id, least(1.0, max(greatest(CASE WHEN n_terms > 0 THEN len(matched) / n_terms ELSE 0 END, dense_score, 0))) AS retrieval_score, count(*) AS n_hits FROM wide WHERE len(matched) > 0 OR dense_rank IS NOT NULL GROUP BY request_id",
    # the fold over ranked hits that chooses evidence; a source counts as a document
    "ordered": "SELECT request_id, source, chunk_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS seen, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS k FROM wide WHERE len(matched) > 0 OR dense_rank IS NOT NULL",
    "fold": """SELECT request_id, 0::BIGINT AS k, []::VARCHAR[] AS ids, []::VARCHAR[] AS texts, []::VARCHAR[] AS owners FROM ordered WHERE k = 1
        UNION ALL SELECT f.request_id, o.k,
          CASE WHEN len(f.ids) < 6 AND NOT list_contains(f.texts, o.seen) AND len(list_filter(f.owners, lambda s: s = o.source)) < 3 THEN list_append(f.ids, o.chunk_id) ELSE f.ids END,
          CASE WHEN len(f.ids) < 6 AND NOT list_contains(f.texts, o.seen) AND len(list_filter(f.owners, lambda s: s = o.source)) < 3 THEN list_append(f.texts, o.seen) ELSE f.texts END,
          CASE WHEN len(f.ids) < 6 AND NOT list_contains(f.texts, o.seen) AND len(list_filter(f.owners, lambda s: s = o.source)) < 3 THEN list_append(f.owners, o.source) ELSE f.owners END
        FROM fold f JOIN ordered o ON o.request_id = f.request_id AND o.k = f.k + 1""",
    "last": "SELECT request_id, arg_max(ids, k) AS ids FROM fold GROUP BY request_id",
    "chosen": "SELECT request_id, position, ids[position] AS chunk_id FROM (SELECT request_id, ids, unnest(range(1, len(ids) + 1)) AS position FROM last)",
    # runs and stagings out of events: 50 events are a run, users are documents
    "staged": "SELECT event_id // 50 AS run, user_id AS document_id, arg_max(event_type, event_id) AS content, count(*) AS n FROM events GROUP BY 1, 2",
    "runs": "SELECT DISTINCT event_id // 50 AS run, CASE WHEN (event_id // 50) % 7 = 3 THEN 'discarded' WHEN (event_id // 50) % 11 = 5 THEN 'candidate' ELSE 'activated' END AS status FROM events",
    "newest": "SELECT document_id, arg_max(content, run) AS content, max(run) AS run FROM staged JOIN runs USING (run) WHERE status = 'activated' GROUP BY document_id",
    "parts": """SELECT p_partkey, 'PRT-' || p_partkey AS part_id, p_name AS name, p_type AS description, [replace(p_brand, '#', '') || ' ' || p_type || ' ' || (p_size + 1970) || '-' || (p_size + 1976), replace(p_brand, '#', '') || ' ' || p_type || ' ' || (p_size + 1974) || '-' || (p_size + 1979) || ' sport'] AS fits,
        'supplier-' || (p_partkey % 7) AS source_id, '2026-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') AS catalog_version FROM part WHERE p_partkey % 13 <> 5""",
    "questions": """SELECT 'q' || p_partkey AS request_id, CASE WHEN p_partkey % 60 = 0 THEN 'Does PRT-' || p_partkey || ' fit ' || replace(p_brand, '#', '') || ' ' || y || '?' ELSE 'Which ' || p_name || ' fits ' || replace(p_brand, '#', '') || ' ' || p_type || ' ' || y || '?' END AS query
        FROM (SELECT *, p_size + 1970 + p_partkey % 3 * 5 AS y FROM part WHERE p_partkey % 20 = 0)""",
}
_NEEDS = {
    "corpus": ["docs"], "readable": ["corpus", "reqs"], "tf": ["corpus"], "asked": ["reqs"], "pairs": ["readable"], "places": ["pairs"], "ends": ["places"], "covers": ["ends"], "minimal": ["covers"], "stats": ["readable"], "df": ["readable", "tf", "asked"], "bm25": ["df", "stats"], "lexical": ["bm25"],
    "near": ["readable"], "dense": ["near"], "fused": ["lexical", "dense"], "hits": ["fused"], "wide": ["hits"], "confidence": ["wide"], "ordered": ["wide"], "fold": ["ordered"], "last": ["fold"], "chosen": ["last"],
    "newest": ["staged", "runs"],
}


def with_ctes(select: str, *names: str) -> str:
    """A statement with the expressions it names and those they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    recursive = "RECURSIVE " * ("fold" in order)
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + f"\n{select}"
