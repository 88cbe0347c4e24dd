"""From hits to answers: confidence, evidence, prompt, answer, citations and outcome, for all requests at once."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Fixed values.
LEAST_SCORE, MAX_EVIDENCE, PER_DOCUMENT = 0.2, 6, 3
#: Seconds that a generator has for an answer.
DEADLINE = 8.0


def retrieval_scores(hits: DataFrame) -> DataFrame:
    """(request_id, retrieval_score, n_hits) over supported hits: the best of term coverage and dense score, at most 1."""
    coverage = F.when(F.col("n_terms") > 0, F.size("matched_terms") / F.col("n_terms")).otherwise(F.lit(0.0))
    return hits.where("supported").groupBy("request_id").agg(F.least(F.lit(1.0), F.max(F.greatest(coverage, F.col("dense_score"), F.lit(0.0)))).alias("retrieval_score"), F.count("*").alias("n_hits"))


def outcomes(requests: DataFrame, hits: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(request_id, outcome, retrieval_score, n_hits); outcome is found or no_evidence."""
    scores = retrieval_scores(hits)
    score = F.coalesce("retrieval_score", F.lit(0.0))
    return requests.select("request_id").join(scores, "request_id", "left").select("request_id", F.when(F.col("retrieval_score") >= least, "found").otherwise("no_evidence").alias("outcome"), score.alias("retrieval_score"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"))


def evidence(hits: DataFrame, limit: int = MAX_EVIDENCE, per_document: int = PER_DOCUMENT) -> DataFrame:
    """Supported hits that are chosen: request_id, position, chunk_id, document_id, source_id, text.

    In rank order, texts seen before are skipped, then chunks of documents with enough of them, until
    `limit`. What is skipped for its document is not remembered as seen, so this is a fold over a
    request's ranked hits (top_k at most), not two window filters.
    """
    item = F.struct("rank", "chunk_id", "document_id", "source_id", "text", T.collapse(F.col("text")).alias("seen"))
    ranked = hits.where("supported").groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    kind = ranked.schema["ranked"].dataType.simpleString()

    def step(chosen: Column, hit: Column) -> Column:
        known = F.exists(chosen, lambda c: c["seen"] == hit["seen"])
        full = F.size(F.filter(chosen, lambda c: c["document_id"] == hit["document_id"])) >= per_document
        return F.when((F.size(chosen) >= limit) | known | full, chosen).otherwise(F.concat(chosen, F.array(hit)))

    chosen = F.aggregate("ranked", F.array().cast(kind), step)
    return ranked.select("request_id", F.posexplode(chosen).alias("position", "c")).select("request_id", (F.col("position") + 1).alias("position"), "c.chunk_id", "c.document_id", "c.source_id", "c.text")


def in_order(parts: DataFrame, line: Column, joint: str) -> DataFrame:
    """(request_id, joined): a line for each row of a request in order of position."""
    return parts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("x")).select("request_id", F.array_join(F.transform("x", lambda v: v["line"]), joint).alias("joined"))


def prompts(requests: DataFrame, chosen: DataFrame, reference: Column | None = None) -> DataFrame:
    """(request_id, prompt): instruction, question and evidence blocks."""
    where = F.col("chunk_id") if reference is None else reference
    block = F.concat(F.lit("[chunk_id: "), F.col("chunk_id"), F.lit("]\nsource: "), F.col("source_id"), F.lit("\nlocation: "), where, F.lit("\n"), F.col("text"))
    return requests.select("request_id", "query").join(in_order(chosen, block, "\n\n---\n\n"), "request_id").select("request_id", F.concat(F.lit(T.INSTRUCTION + "\n\nQUESTION: "), F.col("query"), F.lit("\n\nEVIDENCE:\n"), F.col("joined")).alias("prompt"))


def answers(chosen: DataFrame) -> DataFrame:
    """(request_id, answer): the deterministic generator, a bullet for each piece of evidence."""
    bullet = F.concat(F.lit("- "), F.col("document_id"), F.lit(": "), T.snippet(F.col("text")), F.lit(" ["), F.col("chunk_id"), F.lit("]"))
    return in_order(chosen, bullet, "\n").select("request_id", F.concat(F.lit("Evidence from the indexed sources:\n"), F.col("joined")).alias("answer"))


def _within(seconds: float, call: Callable[[str], str], prompt: str) -> tuple[str | None, str | None]:
    """The answer, or why there is none. A call that takes longer is left to end by itself."""
    got: list[tuple[str | None, str | None]] = []

    def work() -> None:
        try:
            answer = call(prompt)
            got.append((answer, None) if isinstance(answer, str) and answer.strip() else (None, "generator_failed"))
        except Exception:  # whatever a generator raises is one request's outcome
            got.append((None, "generator_failed"))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    return got[0] if got else (None, "generator_timeout")


def generated(asked: DataFrame, generate: Callable[[str], str], deadline: float = DEADLINE) -> DataFrame:
    """(request_id, answer, failure) of prompts (request_id, prompt): generate runs on the executors, with a deadline in seconds for each prompt.

    failure is null, generator_timeout or generator_failed (an exception, or no text); then there is no answer.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, *_within(deadline, generate, p)) for r, p in zip(f["request_id"], f["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=["request_id", "answer", "failure"])

    return asked.select("request_id", "prompt").mapInPandas(run, "request_id string, answer string, failure string")


def grounding(cited: Column, allowed: Column) -> Column:
    """ok, no_citation or unknown_citation."""
    return F.when(F.size(cited) == 0, "no_citation").when(F.size(F.array_except(cited, allowed)) > 0, "unknown_citation").otherwise("ok")


def validated(answered: DataFrame, chosen: DataFrame, pattern: str = T.CITATION_PATTERN) -> DataFrame:
    """Answers with the ids they cite and whether evidence backs them."""
    allowed = chosen.groupBy("request_id").agg(F.collect_set("chunk_id").alias("allowed"))
    joined = answered.withColumn("cited", T.citations(F.col("answer"), pattern)).join(allowed, "request_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    abstained = F.trim("answer") == T.ABSTENTION
    return joined.withColumn("outcome", F.when(abstained, "no_evidence").otherwise(grounding(F.col("cited"), F.col("allowed")))).drop("allowed")


def citations(checked: DataFrame, chosen: DataFrame, versions: DataFrame) -> DataFrame:
    """Cited evidence in order with its active version: request_id, position, chunk_id, document_id, content_hash, backed.

    A cited chunk without an active version is a row that is not backed.
    """
    cited = checked.where("outcome = 'ok'").select("request_id", F.explode("cited").alias("chunk_id"))
    rows = chosen.join(cited, ["request_id", "chunk_id"], "left_semi")
    return rows.join(versions.select("document_id", "content_hash"), "document_id", "left").select("request_id", "position", "chunk_id", "document_id", "content_hash", F.col("content_hash").isNotNull().alias("backed"))


def respond(requests: DataFrame, hits: DataFrame, generate: Callable[[str], str] | None = None, deadline: float = DEADLINE) -> DataFrame:
    """The whole of answering: request_id, outcome, answer, cited, retrieval_score. generate: a function from prompts to answers, else the deterministic one."""
    decided = outcomes(requests, hits)
    chosen = evidence(hits.join(decided.where("outcome = 'found'").select("request_id"), "request_id", "left_semi"))
    if generate is None:
        answered = answers(chosen).withColumn("failure", F.lit(None).cast("string"))
    else:
        answered = generated(prompts(requests, chosen), generate, deadline)
    checked = validated(answered, chosen).withColumnRenamed("outcome", "grounded")
    given = F.coalesce("failure", F.when(F.col("grounded") == "ok", "answered").otherwise(F.col("grounded")))
    return decided.join(checked, "request_id", "left").select("request_id", F.when(F.col("outcome") == "found", given).otherwise("no_evidence").alias("outcome"), "answer", F.coalesce("cited", F.array().cast("array<string>")).alias("cited"), "retrieval_score")
