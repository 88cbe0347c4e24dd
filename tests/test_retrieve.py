import math
import re
from collections import Counter

from quarry.operators import ground as G
from quarry.operators import retrieve as R
from quarry.functions import text as T
from pyspark.sql import functions as F

CHUNKS = [
    ("a:1", "d1", "a", ["source:a", "owner:me"], "apple pie recipe with apple", [1.0, 0.0]),
    ("a:2", "d1", "a", ["source:a", "owner:me"], "banana bread recipe", [0.0, 1.0]),
    ("b:1", "d2", "b", ["source:b", "owner:you"], "secret apple plan", [1.0, 0.0]),
    ("c:1", "d3", "c", ["source:c", "owner:you", "public"], "public apple notes", None),
]


def tables(spark, *asked):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, source_id string, acl_labels array<string>, text string, embedding array<double>")
    requests = spark.createDataFrame([(f"r{i}", q, g, s, 8, v) for i, (q, g, s, v) in enumerate(asked)], "request_id string, query string, grants array<string>, source_ids array<string>, top_k int, vector array<double>")
    return requests, chunks


def test_access_comes_before_ranking(spark):
    requests, chunks = tables(spark, ("apple", ["owner:me", "public"], [], [1.0, 0.0]))
    assert {r.chunk_id for r in R.hybrid(requests, chunks).collect()} == {"a:1", "c:1"}
    assert R.corpus_statistics(requests, chunks).first().n == 3


def test_no_grants_no_results_and_sources_only_narrow(spark):
    requests, chunks = tables(spark, ("apple", [], [], None), ("apple", ["owner:me"], ["b"], None), ("apple", ["owner:you"], ["b"], None))
    assert [(r.request_id, r.chunk_id) for r in R.hybrid(requests, chunks).collect()] == [("r2", "b:1")]


def test_fewer_grants_read_a_subset(spark):
    requests, chunks = tables(spark, ("apple", ["owner:me"], [], None), ("apple", ["owner:me", "public"], [], None))
    by = {}
    for r in R.readable(requests, chunks).collect():
        by.setdefault(r.request_id, set()).add(r.chunk_id)
    assert by["r0"] < by["r1"]


def test_bm25_by_hand(spark):
    requests, chunks = tables(spark, ("apple apple", ["owner:me"], [], None))
    got = {r.chunk_id: r.lexical_score for r in R.bm25(requests, chunks).collect()}
    n, df, average = 2, 1, (5 - 1 + 3) / 2  # "with" is a stop word
    expected = math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / average))
    assert got == {"a:1": got["a:1"]} and math.isclose(got["a:1"], expected)


def test_both_signals_add_up(spark):
    requests, chunks = tables(spark, ("apple", ["owner:me"], [], [1.0, 0.0]))
    hit = R.hybrid(requests, chunks).where("chunk_id = 'a:1'").first()
    assert hit.lexical_rank == hit.dense_rank == 1 and math.isclose(hit.score, 2 / 61)


def test_dense_floor(spark):
    requests, chunks = tables(spark, ("zzz", ["owner:me"], [], [1.0, 0.0]))
    assert [r.chunk_id for r in R.dense(requests, chunks).collect()] == ["a:1"]


def test_web_search_syntax(spark):
    requests, chunks = tables(spark, ('"apple pie"', ["owner:me", "public"], [], None), ("recipe -bread", ["owner:me"], [], None), ("pie or bread recipe", ["owner:me"], [], None), ("apple bread", ["owner:me"], [], None))
    got = sorted((r.request_id, r.chunk_id) for r in R.full_text(requests, chunks).collect())
    assert got == [("r0", "a:1"), ("r1", "a:1"), ("r2", "a:1"), ("r2", "a:2")]


def test_fallback_to_trigrams(spark):
    requests, chunks = tables(spark, ("bananna bread recipe", ["owner:me"], [], None), ("apple", ["owner:me"], [], None))
    assert sorted((r.request_id, r.chunk_id, r["mode"]) for r in R.lexical_with_fallback(requests, chunks).collect()) == [("r0", "a:2", "trigram"), ("r1", "a:1", "full_text")]


def test_fallback_asks_equal_queries_of_equal_texts_once(spark, monkeypatch):
    """Copies of requests and texts are listed, not searched again; scopes and access classes stay apart."""
    seen = {}
    for name in ("full_text", "trigram_hits"):
        monkeypatch.setattr(R, name, lambda requests, chunks, name=name, real=getattr(R, name): (seen.update({name: (requests.count(), chunks.count())}), real(requests, chunks))[1])
    asked = [(f"{q}{i}", q, ["public"], []) for q in ("green pear", "gren paer trees") for i in range(30)] + [("mine", "green pear", ["owner:me"], []), ("null", None, ["public"], [])]
    texts = [(f"{label}{i}", "s", [label], "green pear trees") for label, n in (("public", 40), ("owner:me", 3)) for i in range(n)] + [("none", "s", ["public"], None)]
    requests = spark.createDataFrame(asked, "request_id string, query string, grants array<string>, source_ids array<string>")
    chunks = spark.createDataFrame(texts, "chunk_id string, source_id string, acl_labels array<string>, text string")
    due = {(f"{q}{i}", f"public{j}", mode) for q, mode in (("green pear", "full_text"), ("gren paer trees", "trigram")) for i in range(30) for j in range(40)} | {("mine", f"owner:me{j}", "full_text") for j in range(3)}
    for most in (R.BROADCAST_REQUESTS, 0):  # ids broadcast or shuffled
        monkeypatch.setattr(R, "BROADCAST_REQUESTS", most)
        got = [(r.request_id, r.chunk_id, r["mode"]) for r in R.lexical_with_fallback(requests, chunks).collect()]
        assert len(got) == len(due) and set(got) == due
    assert seen == {"full_text": (4, 3), "trigram_hits": (2, 3)}


def test_listing_copies_is_dealt_out_by_rows_due(spark, monkeypatch):
    """One text in one file, asked by equal queries: blocks of its copies are listed by several tasks, each pair once."""
    monkeypatch.setattr(R, "COPIES", 16, raising=False)
    monkeypatch.setattr(R, "LISTED", 500, raising=False)
    requests = spark.createDataFrame([(f"r{i}", "gren paer trees", ["public"], []) for i in range(40)], "request_id string, query string, grants array<string>, source_ids array<string>")
    chunks = spark.createDataFrame([(f"c{j}", "s", ["public"], "green pear trees") for j in range(300)], "chunk_id string, source_id string, acl_labels array<string>, text string").coalesce(1)
    got = R.lexical_with_fallback(requests, chunks, 6).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 12_000 and {(r.request_id, r.chunk_id) for r in got} == {(f"r{i}", f"c{j}") for i in range(40) for j in range(300)}
    assert {(r.score, r["mode"]) for r in got} == {(got[0].score, "trigram")}
    assert max(Counter(r.task for r in got).values()) < 6_000


def hits(spark, rows):
    return spark.createDataFrame([("r", i + 1, c, d, "s", t, True) for i, (c, d, t) in enumerate(rows)], "request_id string, rank int, chunk_id string, document_id string, source_id string, text string, supported boolean")


def test_evidence_is_a_fold(spark):
    rows = [("1", "d", "x"), ("2", "d", "x "), ("3", "d", "y"), ("4", "d", "z"), ("5", "d", "over quota"), ("6", "e", "over quota"), ("7", "f", "w"), ("8", "g", "v")]
    got = [r.chunk_id for r in G.evidence(hits(spark, rows), limit=5).orderBy("position").collect()]
    assert got == ["1", "3", "4", "6", "7"]  # 5 is over its quota and not remembered as seen


def test_answers_cite_their_evidence(spark):
    chosen = G.evidence(hits(spark, [("s:1@ab#0001", "d", "some text")]))
    checked = G.validated(G.answers(chosen), chosen).first()
    assert checked.outcome == "ok" and checked.cited == ["s:1@ab#0001"]


def test_ungrounded_answers_fail(spark):
    chosen = G.evidence(hits(spark, [("c1", "d", "t")]))
    answers = spark.createDataFrame([("r", "made up [c9]"), ("r", "no ids"), ("r", T.ABSTENTION)], "request_id string, answer string")
    assert [r.outcome for r in G.validated(answers, chosen).collect()] == ["unknown_citation", "no_citation", "no_evidence"]


def test_abstains_below_the_threshold(spark):
    requests, chunks = tables(spark, ("quantum chromodynamics lattice apple gauge theory", ["owner:me"], [], None), ("apple pie", ["owner:me"], [], None))
    wide = R.with_terms(R.hybrid(requests, chunks), requests, chunks)
    got = {r.request_id: r.outcome for r in G.respond(requests, wide).collect()}
    assert got == {"r0": "no_evidence", "r1": "answered"}


def test_missing_version_is_not_backed(spark):
    chosen = G.evidence(hits(spark, [("c1", "d", "t"), ("c2", "e", "u")]))
    versions = spark.createDataFrame([("d", "h")], "document_id string, content_hash string")
    got = {r.chunk_id: r.backed for r in G.citations(G.validated(G.answers(chosen), chosen), chosen, versions).collect()}
    assert got == {"c1": True, "c2": False}


def test_results_do_not_depend_on_partitions(spark):
    requests, chunks = tables(spark, ("apple recipe", ["owner:me", "public"], [], [1.0, 0.0]))
    a = R.hybrid(requests, chunks.repartition(1)).orderBy("rank").collect()
    b = R.hybrid(requests, chunks.repartition(7, F.rand(1))).orderBy("rank").collect()
    assert a == b


def test_generators_have_a_deadline_and_may_fail(spark):
    def generate(prompt):
        import time

        if "slow" in prompt:
            time.sleep(5)
        if "broken" in prompt:
            raise RuntimeError("no model")
        return " " if "silent" in prompt else prompt.upper()

    asked = spark.createDataFrame([(x, x) for x in ("fine", "slow", "broken", "silent")], "request_id string, prompt string")
    got = {r.request_id: (r.answer, r.failure) for r in G.generated(asked, generate, deadline=0.5).collect()}
    assert got == {"fine": ("FINE", None), "slow": (None, "generator_timeout"), "broken": (None, "generator_failed"), "silent": (None, "generator_failed")}
    assert G.generated(asked.limit(0), generate).count() == 0


def test_trigrams_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    words = ["brand", "brandy", "grand", "stand", "sand", "xylem", "quartz", "opal", "jade", "pearl"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(120)] + [None, "", "brand " + "zyx" * 40]
    asked = [" ".join(rng.choices(words, k=rng.randrange(0, 5))) + " brand"[: rng.randrange(7)] for _ in range(40)]
    chunks = spark.createDataFrame([(f"c{i}", "s", ["public"] if i % 5 else ["private"], t) for i, t in enumerate(texts)], "chunk_id string, source_id string, acl_labels array<string>, text string")
    requests = spark.createDataFrame([(f"r{i}", q, ["public"], []) for i, q in enumerate(asked)], "request_id string, query string, grants array<string>, source_ids array<string>")
    grams = lambda t: {f"  {w} "[i : i + 3] for w in (t or "").split() for i in range(len(w) + 1)}
    for floor in (0.3, 0.75, 1.0):
        expected = {}
        for i, q in enumerate(asked):
            for j, t in enumerate(texts):
                a, b = grams(q), grams(t)
                if j % 5 and a & b and len(a & b) / len(a | b) >= floor:
                    expected[f"r{i}", f"c{j}"] = len(a & b) / len(a | b)
        assert {(r.request_id, r.chunk_id): r.score for r in R.trigram_hits(requests, chunks, floor).collect()} == expected


def test_full_text_against_plain_clauses(spark):
    import random

    rng = random.Random(7)
    words = ["apple", "banana", "cherry", "damson", "elder", "fig"]
    texts = [" ".join(rng.choices(words, [9, 5, 3, 2, 1, 1], k=rng.randrange(0, 8))) for _ in range(80)] + [None, ""]
    asked = [" ".join(rng.choice(["", "", "-"]) + rng.choice([w, w, f'"{w} {rng.choice(words)}"']) for w in rng.choices(words, k=rng.randrange(1, 4))) for _ in range(40)] + ["fig or elder", "apple -banana or cherry", "missing apple", "", "-apple"]

    def matches(query, text):
        groups, either = [], False
        for part in re.findall(r'-?"[^"]*"|\S+', query):
            if part == "or":
                either = True
                continue
            phrase = part.strip('-"')
            if either and groups:
                groups[-1][1].append(phrase)
            else:
                groups.append((part.startswith("-"), [phrase]))
            either = False
        there = lambda p: f" {p} " in f" {text or ''} "
        return any(not n for n, _ in groups) and all(any(there(p) for p in ps) != n for n, ps in groups)

    chunks = spark.createDataFrame([(f"c{i}", "s", ["public"] if i % 5 else ["private"], t) for i, t in enumerate(texts)], "chunk_id string, source_id string, acl_labels array<string>, text string")
    requests = spark.createDataFrame([(f"r{i}", q, ["public"], []) for i, q in enumerate(asked)], "request_id string, query string, grants array<string>, source_ids array<string>")
    expected = {(f"r{i}", f"c{j}") for i, q in enumerate(asked) for j, t in enumerate(texts) if j % 5 and matches(q, t)}
    got = [(r.request_id, r.chunk_id) for r in R.full_text(requests, chunks).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 50


def test_cover_density(spark):
    def density(groups, text):
        """Every stretch that has all clauses and loses one when it loses an end."""
        words, has = text.split(), lambda w: all(any(f" {a} " in f" {' '.join(w)} " for a in g) for g in groups)
        known = {x for g in groups for a in g for x in a.split()}
        covers = [words[i:j] for i in range(len(words)) for j in range(i + 1, len(words) + 1) if has(words[i:j]) and not has(words[i + 1 : j]) and not has(words[i : j - 1])]
        return sum(0.1 / (1 + sum(x not in known for x in c)) for c in covers)

    import random

    rng = random.Random(3)
    rows = []
    for _ in range(200):
        groups = [[" ".join(rng.choices("abc", k=rng.randrange(1, 3))) for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 4))]
        rows.append((groups, " ".join(rng.choices("abcxyz", k=rng.randrange(0, 14)))))
    got = spark.createDataFrame([(i, g, t.split()) for i, (g, t) in enumerate(rows)], "i int, g array<array<string>>, t array<string>").select("i", R.cover_density("g", "t").alias("d")).collect()
    assert all(math.isclose(r.d, density(*rows[r.i]), abs_tol=1e-12) for r in got) and sum(r.d > 0 for r in got) > 50
    requests, chunks = tables(spark, ('apple recipe -secret or "apple notes"', ["owner:me", "public"], [], None), ("apple", ["owner:me"], [], None))
    top = {(r.request_id, r.chunk_id): (r.score, r.rank) for r in R.density_top(requests, chunks).collect()}
    assert top["r1", "a:1"] == (0.2, 1)
