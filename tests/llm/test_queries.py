"""The registered queries run on the given tables, and agree with their SQL."""

import zlib

import pytest

from quarry.llm.queries import oracle_sql, queries
from tests.oracle import DATA, connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert spark_rows(queries()[name](spark, DATA)) == duck_rows(connect(), oracle_sql()[name])


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def test_base_columns_of_the_license_scan_agree_with_sql(spark):
    places = " ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()}) AS p{k}," for k, p in enumerate(("under the mit license", "apache license version 2", "cc by nc")))
    sql = f"""WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), p AS (SELECT doc_id, len(w) AS n_words, {places} FROM t)
        SELECT doc_id, n_words, len(p0) + len(p1) + len(p2) AS n_base, list_min(list_concat(p0, p1, p2)) - 1 AS first_word, list_max(list_concat(p0, p1, p2)) - 1 AS last_word,
        array_to_string(list_filter([CASE WHEN len(p1) > 0 THEN 'apache-2' END, CASE WHEN len(p2) > 0 THEN 'cc-by-nc' END, CASE WHEN len(p0) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p"""
    got = queries()["op8_license_scan"](spark, DATA).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert spark_rows(got) == duck_rows(connect(), sql) and got.where("n_base > 0").count()


def test_counts_of_the_secret_scan_agree_with_sql(spark):
    sql = r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6)) AS n_assign,
        len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 24)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""
    folder = DATA.replace("sf0.001", "sf0.01")  # the smallest tables hold none
    got = queries()["op5_secret_scan"](spark, folder).select("doc_id", "n_assign", "n_access", "n_hex")
    assert spark_rows(got) == duck_rows(connect(folder), sql) and got.where("n_assign + n_access + n_hex > 0").count()


def test_base_columns_of_the_language_model_agree_with_sql(spark):
    con = connect()
    held = [i for (i,) in con.sql("SELECT doc_id FROM documents").fetchall() if zlib.crc32(str(i).encode()) % 7 == 2]
    sql = f"""WITH w AS (SELECT doc_id, doc_id IN ({", ".join(map(str, held))}) AS held_out, list_append(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), '\n') AS words FROM documents),
        t AS (SELECT doc_id, held_out, unnest(words) AS word FROM w), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) AS base_score FROM t LEFT JOIN c USING (word), n GROUP BY doc_id, held_out"""
    got = queries()["op4_maxent_lm"](spark, DATA)
    assert spark_rows(got.selectExpr("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 6) AS base_score")) == duck_rows(con, sql)
