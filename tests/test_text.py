import math

from pyspark.sql import functions as F

from quarry.functions import access as A
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.functions.normalize import canonical


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cosmetic_edits_keep_the_text():
    assert canonical("# A\r\n\r\n\r\n\r\nline  \r\nb\t\n") == "# A\n\nline\nb"
    assert canonical("cafe\u0301") == "caf\u00e9"


def test_fenced_code_keeps_its_spaces():
    assert canonical("a  \n```\nx = 1  \n```  \nb  ") == "a\n```\nx = 1  \n```\nb"
    assert canonical("````\n```  \n````\nb ") == "````\n```  \n````\nb"


def test_analyze(spark):
    assert one(spark, T.analyze(F.lit("The C++ and node.js of a x-ray"))) == ["c++", "node.js", "x-ray"]


def test_tokens_round_half_to_even(spark):
    sizes = [0, 1, 2, 6, 10, 14]
    got = [one(spark, T.estimate_tokens(F.lit("x" * n))) for n in sizes]
    assert got == [max(1, round(n / 4)) for n in sizes]


def test_language(spark):
    assert one(spark, T.detect_language(F.lit("To jest notatka o ko\u015bciele"))) == "pl"
    assert one(spark, T.detect_language(F.lit("This is a note"))) == "en"
    assert one(spark, T.detect_language(F.lit("dla nie"))) == "pl"
    assert one(spark, T.detect_language(F.lit(""))) == "en"


def test_chunk_ids_are_stable(spark):
    assert one(spark, T.chunk_id(F.lit("s:a"), F.lit("f" * 64), F.lit(7))) == "s:a@ffffffffffff#0007"
    assert one(spark, T.chunk_id(F.lit("s:a"), F.lit("f" * 64), F.lit(12345))).endswith("#12345")


def test_slug_and_context(spark):
    assert one(spark, T.fragment(F.array(F.lit("A"), F.lit(" Set-up: the basics! ")))) == "set-up-the-basics"
    assert one(spark, T.fragment(F.array().cast("array<string>"))) is None
    assert one(spark, T.contextual_text(F.array(F.lit("a"), F.lit("b")), F.lit("t"))) == "a > b\n\nt"


def test_trigrams(spark):
    assert set(one(spark, T.trigrams(F.lit("Cat")))) == {"  c", " ca", "cat", "at "}


def test_labels(spark):
    f = lambda v: one(spark, A.acl_labels(F.lit("s"), F.lit("o"), F.lit(v)))
    assert f("private") == ["source:s", "owner:o"]
    assert f("public") == ["source:s", "owner:o", "public"]
    assert f("shared") == ["source:s", "owner:o", "shared:s"]
    assert one(spark, A.may_read(F.array(F.lit("a")), F.array().cast("array<string>"))) is False


def test_vectors(spark):
    v = one(spark, V.hash_embed(F.lit("alpha beta beta"), 16))
    assert math.isclose(sum(x * x for x in v), 1.0)
    assert one(spark, V.hash_embed(F.lit("the of"), 16)) == [0.0] * 16
    assert one(spark, V.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert one(spark, V.shorten(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2)) == [0.6, 0.8]
