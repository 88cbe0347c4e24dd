from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import chunk as C

NOTE = "# Guide\n\nintro text\n\n## Code\n\n```py\nif x:\n    y()\n\nz\n```\n\n## Table\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter"


def test_blocks_and_headings():
    got = [(b.kind, b.path, b.first, b.last) for b in C.blocks(NOTE)]
    assert got == [("text", ("Guide",), 3, 3), ("code", ("Guide", "Code"), 7, 12), ("table", ("Guide", "Table"), 16, 18), ("text", ("Guide", "Table"), 19, 19)]


def test_code_stays_whole():
    assert any("    y()\n\nz" in body for _, body, *_ in C.chunks(NOTE))


def test_sections_are_not_merged():
    got = C.chunks("# A\n\none\n\n## B\n\ntwo\n\n## C\n\nthree")
    assert [x[3] for x in got] == [("A",), ("A", "B"), ("A", "C")]
    assert [x[0] for x in got] == [0, 1, 2]


def test_a_lower_heading_closes_deeper_ones():
    got = [x[3] for x in C.chunks("## B\n\nx\n\n### C\n\ny\n\n# A\n\nz")]
    assert got == [("B",), ("B", "C"), ("A",)]


def test_long_prose_is_split_at_sentences():
    text = "# T\n\n" + " ".join(f"Sentence number {i} is here." for i in range(600))
    got = C.chunks(text, target=200, most=300)
    assert len(got) > 10 and all(size <= 300 for _, _, size, *_ in got)
    assert " ".join(body for _, body, *_ in got).split() == text.split()[2:]


def test_one_long_sentence_stays_whole():
    assert len(C.chunks("word " * 2000, target=100, most=150)) == 1


def test_overlap_carries_prose():
    text = "# S\n\n" + "\n\n".join(f"Paragraph {i}" + " word" * 18 for i in range(8))
    got = C.chunks(text, target=60, most=100, overlap=0.5)
    assert any(a[1].split("\n\n")[-1] == b[1].split("\n\n")[0] for a, b in zip(got, got[1:], strict=False))


def test_a_short_tail_joins():
    sizes = [x[2] for x in C.chunks("\n\n".join(["a" * 2400, "b" * 40]), overlap=0)]
    assert len(sizes) == 1


@given(st.text(alphabet="ab #`|\n.", max_size=300))
@settings(max_examples=200, deadline=None)
def test_nothing_but_headings_is_lost(text):
    kept = "".join(c for _, body, *_ in C.chunks(text, overlap=0) for c in body if c not in " \n")
    whole = "".join(c for b in C.blocks(text) for c in b.body if c not in " \n")
    assert kept == whole


def test_dataframe(spark):
    docs = spark.createDataFrame([("d1", NOTE), ("d2", ""), ("d3", None)], "document_id string, text string")
    got = C.chunk_documents(docs).collect()
    assert {r.document_id for r in got} == {"d1"} and len(got) == len(C.chunks(NOTE))


def test_in_sql(spark):
    C.register_chunk_function(spark)
    spark.createDataFrame([("d1", NOTE)], "id string, text string").createOrReplaceTempView("notes")
    got = spark.sql("SELECT id, c.ordinal, c.text FROM notes, LATERAL chunk_text(text) c ORDER BY c.ordinal").collect()
    assert [r.text for r in got] == [x[1] for x in C.chunks(NOTE)]
