import json

import pytest

from quarry.operators import catalog as K

PARTS = [
    {"part_id": "BP-1", "name": "Front pads", "description": "Brake pads for city cars", "compatible_with": ["Comet City 2020-2023", "Comet City Plus 2021-2023"], "source_id": "s1", "catalog_version": "v1"},
    {"part_id": "AF-2", "name": "Air filter", "description": "Panel engine filter", "compatible_with": ["Pine Saloon 2019-2024"], "source_id": "s2", "catalog_version": "v2"},
    {"part_id": "XX-9", "name": "Old wiper", "description": "Wiper blade", "compatible_with": ["Pine Saloon 2019-2024"], "source_id": "s2", "catalog_version": "v9", "deleted": True},
]
CASES = [
    ("known", "Which brake pads fit Comet City 2022?", "BP-1"),
    ("other", "Which engine air filter fits Pine Saloon 2021?", "AF-2"),
    ("year", "Which brake pads fit Comet City 2024?", None),
    ("vehicle", "Does BP-1 fit Pine Saloon 2021?", None),
    ("unknown", "Which wiper fits Northern Truck?", None),
]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "catalog.json"
    path.write_text(json.dumps({"parts": PARTS}))
    return K.load_catalog(spark, str(path))


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "request_id string, query string")


def test_deleted_parts_are_gone(parts):
    assert K.catalog_version(parts).first().asDict() == {"catalog_version": "v2", "n_parts": 2}


def test_golden_cases_pass_the_gate(spark, parts):
    requests = spark.createDataFrame([(i, q) for i, q, _ in CASES], "request_id string, query string")
    found = K.search(requests, parts).where("rank = 1").selectExpr("request_id AS id", "part_id AS found_id")
    cases = spark.createDataFrame([(i, e) for i, _, e in CASES], "id string, expected_id string")
    got = K.gate(cases, found).first()
    assert (got.n, got.passed, got.pass_rate, got.open) == (5, 5, 1.0, True)


def test_fold_depends_on_the_order(spark, parts):
    hit = K.search(asked(spark, "pads Comet City Plus 2022"), parts).first()
    assert hit.score == 4 + 11  # pads, comet, city, plus; (2 * 3 + 2), then max(8, 3 * 3) + 2


def test_without_a_vehicle_the_year_is_not_asked(spark, parts):
    assert K.search(asked(spark, "brake pads 1999"), parts).first().part_id == "BP-1"


def test_answers(spark, parts):
    got = {r.request_id: (r.outcome, r.cited) for r in K.answer(asked(spark, "brake pads Comet City 2021", "nothing here"), parts).collect()}
    assert got == {"q0": ("ok", ["BP-1"]), "q1": ("no_evidence", [])}


def test_copies_under_other_ids_are_one_kind(spark):
    """Large groups of equal parts: only the first ids of a kind meet a question, ids and years that are asked for count, ties go by id."""
    make = lambda i, name, fit: (f"P-{i}", name, "pads", [fit], "s", "v1")
    rows = [make(i, "front", "Comet City 2020-2023") for i in range(100, 160)] + [make(i, "rear", "Comet Plus 2020-2023") for i in range(200, 260)] + [make(2022, "front", "Comet City 2020-2023"), make(9, "odd", "Other 1990")]
    parts = spark.createDataFrame(rows, "part_id string, name string, description string, compatible_with array<string>, source_id string, catalog_version string")
    got = K.search(asked(spark, "front pads Comet City 2022", "front pads Comet City 2022", "P-205 Comet 2021", "front pads", "P-205 Other 1990"), parts).orderBy("request_id", "rank").collect()
    found = {q: [(r.part_id, r.score) for r in got if r.request_id == q] for q in ("q0", "q1", "q2", "q3", "q4")}
    first = [("P-2022", 13.0), *((f"P-{i}", 12.0) for i in range(100, 104))]
    assert found == {"q0": first, "q1": first, "q2": [("P-205", 6.0)], "q3": [(f"P-{i}", 2.0) for i in range(100, 105)], "q4": []}


def test_questions_do_not_meet_copies(spark):
    """What meets the questions is as large for 40 copies of every part as for one: no operator makes pairs with them."""
    from quarry.functions.columns import computed

    sizes = []
    for copies in (1, 40):
        parts = spark.range(20 * copies).selectExpr("concat('P-', id) AS part_id", "concat('n', id % 20) AS name", "'pads' AS description", "array('Comet City 2020-2023') AS compatible_with", "'s' AS source_id", "'v1' AS catalog_version")
        seen = []
        real, K.computed = K.computed, lambda rows, **c: (seen.append(rows.count()), computed(rows, **c))[1]
        try:
            K.search(asked(spark, "n3 pads Comet 2022", "n4 pads Comet 2021"), parts)
        finally:
            K.computed = real
        sizes.append(sum(seen))
    assert sizes[0] == sizes[1] > 0
