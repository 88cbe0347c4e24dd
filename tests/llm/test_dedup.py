import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import near_dedup as N
from quarry.llm.exact_dedup import CountingQuotientFilter as Cqf
from quarry.llm.exact_dedup import exact_dedup, repeated_fingerprints
from quarry.llm.graph import components
from quarry.llm.suffix_dedup import equal_runs, suffix_dedup, two_stage_sort
from tests.llm import brute
from tests.llm.conftest import BIG


def table(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# ---- exact ----

keys = st.dictionaries(st.integers(0, 2**40 - 1), st.integers(1, 10**6), max_size=60)


def build(d, bits=40):
    k = np.array(sorted(d), np.uint64)
    return Cqf.build(k, np.array([d[int(x)] for x in k], np.int64), bits)


@given(keys)
@settings(max_examples=150, deadline=None)
def test_filter_keeps_what_it_got(d):
    for f in (build(d), Cqf.unpack(build(d).pack())):
        k, c = f.items()
        assert dict(zip(k.tolist(), c.tolist(), strict=True)) == d


@given(st.lists(keys, min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_merging_adds_counts(parts):
    k, c = Cqf.merge([build(d) for d in parts]).items()
    total = {}
    for d in parts:
        for x, n in d.items():
            total[x] = total.get(x, 0) + n
    assert dict(zip(k.tolist(), c.tolist(), strict=True)) == total


def test_runs_wrap_past_crowded_quotients():
    d = {(7 << 34) | i: i % 3 + 1 for i in range(500)}
    k, c = build(d).items()
    assert dict(zip(k.tolist(), c.tolist(), strict=True)) == d


def test_repeated_fingerprints(spark):
    prints = spark.createDataFrame([(x,) for x in [5, -7, 5, 9, -7, -7, 2**62]], "fp long").repartition(3)
    for blocks in (1, 8):
        assert {(r.fp, r.n) for r in repeated_fingerprints(prints, blocks).collect()} == {(5, 2), (-7, 3)}


def test_exact_equals_brute_force(docs, rows):
    assert table(exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)


def test_exact_edges(odd, empty):
    assert exact_dedup(empty).count() == 0
    got = sorted(((r.doc_id is None, r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd).collect() if r.doc_id)
    assert got == [((False, 1), 1, 3, True)] * 2 + [((False, 2), 2, 2, True), ((False, 3), 3, 1, True)]


# ---- near ----


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    for n, shared in ((1000, 800), (60, 40), (4, 3)):
        both = r.integers(0, 2**63, n * 2 - shared, dtype=np.int64).astype(np.uint64)
        a, b = N.signatures([np.unique(both[:n]), np.unique(both[n - shared :])], slots=512)
        assert abs((a == b).mean() - shared / (2 * n - shared)) < 0.09


def test_every_slot_is_filled_and_rounds_stop_early():
    sig = N.signatures([np.array([7], np.uint64), np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
    assert (sig < (np.uint64(N.SLOTS) << np.uint64(32))).all()
    assert sorted((sig[0] >> np.uint64(32)).tolist()) == list(range(N.SLOTS))  # one element takes one slot in each round
    assert (sig[1] >> np.uint64(32)).max() <= 1


def test_components(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1120)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_near_equals_brute_force(docs, rows):
    assert table(N.near_dedup(docs), "n_shingles", "component_id", "kept") == brute.near(rows)


def test_links_outside_the_star_are_found(spark):
    """A chain whose ends are unlike: members of one bucket that are not like its smallest one."""
    base = [f"w{i}" for i in range(120)]
    chain = []
    for k in range(12):
        w = list(base)
        for j in range(k * 3):
            w[(j * 9) % 120] = f"z{j}"
        chain.append((k, " ".join(w)))
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert table(N.near_dedup(df), "n_shingles", "component_id", "kept") == brute.near(chain)


def test_blocks_meet_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        w = list(base)
        w[(k * 7) % 60] = f"a{k}"
        w[(k * 11 + 5) % 60] = f"b{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(N.near_dedup(df), "n_shingles", "component_id", "kept") == brute.near(rows)


def test_several_texts_under_one_id(spark):
    """In either order of the rows, both texts of id 3 are compared with the chain around them."""
    base = [f"w{i}" for i in range(120)]
    chain = []
    for k in range(12):
        w = list(base)
        for j in range(k * 3):
            w[(j * 9) % 120] = f"z{j}"
        chain.append((k, " ".join(w)))
    other = (3, " ".join(f"q{i}" for i in range(80)))
    for rows in ([*chain, other], [other, *chain[::-1]]):
        got = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
        due = brute.near(chain)
        assert {r.doc_id: r.component_id for r in got} == {i: x[1] for i, x in due.items()} and len(got) == 13


def test_near_edges(odd, empty):
    assert N.near_dedup(empty).count() == 0
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(odd).collect())
    assert got == [("1", 6, 1, True), ("1", 6, 1, True), ("2", 0, 2, True), ("3", 1, 3, True), ("None", 0, None, True), ("None", 6, None, True)]


# ---- suffixes ----


@given(st.binary(max_size=200) | st.text(alphabet="ab", max_size=200).map(str.encode))
@settings(max_examples=200, deadline=None)
def test_two_stage_sort(data):
    got = two_stage_sort(np.frombuffer(data, np.uint8), 50).tolist()
    assert sorted(got) == list(range(len(data)))
    assert [data[i : i + 50] for i in got] == sorted(data[i : i + 50] for i in got)


def test_equal_runs():
    data = b"abcabcabcabcxabcabcabcabcabc"
    for length in (8, 9, 12):
        last = len(data) - length
        got = equal_runs(np.frombuffer(data, np.uint8), np.arange(len(data)) <= last, length)
        by = {}
        for i in range(last + 1):
            by.setdefault(data[i : i + length], set()).add(int(got[i]))
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
        assert (got[last + 1 :] == -1).all()


def test_suffix_equals_brute_force(docs, rows):
    got = table(suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows) and any(v[1] for v in got.values())


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    import quarry.llm.suffix_dedup as S

    monkeypatch.setattr(S, "PIECE", 300)
    rows = [(i, ("abcdefghij" * 3 + f"{i % 3}" + "the quick brown fox jumps over the lazy dog " * 3) * 6) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(suffix_dedup(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


def test_anchors_of_many_runs_are_dealt_out_run_by_run(spark, docs, rows, monkeypatch):
    import quarry.llm.suffix_dedup as S

    monkeypatch.setattr(S, "HOT_RUNS", 2)
    monkeypatch.setattr(S, "BLOCK_BYTES", 5000)
    assert table(suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)
    footer = "all of these documents end in one and the same footer, which has more than fifty bytes"
    more = [(i, f"{i * 7919} {'x' * (i % 9)} the beginning of it {i} {footer}") for i in range(300)]
    got = table(suffix_dedup(spark.createDataFrame(more, "doc_id long, text string").repartition(7)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(more) and all(v[1] >= len(footer) for i, v in got.items() if i)


def test_runs_of_one_byte_take_memory_in_step_with_their_text():
    import tracemalloc

    import quarry.llm.suffix_dedup as S

    texts = [f"{i * 7919} a table begins here and ends {'-' * 2000}".encode() for i in range(200)]
    runs = S.Runs(texts, 9)
    tracemalloc.start()
    try:
        owner, place, number = S._one_by_one(texts, runs.owner, runs.first, runs.last, 9)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200e6
    by = {}
    for o, p, n in zip(owner.tolist(), place.tolist(), number.tolist(), strict=True):
        by.setdefault(texts[o][p : p + 50], set()).add(n)
    assert len(set(zip(owner.tolist(), place.tolist(), strict=True))) == len(owner) == sum(len(t) - 49 for t in texts)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_runs_of_one_byte_are_removed(spark, monkeypatch):
    import quarry.llm.suffix_dedup as S

    for name, value in (("HOT_RUNS", 300), ("BLOCK_BYTES", 5000), ("PIECE", 700), ("STEP_PLACES", 64)):
        monkeypatch.setattr(S, name, value)
    rows = [(i, f"{i * 7919} a table {'-' * (40 + i * 3)} {'=' * (i % 7 * 20)} ends here {i * i} {'ab' * (i % 5 * 30)}") for i in range(120)]
    rows += [(500, "-" * 2000), (501, "ab" * 1000), (502, None)]
    got = table(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows) and any(v[2] > 1 for v in got.values())


def test_suffix_edges(odd, empty, big_ids):
    assert {r.doc_id for r in suffix_dedup(big_ids).collect()} == {None, BIG, -BIG}
    assert suffix_dedup(empty).count() == 0
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(odd).collect())
    assert got == [("1", 41, 0, 0), ("1", 41, 0, 0), ("2", 0, 0, 0), ("3", 7, 0, 0), ("None", 0, 0, 0), ("None", 41, 0, 0)]


def test_ids_decide(spark):
    passage = "some passage that is longer than fifty bytes, certainly so, for this test"
    df = spark.createDataFrame([(5, passage), (None, passage), (9, "x" + passage), (9, passage)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup(df, with_text=True).collect())
    n = len(passage)
    assert got == [("5", n, 0), ("9", n, n), ("9", n + 1, n), ("None", n, 0)]
