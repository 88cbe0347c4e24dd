import hashlib
import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import fetch as X
from quarry.sources import files as S
from quarry.sources import web as W
from quarry.sources.html import extract

PAGE = """<html><head><title>A &amp; B</title><meta name="date" content="Mon, 02 Jan 2023 03:04:05 GMT"><link rel="canonical" href="/c"></head>
<body><nav><p>noise</p></nav><article><h1>Top</h1><p>one <b>two</b></p><p hidden>gone</p><div>bare<p>three</p></div><ul><li>x<ul><li>y</li></ul></li></ul><script>var a</script><p>one <b>two</b></p></article></body></html>"""


def test_main_text():
    got = extract(PAGE)
    assert got["text"] == "# Top\n\none  two\n\nthree\n\nx y"
    assert (got["title"], got["canonical_url"], got["published_at"]) == ("A & B", "/c", "Mon, 02 Jan 2023 03:04:05 GMT")


def test_regions_and_fallbacks():
    assert extract("<main><p>m</p></main><p>out</p>")["text"] == "m"
    assert extract("<p>a<p>b")["text"] == "a b"  # never closed: all is inside the first
    assert extract("<table><td>cell</td></table>")["text"] == ""
    assert extract("<meta property='og:title' content='O'><p>x</p>")["title"] == "O"
    assert extract("")["title"] == "Untitled page"
    assert extract("<div aria-hidden='true'><p>a</p></div><p>b<i hidden>c</i></p>")["text"] == "b c"


@pytest.mark.parametrize(
    ("url", "out"),
    [("HTTPS://Ex.Example.:443/a?b=1#c", "https://ex.example/a?b=1"), ("https://x.example", "https://x.example/"), ("https://u:p@x.example:8443/", "https://x.example:8443/"), ("http://x.example/", None), ("https:///a", None), ("nonsense", None)],
)
def test_addresses(spark, url, out):
    assert spark.range(1).select(W.normalize_url(F.lit(url)).alias("u")).first().u == out


def test_policies(spark):
    rows = spark.createDataFrame([("https://a.example/", "x", 200, "text/html; charset=utf-8"), ("https://a.local/", "x", 200, ""), ("https://a.example/", "x", 404, ""), ("https://a.example/", "x", 200, "application/pdf"), ("https://b.example/", "x", 200, "")], "url string, html string, status int, kind string")
    got = [r.p for r in rows.select(W.policy(F.col("url"), F.col("html"), F.col("status"), F.col("kind"), ("a.example", "a.local")).alias("p")).collect()]
    assert got == ["ok", "local_host", "http_error", "unsupported", "host_not_allowed"]


def test_robots_and_destinations(spark):
    rows = spark.createDataFrame([(200, "User-agent: *\nDisallow: /private", "https://x.example/private/a"), (200, "", "https://x.example/"), (403, "", "https://x.example/"), (500, "", "https://x.example/")], "s int, b string, u string")
    assert [r.d for r in rows.select(W.robots("bot")("s", "b", "u").alias("d")).collect()] == ["quarantined", "allowed", "quarantined", "allowed"]
    ips = spark.createDataFrame([("8.8.8.8",), ("8.8.8.8, 10.0.0.1",), ("127.0.0.1",), ("",), ("::1",)], "a string")
    assert [r.ok for r in ips.select(W.public_address("a").alias("ok")).collect()] == [True, False, False, False, False]


def test_dates(spark):
    rows = spark.createDataFrame([("Mon, 02 Jan 2023 03:04:05 GMT",), ("Mon, 02 Jan 2023 03:04:05 +0200",), ("2023-01-02T03:04:05Z",), (None,)], "v string")
    assert [str(r.d) if r.d else None for r in rows.select(W.published_at(F.col("v")).cast("string").alias("d")).collect()] == ["2023-01-02 03:04:05", "2023-01-02 01:04:05", None, None]


def test_pages(spark):
    rows = spark.createDataFrame([("https://x.example/a", PAGE), ("http://x.example/b", PAGE), ("https://x.example/c", "<p></p>")], "url string, html string")
    got = {r.source_uri: r for r in W.read_pages(rows, "web").collect()}
    assert got["https://x.example/a"].status == "available" and json.loads(got["https://x.example/a"].metadata_json)["canonical_url"] == "https://x.example/c"
    assert got["http://x.example/b"].status == "quarantined" and got["https://x.example/c"].status == "unreadable"


def site(url, address, headers):
    """A small web: (status, headers, body) of an address."""
    assert address == "93.184.216.34" and headers["User-Agent"] == "probe"
    host, path = url.removeprefix("https://").split("/", 1)
    if path == "robots.txt":
        return {"closed.example": (403, {}, b""), "free.example": (404, {}, b"")}.get(host, (200, {}, b"User-agent: *\nDisallow: /private"))
    if path == "broken":
        raise TimeoutError
    moved = {"old": "/new#part", "out": "http://free.example/x", "in": "https://inside.example/x", "loop": "/loop", "hidden": "/private/x", "nowhere": ""}
    if path in moved:
        return 302, {"location": moved[path]}, b""
    if path == "big":
        return 200, {"content-type": "text/html"}, b"x" * (W.MAX_BYTES + 1)
    if path == "pdf":
        return 200, {"content-type": "application/pdf"}, b"%PDF"
    if path == "gone":
        return 410, {}, b""
    return 200, {"content-type": "text/html; charset=iso-8859-2", "etag": '"v1"' if path == "new" else ""}, "<article><p>żółw</p></article>".encode("iso-8859-2")


def resolve(host):
    return ["93.184.216.34", "10.0.0.1"] if host == "inside.example" else ["93.184.216.34"]


def test_fetching(spark):
    expect = {
        "https://a.example/new": None, "https://a.example/old": None, "https://A.example./plain": None, "https://free.example/private/x": None, "https://a.example/out": "not_https",
        "https://a.example/in": "private_address", "https://a.example/loop": "too_many_redirects", "https://a.example/hidden": "robots", "https://a.example/private/y": "robots", "https://closed.example/z": "robots",
        "https://a.example/nowhere": "no_location", "https://a.example/big": "too_large", "https://a.example/broken": "request_failed", "https://localhost/x": "local_host", "http://a.example/x": "not_https",
        "https://a.example:x/": "not_https", "https://inside.example/x": "private_address", "https://a.example/pdf": None, "https://a.example/gone": None, None: "not_https",
    }
    fetched = X.fetch_pages(spark.createDataFrame([(u,) for u in expect], "url string"), "probe", get=site, resolve=resolve).cache()
    got = {r.url: r for r in fetched.collect()}
    assert {u: r.failure for u, r in got.items()} == expect
    assert got["https://a.example/old"].final_url == "https://a.example/new" and "żółw" in got["https://a.example/old"].html
    raw = {r.source_uri: r for r in W.read_pages(fetched, "web").collect()}
    old, plain = raw["https://a.example/old"], raw["https://a.example/plain"]
    assert (old.status, old.source_revision, old.text, json.loads(old.metadata_json)["canonical_url"]) == ("available", '"v1"', "żółw", "https://a.example/new")
    assert plain.source_revision == hashlib.sha256("<article><p>żółw</p></article>".encode("iso-8859-2")).hexdigest()
    status = {u: raw[u].status for u in ("https://a.example/pdf", "https://a.example/gone", "https://a.example/broken", "https://a.example/big", "https://closed.example/z")}
    assert list(status.values()) == ["unsupported", "quarantined", "unreadable", "quarantined", "quarantined"]


def test_fetching_from_allowed_hosts_only(spark):
    rows = spark.createDataFrame([("https://a.example/new",), ("https://free.example/new",)], "url string")
    assert {r.url: r.failure for r in X.fetch_pages(rows, "probe", allow_hosts=("a.example",), get=site, resolve=resolve).collect()} == {"https://a.example/new": None, "https://free.example/new": "host_not_allowed"}


def test_addresses_have_one_form(spark):
    urls = ["https://A.example", "HTTPS://u:p@a.example.:443/x?", "https://a.example:8443/x?q#f", "https://a.example?q", "http://a", "https:///x", "", "https://./x"]
    column = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(W.normalize_url(F.col("u"))).collect()]

    def python(url):
        try:
            return X.normal(url)
        except X.Refused:
            return None

    assert [python(u) for u in urls] == column


def test_files(spark, tmp_path):
    (tmp_path / "docs/deep").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_text("# Title here\n\nbody")
    (tmp_path / "docs/deep/b.txt").write_text("plain")
    (tmp_path / "docs/deep/skip.txt").write_text("no")
    (tmp_path / "docs/bad.md").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "docs/x.bin").write_bytes(b"1")
    (tmp_path / "outside.md").write_text("secret")
    (tmp_path / "docs/link.md").symlink_to(tmp_path / "outside.md")
    with zipfile.ZipFile(tmp_path / "docs/book.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="http://o"><manifest><item id="c1" href="one.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="two.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c2"/><itemref idref="c1"/></spine></package>')
        z.writestr("o/one.xhtml", "<body><h1>One</h1><p>first</p></body>")
        z.writestr("o/two.xhtml", "<body><h1>Two</h1><p>second</p></body>")
    got = {r.item_id: r for r in S.read_files(spark, "n", str(tmp_path / "docs"), exclude=("**/skip.*",)).collect()}
    assert set(got) == {"a.md", "deep/b.txt", "bad.md", "book.epub"}
    assert (got["a.md"].title, got["deep/b.txt"].title, got["bad.md"].status) == ("Title here", "b", "unreadable")
    assert got["book.epub"].text == "# Two\n\nsecond\n\n# One\n\nfirst"
    assert [(c["name"], c["line_start"], c["line_end"]) for c in json.loads(got["book.epub"].metadata_json)["chapters"]] == [("two.xhtml", 1, 3), ("one.xhtml", 6, 8)]
    known = spark.createDataFrame([("a.md", got["a.md"].source_revision)], "item_id string, source_revision string")
    assert "a.md" not in {r.item_id for r in S.read_files(spark, "n", str(tmp_path / "docs"), known=known).collect()}
    assert [r.item_id for r in S.read_files(spark, "n", str(tmp_path / "docs"), limit=1).collect()] == ["a.md"]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "sub").mkdir()
    (tmp_path / "atlas").mkdir()
    for name, text in (("top.md", "# Top"), ("sub/n.yaml", "a: 1"), ("x.json", "{}"), ("atlas/no.md", "n"), ("untracked.md", "u")):
        (tmp_path / name).write_text(text)
    run("add", "top.md", "sub/n.yaml", "x.json", "atlas/no.md")
    run("commit", "-m", "c")
    got = {r.item_id: r for r in S.read_git(spark, "g", str(tmp_path)).collect()}
    assert set(got) == {"top.md", "sub/n.yaml"} and len(got["top.md"].source_revision) == 40
    assert json.loads(got["top.md"].metadata_json)["commit"] == got["top.md"].source_revision


def test_hidden_names_are_read(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init")
    names = (".github/ci.yml", "_index.md", "_notes/x.md", "a/y.md", "a/.z.md")
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    run("add", ".")
    run("commit", "-m", "c")
    got = {r.item_id: (r.status, r.text) for r in S.read_git(spark, "g", str(tmp_path), exclude=()).collect()}
    assert got == {n: ("available", f"# {n}") for n in names}
    assert {r.item_id for r in S.read_files(spark, "f", str(tmp_path), include=("**/*.md",)).collect()} == set(names) - {".github/ci.yml"}
    known = spark.createDataFrame([("a/y.md", S.read_git(spark, "g", str(tmp_path)).first().source_revision)], "item_id string, source_revision string")
    assert {r.item_id for r in S.read_git(spark, "g", str(tmp_path), exclude=(), known=known, limit=2).collect()} == {".github/ci.yml", "_index.md"}


def test_only_what_matches_is_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text("a")
    (tmp_path / "b.bin").write_bytes(b"b")
    read = S._read
    seen = []
    monkeypatch.setattr(S, "_read", lambda names, *a, **k: (seen.append({r.item_id for r in names.collect()}), read(names, *a, **k))[1])
    assert S.read_files(spark, "f", str(tmp_path)).count() == 1 and seen == [{"a.md"}]
    assert S.read_files(spark, "f", str(tmp_path / "none")).count() == 0


def test_globs():
    import re

    match = lambda p, s: bool(re.fullmatch(S.glob_regex(p), s))
    assert match("**/*.md", "a.md") and match("**/*.md", "a/b/c.md") and not match("*.md", "a/b.md") and match("a/**", "a/b/c")
