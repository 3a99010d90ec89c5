"""Main text of pages and WARC archives."""

import gzip
import base64
import hashlib

import numpy as np
import pytest

from riskloom.llm import html, warc
from riskloom.session import run_folder


def main(page):
    return html.blocks_of(page)[0]


def test_the_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1><a>Log in</a></header><nav><ul><li>Home<li>About</ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</div>
    <main><article><header><h1>Title &amp; more</h1><span>by someone</span></header><p><b>One</b> two<br>three<p>Four&nbsp;five &eacute;
    <div class="ad-box">Buy</div><form><input><button>Go</button></form><aside>see also</aside><p hidden>secret</p>
    <table><tr><td>a</td><td>b</td></tr></table><section class="comments"><article><p>Great!</p></article></section><p>six</article></main>
    <footer>&copy; all</footer></body></html>"""
    assert main(page) == ["Title & more", "One two three", "Four five é", "a b", "six"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("<article>cut off &am", ["cut off &am"]),
        ("<article><p>cut <a href='x", ["cut"]),
        ("<article><p>a < b and c > d</p></article>", ["a < b and c > d"]),
        ("<article><p title='a > b'>x</p></article>", ["x"]),
        ("<article>a<script>never closed", ["a"]),
        ("<div class='no-sidebar'><article>kept</article></div>", ["kept"]),
        ("<ARTICLE><P>Upper</P></ARTICLE>", ["Upper"]),
        ("<article><p>one</p></article><nav>x</nav><article><p>two</p></article>", ["one", "two"]),
        ("<article></article>", []),
    ],
)
def test_broken_and_odd_markup(page, want):
    assert main(page) == want


def test_suffixes_are_sorted_and_grouped_within_pages():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(0, 60))
        tokens, page = rng.integers(0, 3, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        suffixes, heads = html.sorted_suffixes(tokens, page)
        assert sorted(suffixes.tolist()) == [i for i in range(n - 7) if page[i] == page[i + 7]]
        prefixes = [tuple(tokens[i : i + 8].tolist()) for i in suffixes]
        assert prefixes == sorted(prefixes)
        assert heads.tolist() == [i for i in range(len(prefixes)) if i == 0 or prefixes[i] != prefixes[i - 1]]


BOILERPLATE = "home about us our products and services contact imprint privacy terms"


@pytest.mark.parametrize("slice_tokens", [2_000_000, 60])
def test_boilerplate_of_a_host_goes_where_markup_is_silent(spark, slice_tokens):
    rows = [(i, f"http://h.org/{i}", f"<div>{BOILERPLATE}</div><p>n{i} text of {i * 7} its own{i}</p><div>all rights reserved by the company h in the year twenty</div>") for i in range(30)]
    rows += [
        (100, None, None),
        (101, "http://x.y/", f"<p>{BOILERPLATE}"),  # one page of its host
        (102, "http://h.org/a", f"<article><p>{BOILERPLATE}</p></article>"),  # an article is kept whatever repeats
        (None, "http://h.org/q", ""),
        (103, "http://z.z/", f"<p>{BOILERPLATE}"),
        (103, "http://z.z/", f"<p>{BOILERPLATE}"),  # the same page again
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in html.main_text(pages, slice_tokens).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i] == [(t := f"n{i} text of {i * 7} its own{i}", len(t))] for i in range(30))
    assert got[100] == got[None] == [("", 0)]
    assert got[101] == got[102] == [(BOILERPLATE, len(BOILERPLATE))] and got[103] == got[101] * 2


def plain_text(rows):
    """The rules again, page by page with sets of word tuples: what a host's distinct articles repeat."""
    parsed = {k: (host, *html.blocks_of(page or "")) for k, (host, page) in rows.items()}
    seen = {}
    for host, main, other, any_main, loose in parsed.values():
        article = tuple(main) if any_main else tuple(t for t, c in other if c)
        words = " ".join([*(t for t, own in zip(main, loose) if own and any_main), *(t for t, _ in other)]).split()
        for i in range(len(words) - 7):
            seen.setdefault((host, *words[i : i + 8]), set()).add(" ".join(article))
    out = {}
    for k, (host, main, other, any_main, loose) in parsed.items():
        asked = [t for t, own in zip(main, loose) if own] if any_main else [t for t, _ in other]
        words = " ".join([*asked, *([t for t, _ in other] if any_main else [])]).split()
        gone = {j for i in range(len(words) - 7) if len(seen[(host, *words[i : i + 8])]) > 1 for j in range(i, i + 8)}
        kept, at = [], 0
        for text, role in [(t, "loose" if own else "prose") for t, own in zip(main, loose)] if any_main else [(t, "open" if c else "apart") for t, c in other]:
            if role == "prose":
                kept.append(text)
                continue
            own = [w for j, w in enumerate(text.split(), at) if j not in gone]
            at += len(text.split())
            if own and role != "apart":
                kept.append(text if role == "loose" else " ".join(own))
        out[k] = "\n".join(kept)
    return out


def test_repeats_of_a_host_decide_as_a_plain_version_does(spark):
    advert = "buy now the best of all goods at half the price only today"
    copied = " ".join(f"copied{i}" for i in range(40))
    rows = {}
    for i in range(24):
        body = " ".join(f"w{i}x{j}" for j in range(12 + i))
        shared = "a quotation that several articles of the host share word for word"
        page = f"<article><h1>T{i}</h1><p>{body}</p><p>{shared}</p><div>{advert}</div><section>own container text of number {i} stays here</section></article><footer>{BOILERPLATE}</footer>"
        rows[i] = ("a.b", page) if i % 2 else ("c.d", f"<div>{advert}</div><p>{body}</p><div>{BOILERPLATE} {i}</div>")
    rows[100], rows[101] = ("e.f", f"<p>{copied}</p>"), ("e.f", f"<nav>x</nav><p>{copied}</p>")  # copies, no article element
    rows[102], rows[103] = ("g.h", f"<article><div>{copied}</div></article>"), ("g.h", f"<article><div>{copied}</div></article>")
    rows[104] = ("a.b", "<article><p>" + "long " * 200_000 + "</p></article>")
    pages = spark.createDataFrame([(k, f"http://{host}/{k}", page) for k, (host, page) in rows.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages.repartition(5)).collect()}
    assert got == plain_text(rows)
    assert got[100] == got[101] == got[102] == got[103] == copied
    assert all(advert not in got[i] for i in range(24)) and all(f"w{i}x0" in got[i] for i in range(24))
    assert got[1].endswith("own container text of number 1 stays here") and "a quotation that several" in got[1]
    assert len(got[104]) == 999_999


def test_pages_have_a_row_each(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html.main_text(pages).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.collect())
    assert all(len(r.text) == r.n_chars > 0 and "<" not in r.text for r in rows)
    assert html.main_text(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, "same"), (4, "a b\r\nWARC-Type: x", "é" * 100_000), (5, "u", None), (6, "u", ""), (7, "u", "other\r\n\r\n"), (None, "u", "alone"), (None, "v", "same"), (8, "w", "twice"), (8, "w", "twice")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_give_back_what_was_written(pages):
    rows = warc.round_trip(pages).collect()
    assert len(rows) == pages.count()
    by = {r.page_id: r for r in rows if r.page_id}
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    for page in pages.where("page_id is not null").collect():
        assert (by[page.page_id].payload_digest, by[page.page_id].payload_bytes) == (digest(page.html), len((page.html or "").encode()))
    assert {i: (r.record_type, r.refers_to) for i, r in by.items()} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("revisit", 6),
        6: ("response", None), 7: ("response", None), 8: ("response", None),
    }
    assert sorted((r.record_type, r.refers_to or 0) for r in rows if r.page_id is None) == [("response", 0), ("revisit", 3)]
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=10).where("page_id < 3").collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_predicates_are_decided_on_headers_and_payloads_come_back(spark, pages, monkeypatch):
    warc.register(spark)
    folder = run_folder(spark, "archives")
    warc.records(pages.coalesce(1)).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder)
    assert {bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()} == {"same", "é" * 100_000, "", "other\r\n\r\n", "alone", "twice"}
    assert back.where("record_type = 'revisit' and payload is not null").count() == 0
    assert back.where("page_id in (1, 4)").count() == 2
    plan = back.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "record_type" in plan
    # The reader itself: what is not wanted is never decoded.
    reader = warc.WarcReader(folder, verify=False, payload=True)
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    monkeypatch.setattr(warc.zlib, "decompress", lambda *a: pytest.fail("a payload was decoded"))
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 4


def test_files_of_a_failed_attempt_are_not_read(spark, pages):
    store = run_folder(spark, "archives")
    writer = warc.WarcWriter(store)
    rows = [r.asDict() for r in warc.records(pages).collect()]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([kept])
    reader = warc.WarcReader(store, False, False)
    assert [p.value.rpartition("/")[2] for p in reader.partitions()] == [kept.name] != [lost.name]


def test_appended_archives_add_up_and_overwriting_replaces(spark, tmp_path):
    warc.register(spark)
    page = lambda *ids: spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>") for i in ids], "page_id long, url string, html string")
    ids = lambda: sorted(r.page_id for r in spark.read.format("warc").load(str(tmp_path / "w")).collect())
    for part in ((1, 2), (3, 4, 5)):
        warc.records(page(*part)).write.format("warc").mode("append").save(str(tmp_path / "w"))
    assert ids() == [1, 2, 3, 4, 5]
    warc.records(page(9)).write.format("warc").mode("overwrite").save(str(tmp_path / "w"))
    assert ids() == [9]


def test_archives_of_others_are_read(spark, tmp_path):
    """A folder without listings, plain payloads, record ids of other kinds, records that are no pages."""
    warc.register(spark)

    def record(kind, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:5d0ce0f0-0000-4000-8000-000000000001>", **more, "Content-Length": str(len(block))}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    packed = b"HTTP/1.1 200 OK\r\ncontent-encoding:  gzip\r\n\r\n" + gzip.compress(b"packed")
    url = {"WARC-Target-URI": "http://a/1"}
    data = record("warcinfo", b"software: x\r\n") + record("request", b"GET / HTTP/1.1\r\n\r\n", **url) + record("response", http + b"<p>plain</p>", **url) + record("response", packed, **url)
    (tmp_path / "other.warc").write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "response"]
    assert [bytes(r.payload) for r in rows if r.payload is not None] == [b"<p>plain</p>", b"packed"] and rows[2].url == "http://a/1"
    checked = spark.read.format("warc").option("verify", "true").load(str(tmp_path)).where("record_type = 'response'").collect()
    assert [r.payload_bytes for r in checked] == [12, 6]
