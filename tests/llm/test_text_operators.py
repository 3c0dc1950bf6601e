"""Languages, compression bands, main text, archives."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from placewright.llm import archives, bands, languages, maintext
from placewright.llm.common import table

TEXT = st.text(alphabet=st.sampled_from("ab \n\t\r#é| "), max_size=80)


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(k, k + 5))
    lines, seen, repeats = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_base_counts(text):
    assert bands.base(text) == brute_base(text)


def test_bands_on_odd_rows(spark):
    rng = np.random.default_rng(7)
    parts = "en the re on ea st in ing er th an ha ed ti nd of to".split()
    good = " ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(300))
    noise = "".join(chr(33 + b % 90) for b in np.random.default_rng(1).integers(0, 10_000, 9000)).replace("a", " ")
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, "same words here again now " * 50), (5, good + " \0 " + "x" * 9000), (6, " ".join(f"{n:064x}" for n in range(3, 99)))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    found = {r["doc_id"]: r for r in bands.measure(docs).collect()}
    assert bands.measure(docs).count() == len(rows)
    assert [found[k]["kept"] for k in (1, 2, 3, 4, 5)] == [False, False, True, False, False]
    assert found[1]["n_words"] == 0 and found[4]["base_failed"] and not found[5]["base_failed"]
    assert bands.measure(docs.limit(0)).collect() == []
    press = bands.zstandard.ZstdCompressor(level=bands.LEVEL)
    raw = np.random.default_rng(2).bytes(5000)
    assert not bands.verdict(raw, press)[4] and bands.verdict(noise.encode(), press)[0] < 1.3


@pytest.mark.parametrize("n", [257, 384, 385, 500, 1024, 1025, 4096, 4097, 16384, 16385, 60000])
def test_incompressible_text_is_rejected(n):
    press, rng = bands.zstandard.ZstdCompressor(level=bands.LEVEL), np.random.default_rng(n)
    lines = lambda raw: b"\n".join(raw[k : k + 76] for k in range(0, len(raw), 76))[:n]
    found = {
        "base64": lines(base64.b64encode(rng.bytes(n))),
        "characters": b" ".join(bytes(rng.integers(33, 127, rng.integers(3, 10), dtype=np.uint8)) for _ in range(n // 3))[:n],
    }
    if n > 4096:  # shorter hex is as dense as prose
        found["hex"] = lines(rng.bytes(n).hex().encode())
    for name, raw in found.items():
        assert len(raw) == n and not bands.verdict(raw, press)[4], name


def repeating(n):
    """Texts that repeat themselves without an equal 5-word window: numbered lines, an edited sentence."""
    lines = " \n".join(f"Entry {k} value {k * 7 % 1000} of item {k * 13 % 997} costs {k * 31 % 500} units" for k in range(1, n // 40 + 2))
    words = "In the early morning all the boats of our harbour lay still".split()
    edits = " ".join(str(k * (at + 3)) if at % 4 == 3 else w for k in range(1, n // 40 + 2) for at, w in enumerate(words))
    return {"lines": lines[:n], "edits": edits[:n]}


@pytest.mark.parametrize("n", [200, 256, 320, 384, 800, 1024, 2500, 4096, 10_000, 16384, 40_000])
def test_text_that_repeats_itself_is_rejected(n):
    press = bands.zstandard.ZstdCompressor(level=bands.LEVEL)
    for name, text in repeating(n).items():
        found = bands.base(text)
        assert found[0] >= 10 and found[4] == 0, name  # the base rules keep it
        ratio, k, _, _, kept = bands.verdict(text.encode(), press)
        assert not kept and ratio > bands.BANDS[k][2], (name, ratio)


def test_prose_is_inside_the_limits(sf):
    press = bands.zstandard.ZstdCompressor(level=bands.LEVEL)
    texts = duckdb.sql(f"select text from '{sf}/documents.parquet' where text is not null").fetchall()
    plain = [(t, bands.base(t)) for (t,) in texts]
    found = [bands.verdict(t.encode(), press) for t, b in plain if len(t.encode()) > 256 and b[0] >= 10 and 100 * b[4] <= 20 * b[0]]
    assert len(found) > 50 and all(kept for *_, kept in found)


def test_the_method_rejects_rows_that_the_base_rules_keep(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    more = [(10**9 + k, text) for k, text in enumerate([*repeating(3000).values(), base64.b64encode(bytes(range(256)) * 9).decode()[:3000], *repeating(300).values()])]
    rng = np.random.default_rng(1)
    more.append((2 * 10**9, " ".join(rng.bytes(6).hex() for _ in range(400))))
    found = bands.measure(docs.unionByName(spark.createDataFrame(more, docs.schema))).where("not base_failed").collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert len(found) > 100 and not any(k for d, k in kept.items() if d >= 10**9) and sum(d >= 10**9 for d in kept) >= 5
    # Brute force: the ratios again, from one-shot compression.
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | dict(more)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        ratio = len(raw) / len(bands.zstandard.compress(raw, bands.LEVEL))
        low, high = next((lo, hi) for most, lo, hi in bands.BANDS if most is None or len(raw) <= most)
        parts = [2048 / len(bands.zstandard.compress(raw[a : a + 2048], bands.LEVEL)) for a in range(0, len(raw) - 2047, 2048)]
        outside = sum(not 1.6 <= x <= 4.0 for x in parts)
        assert r["kept"] == (low <= ratio <= high and outside <= 0.5 * len(parts)), r


def test_held_out_languages(spark, sf):
    docs = table(spark, sf, "documents")
    found = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(languages.bucket() == 1).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.97


def test_languages_of_odd_texts_and_mixtures(spark):
    english, german = "the quick brown fox jumps over the lazy dog and runs", "der schnelle braune fuchs springt ueber den faulen hund"
    train = spark.createDataFrame([(k, english if k % 2 else german, "en" if k % 2 else "de") for k in range(40)] + [(None, "x", "xx"), (99, None, "yy"), (98, "z", None)], "doc_id long, text string, lang string")
    names, model = languages.fit(train)
    assert names == ["de", "en"]
    rows = [(1, english), (2, german), (3, english * 3 + " " + german * 3), (4, None), (5, "12 %%"), (6, ""), (6, ""), (7, "d"), (None, german * 9000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    found = languages.predict(docs, names, model, with_row=True).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and all(r["row"]["score"] == "x" for r in found)
    assert [by[k]["lang_pred"] for k in (1, 2, 4, 5, 6, None)] == ["en", "de", "und", "und", "und", "de"]
    assert by[3]["score"] < 0.75 and by[3]["mixture"].count(":") == 2 and by[1]["score"] == 1.0
    assert languages.fit(train.limit(0)) == ([], None)
    assert {r["lang_pred"] for r in languages.predict(docs, [], None).collect()} == {"und"}


def test_em_matches_a_grid_search():
    rng = np.random.default_rng(3)
    logs, times = np.log(rng.dirichlet(np.ones(60), 2).T), rng.integers(1, 9, 60)
    shares = languages._grow(logs, times, 0, 0.0)
    grid = np.linspace(0, 1, 2001)
    values = [times @ np.log(np.exp(logs) @ [1 - g, g] + 1e-300) for g in grid]
    assert abs(shares[1] - grid[int(np.argmax(values))]) < 0.02


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_arc_records(version):
    records = [(b"http://a.example/x y", b"20040102030405", 7, b"<p>hi\n\nthere"), (b"-", b"200401020304", None, b"")]
    found = list(archives.parse_arc(archives.arc_file(b"n.arc", version, records)))
    assert found[0][1] == b"filedesc://n.arc" and len(found) == 3
    for (url, date, _, payload), (_, got, _, when, kind, block) in zip(records, found[1:], strict=True):
        assert (got, when, kind, archives.split_http(block)[1]) == (url, date, b"text/html", payload)
    pressed = b"".join(zlib.compress(p, wbits=31) for p in (archives.arc_file(b"n.arc", version, records),))
    assert list(archives.parse_arc(pressed)) == found
    for bad in (b"nonsense\n", archives.arc_file(b"n", version, records)[:-5], b"http://x 0 1 text/html 3\nabc\n"):
        with pytest.raises(ValueError):
            list(archives.parse_arc(bad))
    assert archives.iso_date(b"200401020304") == "2004-01-02T03:04:00Z" and archives.iso_date(b"x").startswith("1970")


def test_archive_round_trip(spark, tmp_path):
    long, other = "<p>" + "é long page " * 50, "<p>" + "another page " * 50
    rows = [(5, "http://a/5", long), (3, "http://b/3 x", long), (9, None, long), (4, "u", other), (4, "u", other), (1, "s", "short"), (2, "s", "short"), (6, "n", None), (7, "n", "x" * 100), (8, "n", "x" * 99), (10, "n", "x" * 99), (11, "n", "x" * 100), (12, "dns:x", "\0\r\n\r\nodd")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    found = archives.read(spark, archives.convert(archives.archive(pages, file_bytes=900), str(tmp_path / "w"), file_bytes=900)).where("record_type <> 'warcinfo'").collect()
    assert len(found) == len(rows)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    refers = {5: 3, 9: 3, 11: 7}
    ids = {r["record_id"]: r["key"] for r in found}
    for r in found:
        raw = text[r["key"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", refers[r["key"]]) if r["key"] in refers else ("response", None))
    assert len(ids) == len({r[0] for r in rows})
    empty = archives.convert(archives.archive(pages.limit(0)), str(tmp_path / "e"))
    assert archives.read(spark, empty).collect() == []
    keyless = spark.createDataFrame([(None, "u", long), (None, "u", long), (1, "u", long)], "page_id long, url string, html string")
    got = archives.read(spark, archives.convert(archives.archive(keyless), str(tmp_path / "k"))).where("record_type <> 'warcinfo'").collect()
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in got) == [("response", 0), ("revisit", 1), ("revisit", 1)]


def test_main_text_by_structure():
    page = (
        '<html><head><title>T</title></head><body><header class=site>Site</header><div class="nav-bar">a b</div><article>'
        '<header><h1>Title</h1><p>By me</p></header><p>One &amp; two<br>three<p>Next <aside>no</aside> more</p><div class="ad-slot">'
        'buy</div><ul><li>x<li>y</ul><section id="comments"><p>hi</p></section><!-- c --><script>var a="</p>";</script> tail'
        "</article>after<footer>f</footer></body>"
    )
    assert [t for t, k in maintext.blocks(page) if k == 2] == ["Title", "One & two three", "Next", "more", "x", "y", "tail"]
    assert maintext.blocks("") == [] and maintext.blocks("<p>a<p>b&nbsp;c") == [("a", 1), ("b c", 1)]
    assert maintext.blocks('<a href="x>y">in</a> <b') == [("in <b", 1)]
    assert maintext.blocks("<script>never closed") == [] and maintext.blocks("x<!-- open") == [("x", 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5), st.integers(1, 5))
def test_suffix_groups(pages, run):
    tokens = np.array([t for p in pages for t in p], np.uint64)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    order, first = maintext.suffix_groups(tokens, page, run)
    runs = [tuple(tokens[k : k + run].tolist()) for k in order.tolist()]
    assert runs == sorted(runs) and len(first) == len(set(runs))
    assert len(runs) == sum(max(0, len(p) - run + 1) for p in pages)


def inside(page):
    return [t for t, k in maintext.blocks(page) if k == 2]


def test_articles_in_common_wrappers():
    story = "<article><header class='entry-header'><h1>Title</h1><p>By me</p></header><p>One</p><p class='market-share'>Two</p></article>"
    for before, after in (
        ('<div class="content has-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"), ("<nav><a>Menu</a>", ""), ('<div class="modal-ready">', "</div>"),
        ('<div class="cookie-banner"><p>Cookies</p></div><div id="share-buttons">Share</div>', '<section id="comments"><article><p>Nice</p></article></section>'),
        ('<form><div class="sidebar">', '</div><div class="comments"><article>Late</article></div></form>'),
    ):
        assert inside(f"<body>{before}{story}{after}<footer>f</footer></body>") == ["Title", "One", "Two"], before
    parts, others, article = maintext.judged(maintext.blocks('<article>Teaser</article><div class="post"><p>The whole story is told here</p></div>'))
    assert (parts, others, article) == (["Teaser", "The whole story is told here"], [], False)


def brute_extract(rows, run=maintext.RUN):
    """Runs of tokens that pages of different marks of a host share, found by comparing all pages."""
    pages = []
    for d, url, html in rows:
        parts, others, article = maintext.judged(maintext.blocks(html or ""))
        mark = max(parts, key=len) if article else tuple(w for t in parts + others for w in t.split(" "))
        streams = [[w for t in parts + others for w in t.split(" ")]]
        short = [t.split(" ") + [None] * (run - t.count(" ") - 1) for t in parts if article and 4 <= t.count(" ") + 1 < run]
        runs = {tuple(s[k : k + run]) for s in streams + short for k in range(len(s) - run + 1)}
        pages.append((d, maintext.host_of(url), parts, article, mark, runs))
    found = {}
    for d, host, parts, article, mark, _ in pages:
        shared = set().union(*(r for _, h, _, _, m, r in pages if h == host and m != mark))
        words = [(k, w) for k, t in enumerate(parts) for w in t.split(" ")]
        tail = [w for t in next(maintext.judged(maintext.blocks(h or ""))[1] for e, _, h in rows if e == d) for w in t.split(" ")]
        stream = [w for _, w in words] + tail
        gone = {j for k in range(len(stream) - run + 1) if tuple(stream[k : k + run]) in shared for j in range(k, k + run)}
        left = {k: [w for j, (b, w) in enumerate(words) if b == k and j not in gone] for k in range(len(parts))}
        if not article:
            found[d] = "\n\n".join(" ".join(left[k]) for k in left if left[k])
            continue
        whole = [k > 0 and len(t.split(" ")) >= 4 and (not left[k] or tuple(t.split(" ") + [None] * (run - t.count(" ") - 1)) in shared) for k, t in enumerate(parts)]
        sizes = [t.count(" ") + 1 for t in parts]
        drop = 2 * sum(n for n, w in zip(sizes, whole, strict=True) if w) <= sum(sizes)
        found[d] = "\n\n".join(t for t, w in zip(parts, whole, strict=True) if not (w and drop))
    return found


def test_main_text_against_brute_force(spark, sf):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    shared, notice, share = words(20), words(12), "Share this on X now"
    rows = []
    for k in range(40):
        story = [f"<h1>{words(5)}</h1>", f"<p>{words(60)}</p>", f"<p>{words(30)}</p>"]
        extra = rng.permutation([f"<p>{shared}</p>", f"<p>{share}</p>", "<p>Further reading</p>", f"<p>{words(9)}</p>"])[: rng.integers(0, 5)]
        kind = k % 4
        body = "".join([*story[:2], *extra, story[2]])
        body = f"<article>{body}</article>" if kind < 2 else f"<div>{body}</div>" if kind == 2 else f"<article>{words(4)}</article><div class='post'>{body}</div>"
        rows.append((k, f"http://h{k % 3 if kind > 1 else 0}.example/{k}", f"<body><nav>{notice}</nav>{body}<div>{notice}</div><script>x</script></body>"))
    rows += [(100, rows[0][1], rows[0][2]), (101, "http://h0.example/again", rows[0][2].replace("</article>", f"<p>{words(25)}</p></article>")), (102, "http://h0.example/", None)]
    rows += [(1000 + r["page_id"], r["url"], r["html"]) for r in table(spark, sf, "pages").limit(40).collect()]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, mark string").repartition(4)
    found = {r["page_id"]: r["text"] for r in maintext.extract(pages).collect()}
    wanted = brute_extract(rows)
    assert found == wanted
    articles = [k for k in range(40) if k % 4 < 2]
    assert all(share not in found[k] and shared not in found[k] for k in articles) and any("Further reading" in found[k] for k in articles)
    # An article printed again with one more paragraph keeps all of its text.
    assert rows[0][2].count("<p>") > 1 and found[101].startswith(found[0].split("\n\n")[0]) and found[0].split("\n\n")[1] in found[101]


def test_main_text_by_repetition(spark):
    foot = "All rights reserved by the example company of nowhere today"
    page = lambda k: f"<body><div>word{k} starts the text of page number {k}</div><div>{foot}</div>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(5)]
    rows += [(10, "http://other.example/", page(10)), (11, None, page(11)), (12, "http://h.example/a", f"<article><p>{foot}</article>"), (13, "x", None), (14, "http://twin.example/", page(14)), (15, "http://twin.example/b", page(14)), (15, "http://twin.example/b", "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    found = maintext.extract(pages).collect()
    by = {r["page_id"]: r["text"] for r in found if r["page_id"] != 15}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert all(by[k] == f"word{k} starts the text of page number {k}" for k in range(5))
    assert by[10].endswith(foot) and by[11].endswith(foot) and by[12] == foot and by[13] == ""
    assert by[14].endswith(foot)  # two copies of one page don't make it boilerplate
    assert maintext.extract(pages.limit(0)).collect() == []


def test_page_streams_by_column():
    rows = [(["One two three four five", "a b c d", "x"], ["Menu Öl"], True), ([], [], False), (["a b c d", "two"], ["x y"], False)]
    count = [[t.count(" ") + 1 for t in parts] for parts, _, _ in rows]
    kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.bool_()]
    values = [[r[0] for r in rows], [r[1] for r in rows], count, [sum(t.count(" ") + 1 for t in r[1]) for r in rows], [r[2] for r in rows]]
    hashed = lambda text: [xxhash.xxh64_intdigest(w.encode()) for w in text.split()]
    pad = int(maintext._PAD)
    short = [*hashed("One two three four five"), *[pad] * 3, *hashed("a b c d"), *[pad] * 4]
    expected = [hashed("One two three four five a b c d x Menu Öl") + short, [], hashed("a b c d two x y")]
    columns = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
    assert [s.tolist() for s in maintext.streams_of(*columns)] == expected
    # A part of a column is read as its own rows only.
    assert [s.tolist() for s in maintext.streams_of(*[c.slice(1) for c in columns])] == expected[1:]
