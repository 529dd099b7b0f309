"""Operators on pages and embeddings against brute force, on whole small tables and on odd rows."""

import collections
import hashlib
import math
import random
import re
import struct
import time

import numpy as np
import pytest
import zstandard

from sieveworks.llm import embeddings, html_text, url_filter, warc
from sieveworks.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, host string, tree string, digest string, rule string, payload binary"


def query(spark, n, sf=SF):
    return next(f for k, f in QUERIES.items() if k.startswith(f"op{n}_"))(spark, sf)


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def odd_pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "d", "r", None) for r in rows], PAGE)


# URL filters.


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    spam = any(w in re.split(r"[^a-z0-9]+", host) for w in url_filter.SPAM_WORDS)
    return host, path, None, "block" if spam else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.net?x=/y", "https://a.b.Example.NET/en/x?q#f", "https://example.net/EN/", "http://xexample.com/de/", "http://example.com/de", "http://example.com/de/1",
    "http://w.org/fr/", "http://spam-farm.example.org/es/1", "http://a.adult-x.example.com/fr/", "ftp://x.org/fr/a://b.net/", "a:b://c.net/", "http://u@h.net:80/", "http://é.net/ü", "http://x.net/a\nb", "http://spammer.org/", "x" * 70_000 + "://y.net/",
]


def test_url_verdicts(spark, pages):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in query(spark, 1).collect()}
    assert got == {p: plain_verdict(u) for p, (u, _) in pages.items()}
    df = odd_pages(spark, [(i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[4], None), (4, URLS[4], None)])
    rows = url_filter.judge(df, URL_RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(URLS[r.page_id]), URLS[r.page_id]
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    index = {r.rule: r.token for r in url_filter.index_rules(spark, URL_RULES).collect()}
    assert index["org/fr/"] in ("org", "fr") and index["example.com/de/"] in ("com", "de") and index["*spam*"] == "spam"
    assert url_filter.Rule.prefix("x.org/ab", "block").tokens == ("x", "org")


# Embeddings.


def brute_vectors(vectors, cosine):
    ids = [i for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(v)]
    x = np.array([np.array(v, np.float64) / np.linalg.norm(v) for i, v in vectors if i in set(ids)])
    near = x @ x.T >= cosine
    out = {i: (0, i) for i, _ in vectors}
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    for k, i in enumerate(ids):
        out[i] = (int(near[k].sum()) - 1, ids[label[k]])
    return out


def test_embeddings_equal_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in query(spark, 2).collect()}
    assert got == brute_vectors(rows, 0.95)


def test_embedding_groups_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + rng.standard_normal(16) * 0.02).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(70)] + [(400, (np.array(rows[1][1]) * 1e-30).tolist())]
    rows += [(500 + i, rng.standard_normal(16).tolist()) for i in range(60)]
    bad = [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [float("inf")] + [1.0] * 15), (605, [None] + [1.0] * 15)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "vec_id long, embedding array<double>, cls int, key string")
    result = embeddings.near_duplicates(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in result}
    assert got == brute_vectors(rows + bad, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in result)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(null_id).collect()) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_recall_of_pairs_at_the_threshold(spark, monkeypatch):
    """400 pairs with a cosine of 0.9502, apart from all others."""
    monkeypatch.setattr(embeddings, "SLICE", 16)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        a, b = rng.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9502
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    # One in a thousand may be missed.
    assert sum(got[2 * i] == got[2 * i + 1] == 1 for i in range(400)) >= 397


def test_step_probability():
    rng = np.random.default_rng(1)
    x = np.array([1.0, 0.0])
    y = np.array([np.cos(0.5), np.sin(0.5)])
    a, b = rng.standard_normal((2, 200_000)), rng.uniform(0, 2, 200_000)
    same = (np.floor((x @ a + b) / 2) == np.floor((y @ a + b) / 2)).mean()
    assert same == pytest.approx(embeddings.agree(float(np.linalg.norm(x - y))), abs=0.005)


# WARC.


def brute_records(pages):
    first = {}
    for p, (_, html) in pages.items():
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(p, first.get(data, p))
    out = {}
    for p, (_, html) in pages.items():
        data = (html or "").encode()
        f = first.get(data, p)
        out[p] = (len(data), hashlib.sha256(data).hexdigest(), "response" if f == p else "revisit", None if f == p else f)
    return out


def test_warc_round_trip(spark, pages, tmp_path):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in query(spark, 7).collect()}
    assert got == brute_records(pages)
    long = "<p>é" * 200
    odd = [(1, None, None), (2, "http://x/\r\nX: y", ""), (3, "u", long), (4, "u", long), (5, "ü", "short"), (6, "v", "short"), (7, "w", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "z", "x" * 300_000)]
    df = odd_pages(spark, odd)
    path = str(tmp_path / "archives")
    warc.write_archives(df.repartition(2), path, warc.train_dictionary(df))
    rows = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert {p: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for p, r in rows.items()} == brute_records({p: (u, h) for p, u, h in odd})
    assert all(bytes(r.payload) == (h or "").encode() for p, _, h in odd if (r := rows[p]).record_type == "response")
    assert rows[2].url == "http://x/%0D%0AX:%20y" and rows[1].url is None
    null_id = odd_pages(spark, [(None, "a", long), (None, "b", long), (9, "c", long), (9, "c", long)])
    warc.write_archives(null_id, str(tmp_path / "nulls"), b"")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, str(tmp_path / "nulls")).collect()) == [(0, "revisit", 9), (0, "revisit", 9), (9, "response", 0), (9, "response", 0)]
    warc.write_archives(df.limit(0), str(tmp_path / "none"), b"")
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_archives_have_one_frame_for_each_record(spark, pages, tmp_path):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    dictionary = warc.train_dictionary(df)
    warc.write_archives(df.coalesce(1), str(tmp_path / "a"), dictionary)
    (file,) = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-")]
    data = file.read_bytes()
    assert struct.unpack("<I", data[:4])[0] == 0x184D2A5D and dictionary
    records = list(warc.archive_records(data))
    assert len(records) == len(pages) and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    # Any decoder that knows the dictionary reads the archive as one stream.
    size = struct.unpack("<I", data[4:8])[0]
    given = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert zstandard.ZstdDecompressor(dict_data=given).stream_reader(data[8 + size :], read_across_frames=True).read() == b"".join(records)


def test_damaged_archives_are_refused():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert [warc.parse_record(r)["page_id"] for r in warc.archive_records(frame + frame)] == [1, 1]
    for bad in (frame[:-5], frame + b"x" * 9, b"\0" * 20):
        with pytest.raises(ValueError):
            list(warc.archive_records(bad))
    for bad in (good[:-1], good.replace(b"payload\r", b"pAyload\r"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# HTML.


def plain_article(page):
    """What the made-up pages hold in their article, cut out by their own markup."""
    import html as htmllib

    m = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1])
    blocks = [" ".join(htmllib.unescape(re.sub(r"<[^>]+>", " " if "br" in x else "", x)).split()) for x in (re.sub(r"<br>", " ", p) for p in parts)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_give_their_articles(spark, pages):
    rows = query(spark, 10).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id][1]) and r.n_chars == len(r.text) and r.url == pages[r.page_id][0]


def wrapped(i, body, same=False):
    words = " ".join(f"w{(0 if same else i)}x{k}" for k in range(12))
    return (
        f"<html><head><title>T{i}</title></head><body><header><a href=/>Site {i}</a></header><div class='cookie-notice'>We use cookies {i}</div><div id=sidebar><p>Hot {i}</div>"
        f"<main><p class=byline>Follow us on our channels</p>{body.format(words=words, i=i)}<form><p>Your mail {i}</form></main><div id='comments'><p>Nice {i}!</div><footer>&copy; {i}</footer></body></html>"
    )


def test_template_is_learned_and_content_kept(spark):
    body = "<h1>Title {i}</h1><p>A&nbsp;&amp; {words}<br>more<p><!-- no -->Second   {i} <b>bold</b><script>x()</script></p><aside>Ad {i}</aside><ul><li>one {i}<li>two</ul>"
    rows = [(i, f"http://a.example.org/{i}", wrapped(i, body)) for i in range(12)]
    out = {r.page_id: r.text for r in html_text.main_text(odd_pages(spark, rows)).collect()}
    for i in range(12):
        words = " ".join(f"w{i}x{k}" for k in range(12))
        assert out[i].split("\n\n") == [f"Title {i}", f"A & {words} more", f"Second {i} bold", f"one {i}", "two"]


def test_host_of_copies_keeps_its_article(spark):
    rows = [(i, "http://b.example.org/", wrapped(1, "<p>{words}</p>", same=True)) for i in range(20)]
    assert {r.text.split("\n\n")[-1] for r in html_text.main_text(odd_pages(spark, rows)).collect()} == {" ".join(f"w0x{k}" for k in range(12))}


def test_pages_without_landmarks_and_odd_markup(spark):
    div = "<div class=menu><a href=1>Home {i}</a></div><div><p>Always the same words here</p></div><div class=text><p>Body {i} {i}</p></div>"
    rows = [(i, "http://c.example.org/x", f"<body>{div.format(i=i)}</body>") for i in range(8)]
    assert {r.page_id: r.text for r in html_text.main_text(odd_pages(spark, rows)).collect()} == {i: f"Body {i} {i}" for i in range(8)}
    odd = [(1, None, None), (2, None, ""), (3, "u", "just text &lt;3"), (4, "u", "<p>open <b>bold<p>next <i>it"), (5, "u", "<script>x"), (6, "u", "<div " * 500), (7, "u", "</p></div>end<"), (8, "u", "<p>" + "word " * 100_000), (None, "u", "<p>x"), (9, "u", "<div>" * 3000 + "deep")]
    got = sorted((r.page_id or 0, r.text[:20], r.n_chars) for r in html_text.main_text(odd_pages(spark, odd)).collect())
    assert [g[:2] for g in got] == [(0, "x"), (1, ""), (2, ""), (3, "just text <3"), (4, "open bold\n\nnext it"), (5, ""), (6, got[6][1]), (7, "end<"), (8, "word word word word "), (9, "deep")]
    assert html_text.main_text(odd_pages(spark, odd).limit(0)).count() == 0


def brute_matching(a, b, x=0, y=0):
    """The heaviest simple tree matching by plain recursion: (equal texts, elements) of its pairs."""
    if a.keys[x] != b.keys[y]:
        return 0
    xs, ys = a.kids[x], b.kids[y]
    rows = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, u in enumerate(xs):
        for j, v in enumerate(ys):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + brute_matching(a, b, u, v))
    return 1 + rows[-1][-1]


def test_alignment_is_simple_tree_matching(monkeypatch):
    one = html_text.tree_of("<article><h1>A</h1><p>x</p><h2>B</h2><p>y</p></article>")
    two = html_text.tree_of("<article><h1>C</h1><h2>D</h2><p>z</p><ul><li>q</ul></article>")
    seen = html_text.Aligner(one, two).matched()
    assert [two.keys[seen[i]] if i in seen else None for i in range(len(one.keys))] == ["html", "article", "h1", None, "h2", "p"]
    rng = random.Random(3)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else rng.choice('abcdefghij') * 3}</{t}>" for t in rng.choices(["div", "section", "p"] if depth else ["p", "h2"], k=rng.randint(1, 4)))

    for cells in (html_text.CELLS, 4):
        monkeypatch.setattr(html_text, "CELLS", cells)
        for _ in range(60):
            a, b = html_text.tree_of(page(2)), html_text.tree_of(page(2))
            aligner = html_text.Aligner(a, b)
            assert aligner.size(a.shapes[0], b.shapes[0]) == brute_matching(a, b)
            seen = aligner.matched()
            assert all(a.keys[i] == b.keys[j] for i, j in seen.items()) and len(set(seen.values())) == len(seen)
            assert sorted(seen) == [i for i, _ in sorted(seen.items(), key=lambda p: p[1])]


def test_long_and_deep_lists_are_aligned_in_full():
    one = html_text.tree_of("<body>" + "".join(f"<div>text {i}</div>" for i in range(900)) + "</body>")
    two = html_text.tree_of("<body>" + "".join(f"<div>text {i}</div>" for i in range(1800) if i % 3) + "</body>")
    seen = html_text.Aligner(one, two).matched()
    assert sum(one.digests[i] == two.digests[j] for i, j in seen.items()) == 1 + 600
    deep = [html_text.tree_of("<body>" + "<div>" * 5000 + f"<p>deep {i}") for i in range(2)]
    assert len(html_text.Aligner(*deep).matched()) == 5002
    assert html_text.Tree.load(deep[0].dump()).shapes == deep[0].shapes


@pytest.fixture(scope="module")
def bare_pages(spark):
    """Pages of large hosts without any landmark: all sectioning elements are plain div, classes are gone."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()]
    hosts = collections.Counter(u.split("/")[2] for _, u, h in rows if u and h)
    rows = [(i, u, h) for i, u, h in rows if u and h and hosts[u.split("/")[2]] >= 12]
    return [(i, u, h, re.sub(r" (?:class|id)=\"[^\"]*\"", "", re.sub(r"(</?)(?:article|nav|footer|header|aside)\b", r"\1div", h))) for i, u, h in rows]


def test_wrappers_find_the_article_without_landmarks(spark, bare_pages):
    assert len(bare_pages) > 1000 and not any(re.search(r"article|nav|footer|class=", h) for *_, h in bare_pages)
    out = {r.page_id: r.text for r in html_text.main_text(odd_pages(spark, [(i, u, bare) for i, u, _, bare in bare_pages])).collect()}
    wrong = [i for i, _, h, _ in bare_pages if out[i] != plain_article(h)]
    assert wrong == []


def worded(i, n=14):
    return " ".join(f"v{i}k{k}" for k in range(n))


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_text.main_text(odd_pages(spark, rows)).collect()}


def test_constant_siblings_are_found_by_alignment(spark):
    notice = "<p>Please read our terms before you go on</p>"
    # Among its kind and in changing places; the least page lacks both; one text is in a plain div.
    paras = [[f"<p>{worded(10 * i + k)}</p>" for k in range(3)] for i in range(16)]
    body = ["".join(p if i == 0 else [*p[: i % 3], notice, *p[i % 3 :]]) for i, p in enumerate(paras)]
    inside = [(i, "http://d.example.org/", f"<body><article><h1>Title {worded(i)}</h1>{body[i]}</article></body>") for i in range(16)]
    plain = [(100 + i, "http://e.example.org/", f"<body>{'' if i == 0 else '<div>Terms of use hold here</div>'}<div>{worded(900 + i)}</div><div>{worded(950 + i)}</div></body>") for i in range(16)]
    out = texts_of(spark, inside + plain)
    for i in range(16):
        assert out[i].split("\n\n") == [f"Title {worded(i)}", *(worded(10 * i + k) for k in range(3))]
        assert out[100 + i].split("\n\n") == [worded(900 + i), worded(950 + i)]


def test_near_copies_do_not_turn_articles_into_template(spark):
    parts = [worded(k, 40).split() for k in range(4)]

    def version(i):
        new = [[f"new{i}" if j % 13 == i % 13 and k == i % 4 else w for j, w in enumerate(p)] for k, p in enumerate(parts)]
        return ["One title for all", "A quote that stays as it is", *(" ".join(p) for p in new)]

    def page(texts, holder):
        return f"<body><{holder}><h1>{texts[0]}</h1><blockquote>{texts[1]}</blockquote>{''.join(f'<p>{t}</p>' for t in texts[2:])}</{holder}></body>"

    few = {i: ("f", "article", version(i)) for i in range(4)}
    plain = {100 + i: ("g", "div", version(i)) for i in range(9)}
    others = {200 + i: ("h", "div", version(i) if i < 80 else [f"Title {worded(i)}", worded(700 + i), worded(800 + i)]) for i in range(84)}
    made = few | plain | others
    out = texts_of(spark, [(i, f"http://{h}.example.org/", page(t, holder)) for i, (h, holder, t) in made.items()])
    assert out == {i: "\n\n".join(t) for i, (_, _, t) in made.items()}


def test_only_whole_attribute_names_count(spark):
    tags = [
        'style="overflow:hidden"', 'title="hidden gem"', "data-hidden='false'", "data-role=navigation", 'data-class="sidebar"', 'data-id = "comments"', 'alt="class=ad"', "title='id=footer role=form'",
        "href=/x?id=sidebar", "data-x=a,class=ad", 'aria-label="role=menu hidden"', "aria-hidden=false", "x:hidden", 'title="a"data-hidden="1"',
    ]
    listed = ["hidden", "HIDDEN=''", "aria-hidden = true", 'role="navigation"', "class=ad", "CLASS = 'x sidebar'", 'title="a"id="comments"', "data-x=1 hidden/"]
    out = texts_of(spark, [(i, f"http://{i}.example.org/", f"<body><div {t}><article><p>Kept text</article></div></body>") for i, t in enumerate(tags + listed)])
    assert [i for i, t in sorted(out.items()) if t != "Kept text"] == list(range(len(tags), len(tags) + len(listed)))


@pytest.mark.parametrize("page", ["x <a " * 200_000, '<a "' * 200_000 + "'>", "<![CDATA[>" * 100_000, "<!x" * 300_000, "<b>" * 50_000 + "<hr>" * 50_000, "<b>" * 50_000 + "<td>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "&#" + "9" * 1_000_000, "<a" * 500_000, '<p class="' * 100_000, "<" * 1_000_000, "&" * 1_000_000, "<script " * 100_000])
def test_no_markup_holds_up_the_parser(page):
    start = time.monotonic()
    html_text.extract(page, [])
    assert time.monotonic() - start < 60


def test_what_begins_no_tag_is_text():
    assert html_text.extract("<p>1 <a and 2 <b", []) == "1 <a and 2 <b"
    assert html_text.extract('<p>x <a title="y> z</p>', []) == 'x <a title="y> z'
    assert html_text.extract("<p>x <![CDATA[> y <!-- no", []) == "x y"
    assert html_text.extract("<p>a <![CDATA[b < c]]> d <e", []) == "a b < c d <e"
    assert html_text.extract("<p>&#" + "9" * 5000 + ";", []) == "�"


def test_headings_that_recur_inside_articles_stay(spark):
    words = lambda k, n: " ".join(f"word{k}x{i}" for i in range(n))
    html = "<body><nav><a href='/'>Home</a></nav><article><h1>Dish {0}</h1><h2>Ingredients</h2><p>{1}</p><h2>Method</h2><p>{2}</p><p>Written by the kitchen.</p></article></body>"
    rows = [(k, f"https://food.example/{k}", html.format(k, words(k, 20), words(k + 100, 30))) for k in range(16)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Ingredients" in r.text and "Method" in r.text for r in got)


def test_equal_parts_of_two_pages_are_matched_at_once(monkeypatch):
    from sieveworks.llm import html_text as H

    nav = "<nav><div><div><p>one</p><p>two</p></div><div><p>three</p></div></div></nav>"
    a, b = (H.tree_of(f"<body>{nav}<article><h1>{t}</h1><p>{t} x</p></article>{nav}</body>") for t in ("first", "second"))
    asked = []
    paired = H.Aligner.paired
    monkeypatch.setattr(H.Aligner, "paired", lambda self, xs, ys: asked.append(len(xs)) or paired(self, xs, ys))
    assert H.Aligner(a, b).matched() == {i: i for i in range(len(a.keys))}
    # The children of body and of article only.
    assert sorted(asked) == [2, 3]


def test_text_between_marks_that_are_no_tags():
    from sieveworks.llm import html_text as H

    page = "<P CLASS='Side Bar' hidden>a < b <3 &lt;c<![CDATA[ <d> ]]><![cdata[no]]><!-- x > --><b>e</b></i> 1 <"
    p = H.parse(page).children[0]
    assert (p.tag, p.cls, p.role) == ("p", "side bar", "hidden")
    assert H.blocks([p], False) == ["a < b <3 <c <d> e 1 <"]
    assert H.blocks([H.parse("a <b c <i>d</i> <em e")], False) == ["a d <em e"]
