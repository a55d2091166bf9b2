import base64
import hashlib

from strandlake.llm import html, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "page_id long, url string, html string, size long, digest string, text string")


ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First   para\n of text.<br><p>Second one with <a href=x>a link</a> &lt;in&gt; it.</p><ul><li>one<li>two</ul></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></li></ul></nav><!-- note --><header>Site head</header>
<div class="cookie-notice">We use cookies, a long and tedious notice about them that goes on and on.</div><div class="ad">Buy now</div>
{ARTICLE}<aside>Side</aside><section id="comments"><p>A reader's comment that is quite long, longer than the article's parts even.</p></section>
<form><input name=q><label>Search</label></form><footer>&copy; me</footer></body></html>"""
TEXT = "Title & more\nFirst para of text.\nSecond one with a link <in> it.\none\ntwo"


def test_main_text():
    assert html.main_text(PAGE) == TEXT
    assert html.main_text(PAGE.replace("<article>", '<div class="post"><div>').replace("</article>", "</div></div>")) == TEXT
    assert html.main_text(PAGE[: PAGE.index("<aside>")]) == TEXT
    held = PAGE.replace("<nav>", '<div class="page with-sidebar"><div id="header">Head</div><nav>').replace("<footer>", "</div><footer>")
    assert html.main_text(held) == TEXT


def test_names_and_forms_around_the_main_text():
    body = "<p>" + "Plain words of the story go on. " * 9 + "</p>"
    want = ("Plain words of the story go on. " * 9).strip()
    assert html.main_text(f"<body><form action=x><nav><a href=/>Home</a></nav><article>{body}</article></form>") == want
    assert html.main_text(f"<body><form action=x><div>{body}</div></form>") == want
    for name in ("no-sidebar", "post comments-open", "has-share"):
        assert html.main_text(f"<body><nav>Menu</nav><div class='{name}'>{body}</div><form><label>Search</label>Go</form>") == want
    reader = "<article class='comment'><p>" + "A reader has very much to say about it. " * 30 + "</p></article>"
    for page in (f"<article>{body}</article>", f"<div>{body}</div>", f"<form>{body}</form>"):
        assert html.main_text(f"<body>{page}<section id='comments'>{reader}</section>") == want
    assert html.main_text("<body><div id='comments'><p>All there is.</p></div>") == "All there is."


def test_main_text_of_odd_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == html.main_text("<script>x</script>") == ""
    assert html.main_text("just text &eacute;") == "just text é"
    assert html.main_text("<p>a</p></div></p><p>b") == "a\nb"
    assert html.main_text("<p>unclosed <b>bold <i>both</p><p>next") == "unclosed bold both\nnext"
    deep = "<div>" * 5000 + "<p>deep text</p>"
    assert html.main_text(deep) == "deep text"
    long = "<article>" + "".join(f"<p>paragraph {i} of the long one</p>" for i in range(5000)) + "</article>"
    assert html.main_text(long).count("\n") == 4999


def test_links_lower_the_density():
    assert html.density(1000, 10, 0, 0, 1000, 0) > html.density(1000, 10, 900, 9, 1000, 900) >= 0
    lists = "".join(f"<li><a href=/{i}>Read this linked headline number {i}</a></li>" for i in range(30))
    body = "<div>" + "".join(f"<p>{'Plain words of the story go on here. ' * 8}</p>" for _ in range(3)) + "</div>"
    got = html.main_text(f"<body><div><ul>{lists}</ul></div>{body}</body>")
    assert got.startswith("Plain words") and "headline" not in got


STORY = "Plain words of the story go on. " * 9


def test_what_stands_beside_the_story_stays():
    """Titles, last sentences and blocks whose class merely contains the name of something else."""
    body = f"<div><p>{STORY}</p><p>{STORY}</p></div>"
    page = f"<body><nav>Menu</nav><div><div><h1>The title</h1></div>{body}<div>A closing sentence.</div></div><div>&copy; me</div></body>"
    assert html.main_text(page).split("\n") == ["The title", STORY.strip(), STORY.strip(), "A closing sentence."]
    for name in ("related-work", "side-by-side", "comments-open", "no-ads"):
        for wrap in ("<article>{}</article>", "<div>{}</div>"):
            got = html.main_text("<body>" + wrap.format(f"{body}<div class='{name}'><p>Short but part of it.</p></div>") + "</body>")
            assert got.split("\n")[-1] == "Short but part of it.", (name, wrap)
    for name in ("ad", "ad-300x250", "cookie-notice", "site-footer", "sidebar", "widget sidebar-right", "comment-list", "social share"):
        assert "Short" not in html.main_text(f"<body><article>{body}<div class='{name}'><p>Short but no part of it.</p></div></article></body>"), name
    links = "<div class='related-links'><a href=x>another story</a> <a href=y>and one more</a></div>"
    assert html.main_text(f"<body><article>{body}{links}</article></body>").count("\n") == 1


def test_names_inside_an_article_are_what_it_is_about():
    for part in (
        "<h2 id='comments'>Comments on method</h2>", "<h2 id='notices'>Notices</h2>", "<h3 id='navigation' class='share'>Navigation</h3>", "<section id='sharing'><h2>Sharing</h2><p>How it is shared.</p></section>",
        "<section id='login'><p>How to log in.</p></section>", "<section class='gdpr'><p>What the law says.</p></section>", "<blockquote class='reply'>They said no.</blockquote>", "<p class='notice'>Mind the gap.</p>",
    ):
        for tag in ("article", "main"):
            got = html.main_text(f"<body><nav>Menu</nav><{tag}><p>{STORY}</p>{part}<p>{STORY}</p></{tag}></body>").split("\n")
            assert got[0] == got[-1] == STORY.strip() and len(got) == 2 + part.count("</h") + part.count("</p>") + part.count("</blockquote>"), part
    for part in (
        "<section id='login'><form><input name=u><button>Go</button></form>Log in</section>", "<section id='share'><a href=x>Send it on</a> <a href=y>and on</a></section>", "<section id='comments'><div class='comment'>Well said.</div></section>",
        "<section id='replies'><div><span class='author'>Ann</span> <time>May</time><p>Well said.</p></div></section>",
    ):
        assert html.main_text(f"<body><article><p>{STORY}</p>{part}<p>{STORY}</p></article></body>").split("\n") == [STORY.strip()] * 2, part


def test_copyright_lines_and_second_articles():
    body = f"<p>{STORY}</p>"
    assert html.main_text(f"<div><div>{body}{body}</div><div>&copy; is the sign that stands for it.</div><div>And so on.</div></div><div>&copy; me</div>").split("\n")[2:] == ["\u00a9 is the sign that stands for it.", "And so on."]
    got = html.main_text(f"<body><main><article>{body}{body}</article><article><p>A short second one.</p></article></main><footer>f</footer></body>")
    assert got.split("\n")[-1] == "A short second one."


def test_hostile_markup_takes_time_in_proportion():
    import time

    pages = ["<span>" * 16_000 + "</b>" * 16_000 + "x", "<a " * 60_000, "<a " * 60_000 + ">x", "<i><p>" + "<span>" * 16_000 + "</i>" * 16_000 + "x", "<article>" * 16_000 + "x", "<ul><li>" * 12_000 + "x", "<!--" * 50_000 + "x"]
    for page in pages:
        t = time.time()
        html.main_text(page)
        assert time.time() - t < 4, page[:20]
    assert html.main_text("<p>one</p><p>two <b>bold</b> <a href='x") == "one\ntwo bold"


def test_made_pages_give_back_what_was_put_in():
    """Pages built from known blocks and known junk: the text is the blocks, whatever stands around and between them."""
    import random

    junk = [
        "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li></ul></nav>", "<div class='ad'>Buy this now, it is cheap</div>", "<aside><h3>More</h3><p>Other stories</p></aside>", "<script>var x = '<p>no</p>';</script>",
        "<style>p { color: red }</style>", "<div class='cookie-notice'><p>We use cookies.</p><button>Fine</button></div>", "<form><input name=q><label>Search</label><button>Go</button></form>", "<!-- a note -->", "<div class='share'><a href=x>Send</a></div>",
        "<div class='related-links'><a href=p>One more story</a> <a href=q>and another</a></div>", "<div id='sidebar'>Weather</div>", "<noscript>Turn it on</noscript>",
    ]
    outside = [*junk, "<header><h1>The Daily</h1></header>", "<footer>&copy; us</footer>", "<section id='comments'><article class='comment'><p>First! I liked it very much indeed.</p></article></section>"]
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9)))
    dress = [lambda w: w, lambda w: f"<b>{w}</b>", lambda w: f"<em>{w}</em>", lambda w: f"<a href=/{w}>{w}</a>", lambda w: w + "&amp;", lambda w: "&eacute;" + w, lambda w: f"<span>{w}<!-- x --></span>"]
    plain = [lambda w: w] * 3 + [lambda w: w + "&", lambda w: "\u00e9" + w, lambda w: w]
    order = [0, 1, 2, 4, 5, 6]

    def block(n):
        shown, want = [], []
        for _ in range(n):
            w, k = word(), r.choice([0] * 8 + order)
            shown.append(dress[k](w))
            want.append(plain[order.index(k)](w) if k else w)
        return r.choice([" ", "\n", "  \t"]).join(shown), " ".join(want)

    for _ in range(150):
        parts, want = [], []
        for i in range(r.randrange(3, 9)):
            shown, text = block(r.randrange(15, 60) if i % 3 else r.randrange(2, 7))
            tag = "h2" if i % 3 == 0 else r.choice(["p", "p", "div", "blockquote"])
            parts.append(f"<{tag}>{shown}</{tag}>")
            want.append(text)
            if r.random() < 0.3:
                parts.append(r.choice(junk))
        story = f"<article>{''.join(parts)}</article>"
        for _ in range(r.randrange(3)):
            story = f"<div class='{r.choice(['wrap', 'content', 'page with-sidebar', 'col'])}'>{story}</div>"
        before, after = (r.choices(outside, k=r.randrange(4)) for _ in range(2))
        page = f"<html><head><title>T</title></head><body>{''.join(before)}{story}{''.join(after)}</body></html>"
        assert html.main_text(page) == "\n".join(want), page


def test_controls_in_and_outside_of_text():
    got = html.main_text(f"<article><p>{STORY}</p><p>The <label>term</label> matters, and so does <button>this</button>.</p><button>Share</button><label>Search</label></article>")
    assert got.split("\n")[1:] == ["The term matters, and so does this."]


def test_densities_of_every_node_against_brute_force():
    """Every node's characters, tags, link characters and link tags counted over its whole subtree, and its children's sum."""
    for page in (PAGE, f"<div><p>{STORY}<b>bold <a href=x>and linked</a></b></p><ul><li><a href=y>one</a><li>two <i>three</i></ul></div>tail", "<p>x"):
        tree = html.Tree()
        tree.feed(page)
        tree.close()
        cut = tree.cuts()
        up = lambda i: [i, *up(tree.parents[i])] if i >= 0 else []  # noqa: E731, B023
        size = lambda x: sum(not c.isspace() for c in x)

        def count(i, linked, tree=tree, cut=cut, up=up, size=size):
            inside = [j for j in range(len(tree.tags)) if i in up(j) and not cut[j]]
            own = [j for j in inside if not linked or any(tree.tags[k] == "a" for k in up(j))]
            chars = sum(size(x) for p in tree.pieces if p for j, x in [p] if j in own and not any(tree.tags[k] in html.CONTROLS for k in up(j)))
            return chars, sum(j != i and (not linked or tree.tags[j] == "a") for j in inside)

        everything = [count(i, False) for i in range(len(tree.tags))]
        links = [count(i, True) for i in range(len(tree.tags))]
        want = [0.0 if cut[i] else html.density(*everything[i], *links[i], everything[0][0], links[0][0]) for i in range(len(tree.tags))]
        dense, total = html.densities(tree, cut)
        assert dense == want
        for i in range(len(tree.tags)):
            assert abs(total[i] - sum(want[j] for j in range(len(want)) if tree.parents[j] == i)) < 1e-9


def test_extract_bytes_that_are_not_utf8(spark):
    bad = spark.sql("SELECT 1L AS page_id, 'u' AS url, CAST(unhex('3C703E61FFC3623C2F703E') AS STRING) AS html")
    assert [(r.text, r.n_chars) for r in html.extract(bad).collect()] == [("a\ufffd\ufffdb", 4)]


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "é \U0001f600")]
    out = html.extract(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == sorted([("1", TEXT, len(TEXT))] * 2 + [("2", "", 0), ("None", "", 0), ("3", "é \U0001f600", 3)])
    assert html.extract(pages(spark, [])).collect() == []


def sha(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    texts = ["<p>a</p>", "<p>b ü   \r\n\r\nWARC/1.1\r\n</p>", None, "", "x" * 300_000]
    rows = [(i, f"https://h{i % 7}.example.org/p?q={i}", texts[i % len(texts)]) for i in range(3000)] + [(9000, None, "own"), (9001, "not a url\n\t x", "own 2"), (9002, "http://[bad", "own 3")]
    first = {}
    for i, _, t in rows:
        first.setdefault(t or "", i)
    archive = warc.write(pages(spark, rows))
    got = sorted(tuple(r) for r in archive.records().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = [(i, len((t or "").encode()), sha(t), *(("response", None) if first[t or ""] == i else ("revisit", first[t or ""]))) for i, _, t in rows]
    assert got == sorted(want)
    found = archive.lookup("HTTPS://h3.EXAMPLE.org/p?q=3#frag")
    assert [(h["WARC-Type"], h["X-Page-ID"], p) for h, p in found] == [("revisit", "3", b"")]
    assert archive.lookup("https://h1.example.org/p?q=1")[0][1] == texts[1].encode()
    assert archive.lookup("https://nowhere.example.org/") == []
    assert archive.directory.agg({"lines": "sum"}).first()[0] == len(rows) and "data" not in archive.directory.columns


def test_lookup_bisects_the_directory_and_reads_only_its_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    rows = [(i, f"https://h{i % 90}.example.org/p?q={i % 400}", f"<p>page {i}</p>" * 40) for i in range(1200)]
    archive = warc.write(pages(spark, rows))
    places, plain = [], warc.read_range
    monkeypatch.setattr(warc, "read_range", lambda s, f, at, n: places.append((f, at, n)) or plain(s, f, at, n))
    key = warc.reversed_host_key(rows[37][1])
    want = sorted(i for i, u, _ in rows if u == rows[37][1])
    got = archive.lookup(rows[37][1])
    assert sorted(int(h["X-Page-ID"]) for h, _ in got) == want and all(p.decode() == rows[int(h["X-Page-ID"])][2] for h, p in got)
    assert len(places) == len(want) and sum(n for _, _, n in places) < len(want) * (len(rows[37][2]) + 600)
    blocks = archive.blocks_of(key)
    held = {r.block for r in archive.directory.collect() if r.first_key <= key <= r.last_key}
    assert set(blocks) == held and len(blocks) <= 3 < archive.directory.count()
    monkeypatch.setattr(warc, "DIRECTORY", 0)
    archive._held = None
    assert set(archive.blocks_of(key)) == held


def test_records_are_whole_and_named_once(spark):
    rows = [(1, "http://a.org/x", "<p>é</p>"), (1, "http://a.org/x", "<p>é</p>"), (2, "http://b.org/", "<p>é</p>"), (3, None, None)]
    archive = warc.write(pages(spark, rows))
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(archive.path).collect())
    names, at, kinds = [], 0, []
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        fields = warc.head_of(data[at:head])
        end = head + 8 + int(fields["Content-Length"])
        names.append(fields["WARC-Record-ID"])
        kinds.append(fields["WARC-Type"])
        assert data[head + 4 :].startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"] == "application/http; msgtype=response"
        at = end
    assert len(set(names)) == 4 and sorted(kinds) == ["response"] * 3 + ["revisit"]


def test_warc_of_bytes_that_are_not_utf8(spark):
    bad = spark.sql("SELECT id AS page_id, CAST(unhex('687474703A2F2F612E6F72672FFF') AS STRING) AS url, CAST(unhex('3C703E61FFC3623C2F703E') AS STRING) AS html FROM range(2)")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.write(bad).records().collect())
    raw = base64.b32encode(hashlib.sha1(b"<p>a\xff\xc3b</p>").digest()).decode()
    assert got == [(0, 11, raw, None), (1, 11, raw, 0)]


def test_payloads_shared_by_many_rows_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "REPEATS", 0)
    rows = [(i, f"http://h{i % 5}.org/{i}", "hot" if i % 3 else f"text {i // 6}") for i in range(900)] + [(None, None, "hot"), (5000, None, None)]
    first = {}
    for i, _, t in rows:
        if i is not None:
            first.setdefault(t, i)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.write(pages(spark, rows)).records().collect()), key=str)
    want = [(i, *(("response", None) if i is None or first[t] == i else ("revisit", first[t]))) for i, _, t in rows]
    assert got == sorted(want, key=str)


def test_warc_of_nulls_repeats_and_nothing(spark):
    rows = [(5, "http://a.org/", "same"), (5, "http://a.org/", "same"), (None, "http://a.org/", "same"), (7, "http://b.org/", "same")]
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.write(pages(spark, rows)).records().collect()]
    assert sorted(got, key=str) == sorted([(5, "response", None), (5, "response", None), (None, "response", None), (7, "revisit", 5)], key=str)
    assert warc.write(pages(spark, [])).records().collect() == []


def test_keys_sort_by_reversed_host():
    assert warc.reversed_host_key("https://www.A.b.COM:8080/x?y=1#z") == "com,b,a:8080)/x?y=1"
    assert warc.reversed_host_key(None) == warc.reversed_host_key("") == ")"


def test_lookup_of_escaped_urls(spark):
    rows = [(1, "http://a.com/x y", "one"), (2, "http://a.com/<b>\t", "two"), (3, "http://a.com/x%20y", "three"), (4, None, "four")]
    archive = warc.write(pages(spark, rows))
    found = lambda url: sorted(h["X-Page-ID"] for h, _ in archive.lookup(url))
    assert found("http://a.com/x y") == found("http://a.com/x%20y") == ["1", "3"]
    assert found("http://a.com/<b>\t") == ["2"] and found(None) == ["4"]


def test_archives_where_only_spark_reads(spark, monkeypatch):
    rows = [(i, f"https://h{i % 7}.example.org/p?q={i}", f"<p>{i % 40} ü</p>" * (i % 9)) for i in range(2500)]
    want = sorted(map(str, warc.write(pages(spark, rows)).records().collect()))
    assert [warc._arrow_opens(p) for p in ("file:/tmp/x", "s3a://b/x", "hdfs://h/x", "/tmp/x", "dbfs:/x", "viewfs://c/x")] == [True, True, True, True, False, False]
    monkeypatch.setattr(warc, "_arrow_opens", lambda path: False)
    assert sorted(map(str, warc.write(pages(spark, rows)).records().collect())) == want
