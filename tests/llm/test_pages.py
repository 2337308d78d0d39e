import base64
import hashlib
import random

from pyspark.sql import functions as F

from pricelens.llm import html_text as H
from pricelens.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"salt": F.lit("clash"), "first": F.lit(1), "n": F.lit(2)})


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(1)
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nx\r\n\r\n\n\n"
    body = [None, "", "a", "a", tricky, tricky, "é好" * 1000, "\n" * 50, "\r\n\r\n", "".join(r.choice("ab\r\n") for _ in range(5000))]
    rows = [(i, None if i == 3 else f"http://x/{i}\r\nEvil: 1", b) for i, b in enumerate(body)]
    W.write(pages(spark, rows), str(tmp_path / "w"))
    got = {x.page_id: x for x in W.summary(W.read_chunks(spark, str(tmp_path / "w"))).collect()}
    assert len(got) == len(rows)
    for i, b in enumerate(body):
        raw = (b or "").encode()
        last = max(j for j, c in enumerate(body) if (c or "") == (b or ""))
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want and got[i].digest_ok


def test_chunks_rebuild_payloads_and_carry_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 7)
    body = {1: "abcdefg" * 3, 2: "", 3: "12345678\n9"}
    W.write(pages(spark, [(i, "u", b) for i, b in body.items()]), str(tmp_path / "w"))
    reader_rows = []
    reader = W._Reader(True)
    import glob
    import gzip

    for f in glob.glob(str(tmp_path / "w/*.gz")):
        raw = gzip.open(f).read()
        reader = W._Reader(True)
        for at in range(0, len(raw), 5):
            reader_rows += list(reader.feed(memoryview(raw[at : at + 5])))
    for i, b in body.items():
        own = [r for r in reader_rows if r[0] == str(i)]
        assert b"".join(r[10] for r in own).decode() == b and [r[1] for r in own] == list(range(len(own)))
        assert all(r[2] <= 7 for r in own) and [r[5] for r in own] == [False] * (len(own) - 1) + [True]
        seen = b""
        for r in own:
            seen += r[10]
            assert r[4] == base64.b32encode(hashlib.sha1(seen).digest()).decode()


def test_warc_empty_table_and_repeated_rows(spark, tmp_path):
    W.write(pages(spark, []), str(tmp_path / "e"))
    assert W.read_chunks(spark, str(tmp_path / "e")).count() == 0
    W.write(pages(spark, [(1, "u", "x"), (1, "u", "x"), (0, "u", "x")]), str(tmp_path / "r"))
    got = sorted((x.page_id, x.record_type) for x in W.summary(W.read_chunks(spark, str(tmp_path / "r"))).collect())
    assert got == [(0, "revisit"), (1, "response"), (1, "response")]


def test_warc_rows_without_an_id_and_a_long_payload(spark, tmp_path):
    long = "x" * 1_500_000 + "\n" + "é" * 400_000
    W.write(pages(spark, [(None, "u", "a"), (1, "u", "a"), (2, None, long)]), str(tmp_path / "w"))
    chunks = W.read_chunks(spark, str(tmp_path / "w"))
    got = {str(x.page_id): x for x in W.summary(chunks).collect()}
    assert got["None"].record_type == "revisit" and got["None"].refers_to == 1 and got["1"].record_type == "response"
    assert got["2"].payload_bytes == 2_300_001 and got["2"].payload_digest == base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert [x.n_bytes for x in chunks.where("record_id = '2'").orderBy("chunk").collect()] == [W.CHUNK, W.CHUNK, 2_300_001 - 2 * W.CHUNK]


def test_article_text():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var x="</p>";</script></head><body class="has-sidebar">
    <nav><ul><li><a href=#>Menu</a></li></ul></nav><div class="ad">Buy this now, it is very good.</div><!-- <p>hidden</p> -->
    <article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>text,\n with   spaces.<p>Second&nbsp;one. <br>Line.</p><form><label>Mail</label></form>
    <ul><li>one<li>two</ul><section class="comments"><p>I think so, too.</p></section></article><aside>Side</aside><footer>&copy; x</footer>"""
    assert H.main_text(page) == "Title & more\nFirst boldtext, with spaces.\nSecond one. Line.\none\ntwo"


def test_page_without_article():
    long = "A long paragraph with several words, some commas, and an end. " * 3
    page = f"<body><div id=menu><a>Home</a> <a>News</a></div><div class=content><h2>Head</h2><p>{long}</p><p>{long}</p></div><div class='sidebar'><p>{long}</p></div><div class=links><a>more links here</a></div>"
    assert H.main_text(page) == "\n".join(["Head", long.strip(), long.strip()])


LONG = "A long paragraph with several words, some commas, and an end. " * 3
TEASER = "<article class=card><h3><a href=/x>Other story</a></h3><p>A short teaser.</p></article>"


def test_teasers_in_articles_beside_a_body_in_divs():
    want = "\n".join(["Head", LONG.strip(), LONG.strip()])
    body = f"<div class=story><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div>"
    assert H.main_text(f"<body>{body}<div class=more>{TEASER * 3}</div></body>") == want
    assert H.main_text(f"<body><div class=more>{TEASER * 3}</div>{body}</body>") == want


def test_the_article_around_the_heaviest_path():
    want = "\n".join(["Head", LONG.strip(), LONG.strip()])
    body = f"<h2>Head</h2><p>{LONG}</p><p>{LONG}</p>"
    assert H.main_text(f"<main><article class=story>{body}</article>{TEASER * 3}</main>") == want
    assert H.main_text(f"<main>{body}{TEASER * 3}</main>") == want
    assert H.main_text(f"<main><h1>Top</h1><article>{body}</article></main>") == "Top\n" + want
    assert H.main_text(f"<div role=main>{body}</div><div><p>Short, beside it.</p></div>") == want
    assert H.main_text(f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main>") == "\n".join([LONG.strip()] * 2)


def test_attributes_are_whole_names():
    clean = ['href="/hidden-gems.html"', 'title="The hidden cost"', 'data-id="comment-7"', 'href="/p?id=menu"', "href=/a/id=menu", "title='a class=ad b'", 'data-hidden="x"', 'x-role=search alt="style=display:none"', 'class=story CLASS="ad"']
    for a in clean:
        assert H.main_text(f"<article><p>Before, it.</p><p {a}>The <a {a}>linked</a> text.</p></article>") == "Before, it.\nThe linked text.", a
    for a in ("hidden", "hidden=''", 'id="menu"', "class = 'x ad'", "ROLE=search", 'title="a"class="ad"', "aria-hidden=true", 'style="display: none"', "href=/x hidden"):
        assert H.main_text(f"<article><p>Before, it.</p><p {a}>No text.</p></article>") == "Before, it.", a


def test_broken_pages(spark):
    rows = [None, "", "<", "<p", "<p>x<!-- open", "<script>never closed <p>x", "a & b &am", "<p>" * 3000 + "deep, text.", '<a href="unclosed <p>text</p>', "<div>" * 500 + "x. y, z." + "</div>" * 500]
    d = H.extract(pages(spark, [(i, "u", h) for i, h in enumerate(rows)]))
    got = {x.page_id: x.text for x in d.collect()}
    assert len(got) == len(rows) and got[0] == got[1] == got[5] == "" and got[4] == "x" and got[6] == "a & b &am" and got[7] == "deep, text."
    assert H.extract(pages(spark, [])).count() == 0


def test_wrappers_keep_their_article():
    body = f"<h1>Head</h1><p>{LONG}</p>"
    want = "Head\n" + LONG.strip()
    for open_, close in (('<div class="layout has-sidebar">', "</div>"), ("<div id=main class=comments-closed>", "</div>"), ("<form id=aspnetForm>", "</form>"), ('<div class="page-with-promo sidebar-left">', "</div>")):
        for inner in (f"<article>{body}</article>", f"<div>{body}</div>"):
            assert H.main_text(f"<body><nav><a href=/>Home</a></nav>{open_}{inner}{close}<footer>(c) x</footer></body>") == want, (open_, inner)
    assert H.main_text(f'<article><p class="intro promotion-history">{LONG}</p><p>{LONG}</p></article>') == "\n".join([LONG.strip()] * 2)
    assert H.main_text(f"<article>{body}<div class=comment-list><p>{LONG}</p></div></article>") == want


def test_comments_never_win():
    """However long comments are, beside the article or in it."""
    post, want = f"<p>{LONG}</p><p>{LONG}</p>", "\n".join([LONG.strip()] * 2)
    said = "".join(f"<p>I think that this is so, {i}. {LONG}</p>" for i in range(6))
    names = "comments comments-list comment-thread replies-list reader_comments CommentList disqus_thread fb-comments commentlist comments-section".split()
    for name in names:
        for tag in ("div", "section", "ol"):
            inner = said.replace("<p>", "<li><p>").replace("</p>", "</p></li>") if tag == "ol" else said
            comments = f"<{tag} class={name}>{inner}</{tag}>"
            assert H.main_text(f"<body><article>{post}</article>{comments}</body>") == want, (name, tag)
            assert H.main_text(f"<body><article>{post}{comments}</article></body>") == want, (name, tag)
            assert H.main_text(f"<body><div class=post>{post}</div>{comments}</body>") == want, (name, tag)
            assert H.main_text(f"<body><h1>Top</h1><div class=post>{post}</div>{comments}</body>").endswith(want), (name, tag)


def test_comments_without_a_name():
    post, want = f"<p>{LONG}</p><p>{LONG}</p>", "\n".join([LONG.strip()] * 2)
    nested = "".join(f"<article><p>I think so, {i}. {LONG}</p></article>" for i in range(6))
    assert H.main_text(f"<article>{post}{nested}</article>") == want
    assert H.main_text(f"<main><article>{post}<section>{nested}</section></article></main>") == want
    items = "".join(f"<li><p>Bob, <time>1 May</time></p><p>{LONG}</p></li>" for i in range(6))
    assert H.main_text(f"<article>{post}<ol>{items}</ol></article>") == want
    plain = "".join(f"<li>Bob says: {LONG}</li>" for i in range(6))
    for head in ("Comments", "3 Comments", "Kommentare (3)", "Commentaires", "12 replies", "Comentarios:"):
        assert H.main_text(f"<article>{post}<h2>{head}</h2><ol>{plain}</ol></article>") == want, head
        assert H.main_text(f"<article>{post}<h3>{head}</h3><div>{said_of(6)}</div><h3>More</h3><p>{LONG}</p></article>") == f"{want}\nMore\n{LONG.strip()}", head
    # lists, headings and parts that aren't comments
    assert H.main_text(f"<article><h2>Comments</h2>{post}</article>") == "Comments\n" + want
    assert H.main_text(f"<article>{post}<ol><li><p>One, it.</p></li><li><p>Two, it.</p></li></ol></article>") == want + "\nOne, it.\nTwo, it."
    assert H.main_text(f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main>") == want
    assert H.main_text(f'<body><div class="post comments-open">{post}</div><div class=comments-list>{said_of(9)}</div></body>') == want


def said_of(n):
    return "".join(f"<p>I think that this is so, {i}. {LONG}</p>" for i in range(n))


def test_weights_decide_without_articles(monkeypatch):
    """Length, punctuation, links and smoothing each change what is taken of a page that has neither article elements nor telling names."""
    line, flat = "Some words of no great length", "Plain words without any marks that go on and on for a while"
    page = f"<body><p>{LONG}</p><p>{LONG}</p><div>{line}</div><h4>{flat}</h4><section><a href=/>{flat}, {flat}.</a> {flat}, it.</section><p>{LONG}</p><p>{LONG}</p></body>"
    base = H.main_text(page)
    assert base == "\n".join([LONG.strip()] * 4)
    for name, value in (("THRESHOLD", 1e-9), ("_MARKS", H.re.compile(r"\w"))):
        with monkeypatch.context() as m:
            m.setattr(H, name, value)
            assert H.main_text(page) != base, name
    fused = lambda: [round(w, 6) for w in H.weights(H.blocks(page)[1])[0].values()]
    before = fused()
    monkeypatch.setattr(H, "REACH", 0)
    assert fused() != before


def test_links_and_small_print_in_plain_divs_go():
    page = f"<body><div><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></div><div><h2>Head</h2><p>{LONG}</p><ul><li>a<li>b</ul><p>{LONG}</p></div><div>Copyright 2024 by x</div></body>"
    assert H.main_text(page) == "\n".join(["Head", LONG.strip(), "a", "b", LONG.strip()])
    titled = f"<body><div><h1>Head</h1><div>By x</div><div><p>{LONG}</p><p>{LONG}</p></div></div><div>Copyright 2024 by x</div></body>"
    assert H.main_text(titled) == "\n".join(["Head", LONG.strip(), LONG.strip()])


def test_the_threshold_decides(monkeypatch):
    page = f"<body><h3>Some words</h3><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div>A line, of some length, and no more of it.</div><div>Another, a bit shorter.</div><div>And one.</div></body>"
    got = {}
    for threshold in (0.01, 0.35, 0.9):
        monkeypatch.setattr(H, "THRESHOLD", threshold)
        got[threshold] = H.main_text(page).split("\n")
    assert got[0.35] == ["Some words", *[LONG.strip()] * 4] or got[0.35] == [LONG.strip()] * 4
    assert len(got[0.01]) == 8 and got[0.9] == [LONG.strip()] * 4


def test_path_sums_equal_brute_force():
    """Against another parser, on well-formed pages of random structure."""
    from html.parser import HTMLParser

    r = random.Random(9)

    class Twin(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.sums, self.links = [], {}, 0

        def handle_starttag(self, tag, attrs):
            self.stack.append(tag if not attrs or tag == "a" else f"{tag}.{attrs[0][1]}")

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            path = tuple(x for x in self.stack if x != "a")
            s = self.sums.setdefault(path, [0, 0, 0, 0])
            said = data.strip()
            for k, v in enumerate((len(said), sum(said.count(c) for c in ".,;:!?"), len(said) if "a" in self.stack else 0, 1)):
                s[k] += v

    def element(depth):
        tag = r.choice(["div", "section", "div class=x", "div class=y"])
        inner = "".join(element(depth - 1) if depth and r.random() < 0.6 else leaf() for _ in range(r.randint(1, 4)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def leaf():
        said = " ".join(r.choice(["word", "more,", "end."]) for _ in range(r.randint(1, 12)))
        return f"<p>{said}</p>" if r.random() < 0.7 else f"<p><a href=/>{said}</a></p>"

    for _ in range(40):
        page = f"<body>{element(4)}</body>"
        twin = Twin()
        twin.feed(page)
        tree, found = H.blocks(page)
        names = tree.names()
        assert {names[p]: s for p, s in H.path_sums(found).items()} == twin.sums


def test_broken_and_deep_pages_take_linear_time():
    import time

    for what in ("<a " * 350_000, "<div>x" * 50_000, '<a "' * 250_000, "<b>" * 50_000 + "</i>" * 50_000, "<!" * 500_000, "<li>" * 50_000):
        start = time.time()
        H.main_text(what)
        assert time.time() - start < 4, what[:10]


def test_extract_ties_repeats_and_no_ids(spark):
    page = f"<div class=a><p>{LONG}</p></div><div class=b><p>{LONG}</p></div>"
    rows = [(None, None, page), (3, "u", page), (3, "u", page), (4, "u", "<p>" + "word, " * 200_000 + "</p>")]
    got = H.extract(pages(spark, rows)).collect()
    texts = {x.text for x in got if x.page_id != 4}
    assert len(got) == 4 and len(texts) == 1 and max(x.n_chars for x in got) == 1_199_999
