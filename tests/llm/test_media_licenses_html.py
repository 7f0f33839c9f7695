import hashlib
import html as html_lib
import os
import random
import re
import struct
import time
from zlib import crc32

import pytest

from spanloom.llm import html_extract, licenses, media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1, 576 * 128, 576 * 200 + 3])
def test_media_round_trip(n):
    raw = os.urandom(n)
    data = media.store(media.padded(raw))
    track = media.read(data)
    back = media.payload(data, track)
    assert back[:n] == raw and set(back[n:]) <= {255} and len(back) == max(576, -(-n // 576) * 576)
    frames = len(back) // 576
    assert (track.codec, track.width, track.height, track.timescale, track.duration) == ("raw ", 24, 24, 25, frames)
    assert track.keys.tolist() == list(range(0, frames, 12))
    for k in track.keys:
        assert data[track.starts[k] : track.starts[k] + 576] == back[k * 576 : (k + 1) * 576]


def test_media_other_layouts():
    """Samples of several sizes, out of order in the file, 64-bit offsets and a box up to the end."""
    parts = [b"aaa", b"bb", b"cccc", b"d"]
    body = parts[2] + parts[3] + parts[0] + parts[1]
    entry = media.box(b"twos", struct.pack(">6xH16xHHIIIH32xHh", 1, 3, 5, 0, 0, 0, 1, 40, -1))

    def movie(base):
        offsets = struct.pack(">QQ", base + 5, base)
        tables = media.box(
            b"stbl",
            media.full(b"stsd", struct.pack(">I", 1), entry),
            media.full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, 2, 1)),
            media.full(b"stsz", struct.pack(">II", 0, 4), struct.pack(">IIII", 3, 2, 4, 1)),
            media.full(b"co64", struct.pack(">I", 2), offsets),
        )
        head = media.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 10, 40, 0, 0), version=1)
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", head, media.box(b"minf", tables))))

    base = len(movie(0)) + 8
    data = movie(base) + struct.pack(">I4s", 0, b"mdat") + body
    track = media.read(data)
    assert media.payload(data, track) == b"".join(parts) and track.duration == 40 and track.keys.tolist() == [0, 1, 2, 3]
    assert (track.codec, track.width, track.height) == ("twos", 3, 5)


def test_media_damaged():
    data = media.store(media.padded(b"x" * 5000))
    for cut in range(0, len(data), 37):
        row = media.probe(data[:cut])
        assert row[8] == cut
    rng = random.Random(2)
    for _ in range(300):
        broken = bytearray(data)
        for _k in range(5):
            broken[rng.randrange(700)] = rng.randrange(256)
        media.probe(bytes(broken))


def test_media_damaged_counts_and_nesting():
    """Deep nests and counts beyond the file give no error, no large arrays and no track."""
    import tracemalloc

    nest = b""
    for _ in range(3000):
        nest = media.box(b"moov", nest)
    data = media.store(media.padded(b"x" * 5000))
    at = data.index(b"stsz") + 8
    huge = [data[:at] + struct.pack(">II", size, n) + data[at + 8 :] for size in (0, 1, 576) for n in ((1 << 32) - 1, 1 << 31, len(data) + 1)]
    for kind, first in ((b"stsc", 12), (b"stsc", 16), (b"stts", 8), (b"stss", 8), (b"stco", 8)):
        k = data.index(kind) + first
        huge.append(data[:k] + b"\xff" * 4 + data[k + 4 :])
    tracemalloc.start()
    assert media.read(nest) is None and media.probe(nest)[8] == len(nest)
    for broken in huge[:9]:
        assert media.read(broken) is None
    for broken in huge:
        media.probe(broken)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    # a second, sound track stands in for a damaged first
    k = data.index(b"trak") - 4
    size = struct.unpack_from(">I", data, k)[0]
    both = media.box(b"moov", huge[0][k : k + size], data[k : k + size])
    track = media.read(both + data[len(both) :] if len(both) < len(data) else both)
    assert track is None or track.codec == "raw "


def test_media_fragments():
    """A file in movie fragments: defaults of the file, of the fragment and of the run."""
    frames = [bytes([65 + k]) * (5 + k % 3) for k in range(7)]
    entry = media.box(b"twos", struct.pack(">6xH16xHHIIIH32xHh", 1, 3, 5, 0, 0, 0, 1, 40, -1))
    tables = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), entry), media.full(b"stsz", bytes(8)), media.full(b"stsc", bytes(4)), media.full(b"stco", bytes(4)))
    head = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0))
    track_head = media.full(b"tkhd", struct.pack(">III", 0, 0, 9) + bytes(68))
    data = media.box(b"moov", media.box(b"trak", track_head, media.box(b"mdia", head, media.box(b"minf", tables))), media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 9, 1, 4, 5, 0x10000))))

    def fragment(samples, columns, header=b"", flags=0):
        def movie(offset):
            run = media.full(b"trun", struct.pack(">Ii", len(samples), offset), struct.pack(">I", 0), columns, flags=0x5 | flags)
            other = media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 3)), media.full(b"trun", struct.pack(">I", 2)))
            return media.box(b"moof", other, media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 9), header, flags=0x8 if header else 0), run))

        return movie(len(movie(0)) + 8) + media.box(b"mdat", *samples)

    first, second = frames[:4], frames[4:]
    data += fragment(first, b"".join(struct.pack(">I", len(f)) for f in first), flags=0x200)
    data += fragment(second, b"".join(struct.pack(">II", 7, len(f)) for f in second), struct.pack(">I", 2), flags=0x300)
    track = media.read(data)
    assert media.payload(data, track) == b"".join(frames) and track.keys.tolist() == [0, 4]
    assert (track.codec, track.timescale, track.duration) == ("twos", 10, 4 * 4 + 3 * 7)
    for cut in range(0, len(data), 7):
        media.probe(data[:cut])


def test_media_documents(spark):
    texts = [(1, "é" * 300), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' AS media", "1 AS feature")
    rows = media.probe_media(media.store_documents(df, keep=df.columns), keep=("doc_id", "n_bytes")).collect()
    for (doc, text), r in zip(texts, rows, strict=True):
        raw = (text or "").encode()
        pay = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (doc, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), crc32(pay[-32:]))
        assert r.keyframes[0].end - r.keyframes[0].start == 576
    assert rows[1].media_sha256 == rows[2].media_sha256 == rows[3].media_sha256
    assert media.probe_media(media.store_documents(df.limit(0))).count() == 0


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_license_base_fuzz():
    index, rng = licenses.build_index(), random.Random(3)
    pieces = ["CC", "by", "BY", "General", "public", "license", "License", "all", "rights", "reserved", "é", "cc by", "x9", "K"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "-", ", ", "\n", "\x00"]) for _ in range(rng.randint(0, 25)))
        words = licenses.file_words(text)
        places, _ = licenses.scan_words(words, index)
        assert (len(words), sorted(places)) == plain_places(text)


def test_license_labels():
    scan = lambda t: licenses.scan_text(t, licenses.build_index())
    for label, text, _ in (*licenses.TEMPLATES, *licenses.FULL_TEXTS):
        got = scan(f"Some words before. {text.upper()} and words after")
        assert label in got[5].split(",") and got[6] == 1.0
    assert scan("Ungte mit. Die license of the bus was released under the tree, with rights to copy software")[5] == ""
    edited = licenses.TEMPLATES[2][1].replace("documentation files", "documentation").split()
    assert "mit" in scan(" ".join(edited))[5] and 0.7 <= scan(" ".join(edited))[6] < 1
    assert scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc")


def test_license_words_are_the_files_own():
    """A template is found by the rarest of its words that the file has: it may lose its rarest ones, shift, and stand among others, wherever it is."""
    rng = random.Random(6)
    base = licenses.build_index()
    for label, text, keys in licenses.FULL_TEXTS:
        words = licenses.file_words(text)
        needed = {w for k in keys for w in k.split()}
        rarest = sorted((w for w in set(words) if w not in needed), key=lambda w: (-base.idf[w], w))[:2]
        edited = [w for w in words if w not in rarest]
        for _ in range(2):
            edited.insert(rng.randrange(len(edited)), "edited")
        keep = all(f" {k} " in f" {' '.join(edited)} " for k in keys)
        found = licenses.scan_words(["lorem"] * 5000 + edited + ["ipsum"] * 5000, base)[1]
        assert (label in found) or not keep, label
    # how rare words are in a corpus decides what is looked up, not what is found
    other = licenses.build_index(frequencies={w: rng.randrange(1000) for w in base.postings}, documents=1000)
    for _ in range(300):
        parts = [rng.choice((" ".join(rng.sample(sorted(base.postings), 30)), rng.choice(licenses.FULL_TEXTS)[1], rng.choice(licenses.TEMPLATES)[1], "cc by general public license")) for _ in range(3)]
        words = licenses.file_words(" ".join(parts))
        one, two = (licenses.scan_words(words, index) for index in (base, other))
        assert sorted(one[0]) == sorted(two[0]) == plain_places(" ".join(words))[1]
        assert {k for k, v in one[1].items() if v == 1.0} == {k for k, v in two[1].items() if v == 1.0}


def test_license_word_frequencies(spark):
    df = spark.createDataFrame([("cc by CC",), ("by the",), (None,), ("",)], "text string").repartition(3)
    assert licenses.word_frequencies(df, frozenset(("cc", "by", "gnu"))) == ({"cc": 1, "by": 2}, 4)
    assert licenses.word_frequencies(df.limit(0), frozenset(("cc",))) == ({}, 0)


def test_license_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in licenses.op7_rare_token_index(spark, sf_dir).collect():
        n, found = plain_places(docs[r.doc_id])
        starts = [s for _, s in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({k for k, _ in found})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "cc by " * 40_000)], "doc_id long, text string").selectExpr("*", "7 AS score")
    rows = licenses.scan_documents(odd, keep=odd.columns).collect()
    assert [(r.n_words, r.n_base, r.score) for r in rows] == [(0, 0, 0.0), (0, 0, 0.0), (80_000, 40_000, 1.0)]
    assert licenses.scan_documents(odd.limit(0)).count() == 0


def test_html_pages(spark, sf_dir):
    """Against a plain reading of the article element."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = html_extract.op10_equivalence_classes(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        m = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]*(>|$)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", m[1] if m else "")]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_html_single_page():
    ex = lambda page: html_extract.extract(page)[0]
    assert ex("") == "" and ex("plain &amp; simple &eacute; &#x41;") == "plain & simple é A"
    page = """<body class="has-sidebar"><header>Site</header><div id=cookie-notice>Accept</div><main><article class="post"><header class="entry-header"><h1>Title  here</h1></header>
    <p>One<b> bold</b> a&nbsp;b<br>line<p>Two <a href="x">link</a> text<script>var a = "<p>no</p>";</script><ul><li>item 1<li>item 2</ul><style>p{}</style><form>Search <input></form>
    <aside>Side</aside><div class="ad-slot ad">Buy</div><section class="comments"><p>First!</p></section><p hidden>secret</p></article><article class="teaser"><p>Read more</p></article></main><footer>(c)</footer>"""
    assert ex(page).split("\n\n") == ["Title here", "One bold a b line", "Two link text", "item 1", "item 2"]
    assert ex("<div><p>text <b>open<p>next</div><p>cut off <") .split("\n\n") == ["text open", "next", "cut off <"]
    assert ex("<p>a</p><!-- <p>b</p> --><p>c &lt;d&gt;</p><!-- open <p>e</p>") == "a\n\nc <d>"
    assert ex("<" * 20_000 + "<div>" * 5_000 + "deep") .endswith("deep")


def test_html_template_without_names(spark):
    """Nothing names the parts: shared text goes, also in a host with most pages; lone hosts keep theirs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(60):
        body = [" ".join(word() for _ in range(12)) for _ in range(rng.randint(1, 4))]
        markup = f"<div class=x1><a href=/>Home</a> <a href=/b>Other</a></div><div class=x2>Welcome to our pages</div><div class=x3>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=x4><a href=/{i}>{word()} {word()}</a></div><div class=x5>All content is ours</div>"
        rows.append((i, "http://big.example/p", markup, "\n\n".join(body)))
    rows.append((100, "http://small.example/", "<div>Welcome to our pages</div>", "Welcome to our pages"))
    rows += [(101, None, None, ""), (102, "odd", "", ""), (102, "odd", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_extract.extract_pages(df).collect())
    assert got == sorted((r[0], r[3]) for r in rows)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_copies_on_a_host(spark):
    """Copies of a page and repeated rows are one page: they make no template; an article's passages stay however many pages share them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    copy = "<div class=a><p>first words of it</p><p>second words of it</p></div><div class=b>third words</div>"
    rows = [(i, "http://copies.example/p", copy, "first words of it\n\nsecond words of it\n\nthird words") for i in range(6)]
    rows += [(10, "http://again.example/p", copy, rows[0][3])] * 5
    for i in range(8):
        own = " ".join(word() for _ in range(8))
        for k in range(1 + (i < 4) * 5):
            shared = ["<p>shared one</p><p>shared two</p>", ""][i % 2]
            rows.append((100 + 10 * i + k, "http://named.example/p", f"<div>Menu</div><article>{shared}<p>{own}</p></article><div>Menu end</div>", ("shared one\n\nshared two\n\n" if shared else "") + own))
        # a row repeated an even number of times must not cancel out
        rows += [(200 + i, "http://plain.example/p", f"<div class=m>Welcome here</div><div class=x><p>{own}</p></div><div class=e>All content is ours</div>", own)] * (2 if i < 4 else 1)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for parts in (1, 5):
        got = sorted((r.page_id, r.text) for r in html_extract.extract_pages(df.repartition(parts)).collect())
        assert got == sorted((r[0], r[3]) for r in rows)


def test_html_raw_elements_without_end():
    """A head, picture or frame without its end tag takes no text after it along; scripts and styles do, as in HTML."""
    ex = lambda page: html_extract.extract(page)[0]
    body = "<article><p>one</p>{}<p>two</p></article><p>menu</p>"
    for head in ("<head><title>t</title>", "<html><head><meta charset=x><title>t</title><script>if (a) '<div>no</div>'</script><link rel=y><style>p{}</style>", "<head><title>t</title></head>", "<title>t</title>", "<HEAD lang='a'><TITLE>t</TITLE><body class=b>"):
        assert ex(head + "<body>" + body.format("")) == ex(head + body.format("")) == "one\n\ntwo", head
        assert ex(head + "<p>plain").split("\n\n") == ["plain"], head
    for odd in ("<svg width='1'/>", "<svg/>", '<math alttext="a>b" />', "<svg><path d='x'/></svg>", "<svg width=1/>", "<svg>", "<iframe src='x'>", "<iframe src=http://a.example/>frame</iframe>", "<object data=x>", "<select>", "<noscript>", "<video src=x />", "<script src='x'/>", "<script>no</script >", "<title>", "<svg />" + "<svg>no</svg>"):
        assert ex(body.format(odd)) == "one\n\ntwo", odd
    for to_the_end in ("<script>", "<style media='x'>", "<textarea>"):
        assert ex(body.format(to_the_end)) == "one"
    assert ex("<video-list><p>one</p></video-list><select-box>two</select-box>") == "one\n\ntwo"
    assert ex("<object>" * 50_000 + "text" + "<svg>" * 50_000).endswith("text")


def test_html_article_in_parts():
    """All articles of a page, or else all its content elements, are kept in page order; asides, teasers and comments go."""
    ex = lambda page: html_extract.extract(page)[0]
    parts = "<p>menu</p><{0}><p>one</p></{1}><p>between</p><{0}><p>two, which is longer</p><{0}><p>inner</p></{1}><p>end</p></{1}><{0}><p>three</p></{1}>"
    for tag in ("article", "div class=content", "section itemprop=articleBody"):
        assert ex(parts.format(tag, tag.split()[0])).split("\n\n") == ["one", "two, which is longer", "inner", "end", "three"], tag
    assert ex("<main><article><p>one</p></article><article class=teaser><p>no</p></article><article class=comment><p>no</p></article><aside><article><p>no</p></article></aside><article><p>two</p></article></main>") == "one\n\ntwo"


def bare(page: str) -> str:
    """The page without any name that says what its parts are."""
    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")


def test_html_template_decides(spark, sf_dir, monkeypatch):
    """Without a single name in the markup the templates give the texts that the names give, by broadcast and by salted join."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [r for r in pages.collect() if r.url]
    # addresses of the small table have few pages each: put them on three hosts
    rows = [(r.page_id, f"http://host{i % 3}.example/{i}", r.html) for i, r in enumerate(rows)]
    schema = "page_id long, url string, html string"
    named = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect()}
    unnamed = spark.createDataFrame([(i, u, bare(h)) for i, u, h in rows], schema)
    for limit in (html_extract.BROADCAST_TOKENS, 0):
        monkeypatch.setattr(html_extract, "BROADCAST_TOKENS", limit)
        got = html_extract.extract_pages(unnamed).collect()
        assert len(got) == len(rows) and all(r.decided == "template" for r in got)
        assert all(r.text == named[r.page_id].text for r in got)


def test_html_few_pages_and_mirrors(spark):
    """Hosts of one to five pages; one article under many addresses and markups; repeated rows; columns with names of results."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for n in range(1, 6):
        for i in range(n):
            body = [" ".join(word() for _ in range(30)) for _ in range(rng.randint(1, 3))]
            rows.append((f"http://n{n}.example/{i}", f"<body><div><a href=/>Home</a> <a href=/{i}>{word()}</a></div><div id=x><h1>{body[0][:9]}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div></body>", "\n\n".join([body[0][:9].strip(), *body])))
    # the same article in pages that differ in their menus only, and in nothing
    text = ["mirrored words of the first part", "and of the second part"]
    for i in range(6):
        rows.append((f"http://mirror.example/{i}", f"<body><div><a href=/{i}>{word()}</a></div><div id=x>{''.join(f'<p>{t}</p>' for t in text)}</div></body>", "\n\n".join(text)))
        rows.append((f"http://same.example/{i}", f"<body><div id=x>{''.join(f'<p>{t}</p>' for t in text)}</div></body>", "\n\n".join(text)))
    rows += rows[:9]
    df = spark.createDataFrame([(i, u, h, "mine", 7) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert len(got) == len(rows)
    for i, (u, _, want) in enumerate(rows):
        assert got[i].text == want, (u, got[i])
    assert {got[i].decided for i, (u, *_) in enumerate(rows) if "n1." in u or "same" in u} == {"names"}
    assert {got[i].decided for i, (u, *_) in enumerate(rows) if "n5." in u or "mirror" in u} == {"template"}


def test_html_misleading_names(spark):
    """Cards of links that call themselves articles do not stand for the article, which nothing names."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(12):
        body = [" ".join(word() for _ in range(40)) for _ in range(3)]
        cards = "".join(f"<article><a href=/{k}>{word()} {word()}</a></article>" for k in range(rng.randint(2, 5)))
        rows.append((i, "http://cards.example/", f"<div id=top>{cards}</div><div id=text>{''.join(f'<p>{b}</p>' for b in body)}</div>", "\n\n".join(body)))
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("markup", ["<span>{n}</b>", "<span>{n}<div></div>", "<div>x", "<ul><li>x", "<a href=x>", "</p>x"])
def test_deep_and_stray_markup_takes_linear_time(markup):
    n = 200_000
    page = "".join(part * n for part in markup.split("{n}"))
    started = time.monotonic()
    tokens, blocks, parents = html_extract.parse(page)
    layout = html_extract.Layout(page, html_extract.NOTHING)
    layout.open_text()
    assert len(layout.depths()) == len(parents) + 1 and len(tokens) == len(parents)
    assert time.monotonic() - started < 30  # quadratic walks took a minute for a tenth of it
    assert sum(b.text.count("x") for b in blocks) == (0 if "href" in page else page.count("x"))


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://h/a", "<p>one</p>"), (1, "http://h/a", "<p>one</p>"), (None, None, None)], "page_id long, url string, html string")
    got = html_extract.extract_pages(pages.selectExpr("*", "'x' AS text", "'y' AS host", "1 AS id", "2 AS tokens", "3 AS page", "4 AS decided")).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == [("1", "http://h/a", "one"), ("1", "http://h/a", "one"), ("None", "None", "")]
