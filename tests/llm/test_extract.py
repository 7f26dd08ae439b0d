"""Page text: planted pages with and without article markup, the alignment against a plain table, ranges against one list."""

import random
import re

from voxframe.llm import extract

SCHEMA = "page_id long, url string, html string, key string, text int"


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_longest():
    draw = random.Random(1)
    for _ in range(400):
        a, b = ([draw.randrange(draw.choice((2, 5, 30))) for _ in range(draw.randrange(30))] for _ in "ab")
        for bits in (1, 40, 10**9):
            got = extract.common(a, b, bits)
            assert got == sorted(set(got)) and len(got) == plain_lcs(a, b)
            rest = iter(b)
            assert all(any(a[i] == y for y in rest) for i in got)
    assert len(extract.common([1, 2] * 4000, [2, 1] * 4000, 10**6)) == 7999


def text(page):
    lines = extract.lines_of(page)
    return " ".join(t for (t, *_), k in zip(lines, extract.chosen(lines), strict=True) if k)


def test_markup_alone():
    body = "<h1>A title</h1><p>First <b>par</b>t &amp; more&nbsp;x.<p>Second\n\n line<br>broken <i>in<b>line</i>"
    want = "A title First part & more x. Second line broken inline"
    around = [
        f"<nav><ul><li><a href=/>Home</a></ul></nav><article>{body}</article><footer>&copy; x</footer>",
        f"<header><h2>Site</h2></header><main><article>{body}<aside>see also</aside><section class='comments'><p>me too</p></section></article></main>",
        f"<div class=\"cookie-notice\">We use cookies</div><div class='post-content'>{body}</div><div id=sidebar>Links</div>",
        f"<body class='has-sidebar'><div id='site-header'>Name</div><main>{body}</main><form><label>Mail</label><input></form>",
        f"<script>var t='<p>no</p></article>';</script><style>p{{}}</style><article>{body}<div class='ad-slot'>Buy</div><div hidden>x</div></article>",
        f"<!-- <article>no</article> --><div class=wrap><article class='post'>{body}",
        f"<div class='sidebar-left'><p>teaser</p></div><article>{body}<div class=share>Tweet</div></article><article class='comment'><p>Reader</p></article>",
        f"<article><header>{body}</header><footer>Filed under x</footer><section id='comments'><article><p>No</p></article></section></article>",
        f"<div class=ad>Unclosed<article>{body}</article>",
        f"<ARTICLE>{body}</ARTICLE><p style='display: none'>gone</p><noscript>Turn it on</noscript>",
        f"<title>A > b</title><article>{body}</article><p title='a>b'>outside</p><p title=it's>outside</p>",
    ]
    for page in around:
        assert text(page) == want, page
        assert text(page.replace("<p>", "<p class='x'\n>")) == want
    assert text("") == "" and text("just words &lt;p&gt; &#233;&#x41;") == "just words <p> éA"
    assert text("a < b and c > d <3 <") == "a < b and c > d <3 <"
    assert text("<article></article><p>Only this</p>") == "Only this"
    # a page that ends within a tag, a comment, a script or a reference
    for cut in ("<p clas", "</arti", "<a href='x", "<!-- note", "<script>var a = '<p>more</p>'"):
        assert text(f"<article><p>Said so far {cut}") == "Said so far", cut
    assert text("<article><p>Said so far &am") == "Said so far &am"
    # names of other attributes, and what stands in their values, tell nothing
    assert text("<article><p data-id='comments' title='the hidden gem' alt=\"class='ad'\">Here</p><p data-role='alert'>and here</p></article>") == "Here and here"
    assert text("<article>" + "<b>x " * 20000) == " ".join("x" * 20000)
    assert isinstance(text("<p a='" * 20000), str) and isinstance(text("<" * 20000 + "<!--" * 9), str)


def site(draw, pages=40):
    """Pages without any telling markup: a template's lines, numbered, around a story of each page's own."""
    vocab = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    say = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    rows = []
    for h in range(3):
        top, bottom = [say(5), say(30)], [say(8), say(14)]
        for i in range(pages):
            story = [say(draw.choice((6, 20, 40))) for _ in range(draw.choice((2, 5)))] + [say(20)]
            page = "".join(f"<div>{x}</div>" for x in [*top, *story, *bottom])
            rows.append((100 * h + i, f"https://Host{h}.example.com/a/{i:03d}?x={i}", f"<html><body>{page}", " ".join(story)))
    return rows


def one_list(rows):
    """What the operator does, over one sorted list."""
    keyed = []
    for i, u, h in rows:
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", re.match("[^?#]*", u or "")[0])
        lines = extract.lines_of(h or "")
        take = extract.chosen(lines)
        key = "\0".join((host, path, u or "", "" if i is None else str(i)))
        page = extract.Page(key, [t for t, *_ in lines], [t if k else "" for (t, *_), k in zip(lines, take, strict=True)], take, [z < extract.IN_MAIN and p for _, z, p, _ in lines])
        keyed.append((key, str(h), i, u, page))
    keyed.sort(key=lambda x: x[:2])
    out = []
    for k, (_, _, i, u, page) in enumerate(keyed):
        t, gone = extract.main_text(page, keyed[k - 1][4] if k else None, keyed[k + 1][4] if k + 1 < len(keyed) else None)
        out.append((i, u, t, len(t), gone))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in extract.extract_text(df, **more).collect()), key=str)


def test_shared_lines_go(spark):
    rows = site(random.Random(5))
    found = {r[0]: r[2] for r in got(spark, [r[:3] for r in rows])}
    assert all(found[i] == story for i, _, _, story in rows)


def test_copies_keep_their_text(spark):
    story = "<p>" + "</p><p>".join(" ".join(f"w{i}x{j}" for j in range(25)) for i in range(5)) + "</p>"
    plain = [(i, f"http://h/{i}", f"<div>Menu here</div>{story}") for i in range(3)]
    marked = [(10 + i, f"http://g/{i}", f"<div>Menu here</div><article>{story}<div>Share it now</div></article>") for i in range(3)]
    apart = [(20, "http://g/20", "<article><p>Another text of some length here it is, long enough</p><div>Share it now</div></article>"), (21, "http://g/21", "<article><p>And this is a text too, not the other one, as you may see</p><div>Share it now</div></article>")]
    found = {r[0]: r[2] for r in got(spark, plain + marked + apart)}
    want = " ".join(" ".join(f"w{i}x{j}" for j in range(25)) for i in range(5))
    assert [found[i] for i in range(3)] == ["Menu here " + want] * 3
    assert found[10] == want + " Share it now" and found[12].startswith(want)
    assert "Share" not in found[20] and "Share" not in found[21] and "Another text" in found[20]


def test_ranges_do_not_show(spark):
    rows = [r[:3] for r in site(random.Random(7), 25)]
    rows += [(None, None, "<p>x</p>"), (900, None, None), (901, "", ""), (902, "no url at all", "<article>y"), rows[3], rows[3], (903, rows[4][1], rows[5][2]), (904, "//Host1.example.com", "<div>z</div>")]
    want = one_list(rows)
    for per in (3, 10, 10**6):
        assert got(spark, rows, per_range=per) == want
    assert got(spark, []) == []
