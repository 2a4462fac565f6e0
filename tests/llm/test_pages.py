"""Main text of pages: known shapes, templates, odd rows."""

import html
import random
import time

import pytest

from lodestone.llm import pages as P
from tests.llm.helpers import words

SCHEMA = "page_id long, url string, html string, host string, token string, text string"


def page(rng, body, host="a.example", shape=0):
    nav = "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav>"
    text = "".join(f"<p>{html.escape(b)}</p>" for b in body)
    if shape == 0:
        return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{nav}<!-- ad --><div class=\"ad\">Buy {rng.random()}</div><article><h1>{html.escape(body[0])}</h1>{text}</article><footer>&copy; {host}</footer></body></html>"
    if shape == 1:
        return f"<html><body><header><b>Site</b></header><div id='cookie-notice'>We use cookies</div><div class='content has-sidebar'><main>{text}<section class=\"comments\"><p>{rng.random()} I disagree</p></section></main><aside>Other</aside></div></body>"
    return f"<div class=menu>Home</div><div class=body><div>Share this</div>{text}</div><form>Name <input name=n> <textarea>x</textarea></form><div role=contentinfo>Imprint</div>"


def want(body, shape):
    return "\n".join(" ".join(b.split()) for b in (([body[0]] if shape == 0 else []) + body))


def test_shapes(spark):
    rng = random.Random(1)
    rows, known = [], {}
    for i in range(120):
        shape = i % 3
        body = [words(rng, rng.randint(3, 30)) + rng.choice((" a < b & c", " §5 é", "")) for _ in range(rng.randint(1, 6))]
        rows.append((i, f"https://h{shape}.example/{i}", page(rng, body, shape=shape), None, None, None))
        known[i] = want(body, shape)
    got = {r.page_id: (r.text, r.n_chars) for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: t for i, (t, _) in got.items()} == known  # 'Share this' stands on all pages of h2: template text
    assert all(n == len(t) for t, n in got.values())


def test_one_page():
    cases = {
        "": "",
        "plain text": "plain text",
        "<p>a<br>b<p>c&nbsp;d &lt;e&gt; &#233;&amp": "a b\nc d <e> é&",
        "<article><header><h1>Own</h1></header><p>x<b>y</b>z</p></article><p>outside</p>": "Own\nxyz",
        "<div hidden>no</div><div style='display: none'>no</div><p>yes": "yes",
        "<script>a<b</script><noscript>n</noscript><svg><text>s</text></svg>ok": "ok",
        "<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>": "one\ntwo\nc1\nc2",
        "<p>cut off <a hre": "cut off",
        "<!-- open comment <p>x": "",
    }
    for source, text in cases.items():
        assert P.main_text(source) == text, source


def test_words_do_not_take_articles():
    for tag in ('article class="share-price"', 'main id="side-effects"', 'article class="legal news"', 'div class="search-history"', 'section class="alert-systems"'):
        source = f"<body><nav><a href=x>Home</a></nav><{tag}><h1>Title here</h1><p>The story text is here and goes on.</p><p>More of it.</p></{tag.split()[0]}><footer>foot</footer>"
        assert P.main_text(source) == "Title here\nThe story text is here and goes on.\nMore of it.", tag


def test_deep_and_long_pages():
    began = time.perf_counter()
    assert P.main_text("<div>" * 40_000 + "text here") == "text here"
    assert P.main_text("<div class=a><p>one two</p>" * 20_000).count("one two") == 20_000
    assert time.perf_counter() - began < 30


def test_odd_rows(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x", "y", "z"), (2, "http://h/1", "", None, None, None), (3, "no url", "<p>t", None, None, None), (None, "http://h/2", "<p>u", None, None, None), (4, "http://h/3", long, None, None, None)]
    rows += [(5, "http://same/1", "<p>again</p>", None, None, None)] * 12
    got = sorted(((r.page_id, r.text, r.n_chars) for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got.count((5, "again", 5)) == 12
    assert (4, "\n".join(["word word"] * 20_000), 200_000 - 1) in got
    assert {(1, "", 0), (2, "", 0), (3, "t", 1), (None, "u", 1)} <= set(got)
    assert P.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joined_template(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_TOKENS", 0)
    rng = random.Random(2)
    bodies = {i: [words(rng, 12) for _ in range(3)] for i in range(20)}
    rows = [(i, "https://h2.example/", page(rng, b, shape=2), None, None, None) for i, b in bodies.items()]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: want(b, 2) for i, b in bodies.items()}


def test_copies_are_one_page(spark):
    rng = random.Random(3)
    body = [words(rng, 12) for _ in range(3)]
    rows = [(5, "http://same/1", "<p>again</p>", None, None, None)] * 12
    rows += [(100 + i, f"https://h2.example/{i}", page(rng, body, shape=2), None, None, None) for i in range(13)]  # under other ids and urls
    rows += [(7, "http://one/1", "<h1>title</h1><div>text</div>", None, None, None)] * 9 + [(8, "http://one/2", "<h1>other</h1><ul><li>x</ul>", None, None, None)]
    got = sorted((r.page_id, r.text) for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect())
    copied = "\n".join(["Share this", *(" ".join(b.split()) for b in body)])
    assert got == [(5, "again")] * 12 + [(7, "title\ntext")] * 9 + [(8, "other\nx")] + [(100 + i, copied) for i in range(13)]


def test_template_beside_copies(spark):
    rng = random.Random(4)
    bodies = {i: [words(rng, 12) for _ in range(3)] for i in range(20)}
    rows = [(i, "https://h2.example/", page(rng, b, shape=2), None, None, None) for i, b in bodies.items()]
    rows += rows[:1] * 40
    got = {(r.page_id, r.text) for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, want(b, 2)) for i, b in bodies.items()}


def layouts(rng):
    """Hosts whose class names say nothing, each with its pages and their main text."""
    out = {}
    for i in range(14):
        body = [words(rng, rng.randint(15, 60)) for _ in range(rng.randint(2, 7))]
        title, text = words(rng, 5), "".join(f"<p>{x}</p>" for x in body)
        menu = "<div class=c1>" + "".join(f"<a href=/{k}>Item {k}</a> " for k in range(5)) + "</div>"
        related = "<div class=c3>" + "".join(f"<a href=/{k}>{words(rng, 4)}</a> " for k in range(4)) + "</div>"
        comments = "".join(f"<div class=k><b>{words(rng, 2)}</b><p>{words(rng, rng.randint(4, 14))}</p></div>" for _ in range(rng.randint(0, 4)))
        whole = "\n".join([title, *body])
        made = {
            "classes": f"<html><body>{menu}<div class=c2><h1>{title}</h1>{text}</div>{related}<div class=c4>{comments}</div></body></html>",
            "intro": f"<body><nav>x</nav><div id=wrap><h1>{title}</h1><div class=i>{body[0]}</div><div class=r>{''.join(f'<p>{x}</p>' for x in body[1:])}</div><div class=q>{words(rng, 6)}</div></div>",
            "table": f"<table><tr><td class=l><a href=/>home</a><br><a href=/a>about us</a></td><td class=m><h2>{title}</h2>{text}</td><td class=r>{words(rng, 9)}</td></tr></table><p>Imprint</p>",
            "form": f"<body><form action=x><div class=t>Menu</div><div class=b><h1>{title}</h1>{text}</div></form></body>",
            "constant": f"<body><div class=x><p>Share this page now</p><h1>{title}</h1>{text}<p>Sign up for our letter today and get more news from us</p></div></body>",
            f"single{i}": f"<html><body>{menu}<div class=c2><h1>{title}</h1>{text}</div>{related}<div class=c4>{comments}</div></body></html>",
        }
        for host, source in made.items():
            out.setdefault(host, []).append((source, whole))
    return out


@pytest.fixture(scope="module")
def hosts():
    return layouts(random.Random(6))


def rows_of(hosts):
    rows = [(h, source, text) for h, pages in hosts.items() for source, text in pages]
    return [(i, f"https://{h}.example/{i}", source, text) for i, (h, source, text) in enumerate(rows)]


def test_hosts_without_speaking_names(spark, hosts):
    rows = rows_of(hosts)
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {i: text for i, _, _, text in rows}
    alone = {i for i, _, source, _ in rows if P.main_text(source) != got[i]}
    assert {i for i, url, _, _ in rows if "constant" in url} <= alone  # only the template tells constant text


def test_repeated_rows_change_nothing(spark, hosts):
    rows = [r[:3] for r in rows_of(hosts)]
    schema = "page_id long, url string, html string"
    once = {(r.page_id, r.text) for r in P.extract(spark.createDataFrame(rows, schema)).collect()}
    twice = [(r.page_id, r.text) for r in P.extract(spark.createDataFrame(rows * 2, schema)).collect()]
    assert set(twice) == once and len(twice) == 2 * len(rows)


def test_class_of_two_orders_is_no_template(spark):
    """Two texts that stand on every page but in either order are no class, so they stay."""
    rng = random.Random(9)
    rows = []
    for i in range(12):
        two = ["<p>first constant words of this page</p>", "<p>second constant words of this page</p>"]
        text = "".join(f"<p>{words(rng, 40)}</p>" for _ in range(1 + i % 3))
        rows.append((i, f"https://h.example/{i}", f"<body><div>{''.join(two if i % 2 else two[::-1])}{text}</div></body>"))
    got = [r.text for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all("first constant" in t and "second constant" in t for t in got)
