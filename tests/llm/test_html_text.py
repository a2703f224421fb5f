"""Main text of pages: planted pages of several site designs, and odd markup."""

import random

import pytest

from mnemograph.llm import html_text as ht

PAGES = "page_id bigint, url string, html string, host string, salt int, key string"


def run(spark, rows):
    table = spark.createDataFrame([(*r, "h", 1, "k") for r in rows], PAGES)
    return sorted(((r.page_id, r.url, r.text) for r in ht.main_text(table).collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(2, 9))) for _ in range(n))


def plain_site(rng, i):
    """Marked article; menus, adverts and footers differ from page to page."""
    title, paras = prose(rng, 6), [prose(rng, rng.randrange(3, 90)) for _ in range(rng.randrange(1, 9))]
    gold = [title, *paras]
    body = "".join(f"<p>{p}</p>" if rng.random() < .7 else f"<p><b>{p}<br>" for p in paras)
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in prose(rng, 5).split())
    return (f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";'
            f'</script></head><body><nav><ul>{links}</ul></nav><!-- ad {i} --><div class="ad">{prose(rng, 9)}'
            f'</div><article><h1>{title}</h1>{body}</article><footer>&copy; {prose(rng, 12)}</footer>'), gold


def unmarked_site(rng, i):
    """No marks at all: the template tells the text from the rest."""
    paras = [prose(rng, rng.randrange(30, 90)) for _ in range(rng.randrange(2, 7))]
    links = "".join(f'<a href="/{w}">{w}</a> ' for w in prose(rng, 12).split())
    return (f"<html><body><table><tr><td>{links}</td></tr></table><div><p>Subscribers pay nothing for the "
            f"first month of this paper</p></div><div id=x{i}>" + "".join(f"<p>{p}</p>" for p in paras)
            + f"</div><div><p>Printed on paper that was made from old rags in {1900 + i % 7}</p></div>"
            "</body></html>"), paras


def busy_site(rng, i):
    """Everything the text must not hold, in and around a content container."""
    title, paras = prose(rng, 5), [prose(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(2, 6))]
    noise = prose(rng, 10)
    parts = [f"<p>{p}</p>" for p in paras]
    parts.insert(1, f'<div class="ad-slot"><p>{noise}</p></div>')
    parts.append(f'<aside><p>{noise}</p></aside><form><label>{noise}</label><button>Go</button></form>')
    comments = "".join(f'<li class="comment"><p>{prose(rng, 15)}</p></li>' for _ in range(rng.randrange(4)))
    return (f'<html><body class="has-sidebar"><header><h2>{noise}</h2></header><div id="cookie-notice">{noise}</div>'
            f'<div class="menu"><ul><li><a href=/>{noise}</a></ul></div><div class="post-content"><h1>{title}</h1>'
            + "".join(parts) + f'</div><div class="sidebar"><p>{noise}</p></div><section id="comments"><h3>'
            f'Comments</h3><ul>{comments}</ul></section><div class="footer">{noise}</div></body></html>'), \
        [title, *paras]


@pytest.mark.parametrize("broadcast", [True, False])
def test_planted_pages(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ht, "ENTRIES", 0)
    monkeypatch.setattr(ht, "KEYS", 50)
    rng = random.Random(3)
    rows, want = [], []
    for host, make, n in (("plain.org", plain_site, 30), ("one.org", plain_site, 1),
                          ("none.org", unmarked_site, 12), ("busy.org", busy_site, 8)):
        for i in range(n):
            html, gold = make(rng, i)
            row = (len(rows), f"https://{host}/p{i}", html)
            rows.append(row)
            want.append((*row[:2], "\n".join(gold)))
    # Copies on one host: what they share is still their text.
    html, gold = plain_site(rng, 0)
    for i in range(4):
        rows.append((len(rows), f"http://copy.org/{i}", html))
        want.append((*rows[-1][:2], "\n".join(gold)))
    rows.append(rows[0])                                        # a repeated row
    want.append(want[0])
    assert run(spark, rows) == sorted(want, key=str)


def test_odd_pages(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    cases = [
        (None, ""), ("", ""), ("   ", ""), ("no markup at all", "no markup at all"),
        ("<article>a &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9;&nbsp;x\n\t y</article>", "a <b> &amp; ééé x y"),
        ("<article>1 < 2 <3 a<b>c</b>d<br>e</article>", "1 < 2 <3 acd e"),
        ("<article><p>one<p>two<ul><li>three<li>four</ul>five", "one\ntwo\nthree\nfour\nfive"),
        ("<article><!-- <p>no</p> --><p title='a > b'>yes</p><script>if (a</b) {}</script>", "yes"),
        ("<article><p>open <!-- never closed", "open"), ("<article><p>cut <a href='x", "cut"),
        ("<ARTICLE><P CLASS=x>up</P></ARTICLE><FOOTER>no</FOOTER>", "up"),
        ("<main><p>kept</p><nav>no</nav></main><p>outside</p>", "kept"),
        ("<article><header><h1>head</h1><p>by me</p></header><p>text</p></article>", "head\ntext"),
        ("<article class='comment'><p>c</p></article><article><p>t</p></article>", "t"),
        ("</p></div></article><article><p>stray ends</p></article>", "stray ends"),
        (f"<article><p>{long}</p></article>", long),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ]
    urls = [f"http://h{i}.org/" if i % 3 else None if i % 2 else "not an address" for i in range(len(cases))]
    rows = [(None if i == 4 else i, u, h) for i, (u, (h, _)) in enumerate(zip(urls, cases))]
    want = [(r[0], r[1], text) for r, (_, text) in zip(rows, cases)]
    assert run(spark, rows) == sorted(want, key=str)
    assert run(spark, []) == []


def test_classes_have_equal_vectors_and_nest(spark):
    """Against plain counting over the pages of one host."""
    rng = random.Random(9)
    pages = [busy_site(rng, i)[0] for i in range(10)]
    counts = [{} for _ in pages]
    for c, page in zip(counts, pages):
        for item in ht.parsed(page):
            key = item if isinstance(item, int) else item.key if not item.noise else 0
            if key:
                c[key] = c.get(key, 0) + 1
    vectors = {k: tuple(c.get(k, 0) for c in counts) for c in counts for k in c}
    table = spark.createDataFrame([(i, "http://a.b/", p) for i, p in enumerate(pages)],
                                  "page_id bigint, url string, html string")
    rows = table.withColumn("host", ht.host_of(table.url))
    found = ht.classes(ht.tokens(rows)).collect()
    assert len(found) == 1
    tokens = [i for p in pages for i in ht.parsed(p)]
    texts = {b.key for b in tokens if not isinstance(b, int)}
    groups = {}
    for k, v in vectors.items():
        share = sum(map(bool, v)) / len(pages)
        if sum(map(bool, v)) > 1 and share >= (ht.FIXED if k in texts else ht.SUPPORT):
            groups.setdefault(v, []).append(k)
    want = {k: min(g) for g in groups.values() if len(g) > 1 for k in g}
    assert dict(zip(found[0].keys, found[0].classes)) == want
