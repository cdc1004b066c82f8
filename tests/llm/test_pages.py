import math
import re
from html import unescape

import numpy as np
import pytest

from autoprep.llm import hosts
from autoprep.llm.wrappers import aligned, extract_text, folded, infer_wrappers, merged, parse, pattern_of


def text_of(rows, pages):
    out = extract_text(rows([(i, "http://h.net/a", h, "clash") for i, h in enumerate(pages)], "page_id bigint, url string, html string, text string"))
    found = {r.page_id: r for r in out.collect()}
    assert all(r.n_chars == len(r.text) for r in found.values())
    return [found[i].text for i in range(len(pages))]


def test_articles_of_the_pages_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks]
        assert got[r.page_id] == " ".join(b for b in blocks if b)


def test_parts_that_stand_aside_go(rows):
    page = (
        "<!DOCTYPE html><html><head><title>No</title></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>"
        "<div class='cookie-notice'>We use</div><main><h1>Head &amp; more</h1><p>One  <b>bo</b>ld&nbsp;x<br>two<p>Three &lt;p&gt;"
        "<form><input value='v'>Send</form><script>if (a < b) { '</p>' }</script><style>p{}</style><aside>See also</aside>"
        "<div class=comments><p>First!</p></div><ul><li>a<li>b</ul></main><div id='sidebar'>Side</div><!-- <p>no</p> --><footer>Foot</footer></body></html>"
    )
    assert text_of(rows, [page]) == ["Head & more One bold x two Three <p> a b"]


def test_hosts_without_a_main_element_lose_what_all_pages_share(rows):
    pages = [f"<body><div>Same on all pages</div><div><p>Text {i}</p></div></body>" for i in range(6)]
    assert text_of(rows, pages) == [f"Text {i}" for i in range(6)]
    assert text_of(rows, pages[:2]) == [f"Same on all pages Text {i}" for i in range(2)]


def test_edge_cases(rows):
    pages = [None, "", "plain", "<p>open", "</div></p>stray", "<" * 5000, "<a " * 20_000, "<article>" + "<p>x</p>" * 3000 + "</article>"]
    out = text_of(rows, pages)
    assert out[0] == out[1] == "" and out[7] == " ".join(["x"] * 3000)
    schema = "page_id bigint, url string, html string"
    assert extract_text(rows([], schema)).collect() == []
    twice = extract_text(rows([(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "x", "<p>b</p>")], schema)).collect()
    assert sorted(r.text for r in twice) == ["a", "a", "b"]


def test_patterns_fold_repeats_and_align_options():
    part = lambda html: pattern_of(parse(html))
    three = part("<ul><li>a<li>b<li>c</ul>")[3][0][3]
    assert [(p[0], p[2]) for p in three] == [("li", True)] and three[0][3][0][4] is None
    pairs = part("<dl><dt>a<dd>b<dt>c<dd>d</dl>")[3][0][3]
    assert [(p[0], [k[0] for k in p[3]]) for p in pairs] == [("+", ["dt", "dd"])]
    both = aligned(part("<h1>t</h1><p>a</p><hr>")[3], part("<h1>t</h1><h2>s</h2><p>b</p>")[3])
    assert [(p[0], p[1]) for p in both] == [("h1", False), ("h2", True), ("p", False)]
    assert both[0][3][0][4] is not None and both[2][3][0][4] is None
    assert folded([]) == [] and merged(three[0], three[0])[0] == "li"


def test_wrapper_of_a_host(rows):
    pages = [("h", "<p>a</p>"), ("h", "<p>a</p><p>b</p>"), ("g", None)]
    found = {r.host: (r.pattern, r.pages) for r in infer_wrappers(rows([(h, p or "") for h, p in pages], "host string, html string")).collect()}
    assert set(found) == {"g", "h"} and found["h"][1] == 2 and '["p", false, true' in found["h"][0]


URLS = [
    ("http://A.B.net/x?q", "a.b.net", "/x", "net/", "block"), ("https://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("http://www.example.net/en", "www.example.net", "/en", "net/", "block"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("ftp://org/fr/x#y", "org", "/fr/x", "org/fr/", "allow"), ("http://notnet", "notnet", "", None, "allow"), ("http://x.net", "x.net", "", None, "allow"),
    ("//x.net/a", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://ÄB.org:80/a", "Äb.org:80", "/a", None, "allow"),
    ("http://fakeexample.com/de/", "fakeexample.com", "/de/", None, "allow"),
]


def test_rules(rows):
    pages = rows([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    out = hosts.judge_urls(pages, rows([], "page_id bigint, good int"))
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()) == [(i, *u[1:]) for i, u in enumerate(URLS)]


def test_a_host_is_blocked_when_its_bound_stays_low(rows):
    urls = [f"http://bad.com/{i}" for i in range(60)] + [f"http://ok{i}.com/" for i in range(60)] + ["http://new.com/", "http://few.com/"]
    pages = rows(list(enumerate(urls)), "page_id bigint, url string")
    good = [(i, int(i >= 60)) for i in range(120)] + [(121, 0), (5, None), (999, 1)]
    out = {r.page_id: r for r in hosts.judge_urls(pages, rows(good, "page_id bigint, good int")).collect()}
    assert {out[i].verdict for i in range(60)} == {"block"} and {out[i].verdict for i in range(60, 121)} == {"allow"}
    assert out[0].good_rate < 0.1 < out[121].good_rate < out[120].good_rate < 1
    assert hosts.judge_urls(rows([], "page_id bigint, url string"), rows(good, "page_id bigint, good int")).collect() == []


@pytest.mark.parametrize("n", [1, 3])
def test_strength_without_scatter(rows, n):
    assert hosts.prior_strength(rows([(n, 1, 0.5)] * 2, "n bigint, k bigint, p double")) == hosts.STRONGEST


def plain_reputation(hosts_of, outcomes, strengths):
    """Posterior of each host by hand: (a, b) of its beta distribution; strengths of suffixes, domains and hosts are given."""
    n = {h: sum(x == h for x, _ in outcomes) for h in hosts_of}
    k = {h: sum(g for x, g in outcomes if x == h) for h in hosts_of}
    out = {}
    for h, (domain, suffix) in hosts_of.items():
        groups = [[x for x in hosts_of if x != h], [x for x, (_, s) in hosts_of.items() if s == suffix and x != h], [x for x, (d, _) in hosts_of.items() if d == domain and x != h]]
        mean = evidence = None
        for group, strength in zip(groups, [None, *strengths]):
            seen, good = sum(n[x] for x in group), sum(k[x] for x in group)
            if mean is None:
                mean, evidence = (good / seen if seen else 0.5), seen
            else:
                s = max(hosts.WEAKEST, min(strength, evidence))
                mean, evidence = (good + s * mean) / (seen + s), seen + s
        s = max(hosts.WEAKEST, min(strengths[2], evidence))
        out[h] = k[h] + s * mean, n[h] - k[h] + s * (1 - mean)
    return out


def test_reputations_equal_direct_integration(rows, monkeypatch):
    rng = np.random.default_rng(5)
    names = {f"h{i}.d{i % 5}.{('com', 'co.uk', 'org')[i % 3]}": (f"d{i % 5}.{('com', 'co.uk', 'org')[i % 3]}", ("com", "co.uk", "org")[i % 3]) for i in range(30)}
    rate = {h: rng.beta(1, 1) for h in names}
    outcomes = [(h, int(rng.random() < rate[h])) for i, h in enumerate(names) for _ in range(i % 7 * 3)]
    strengths, plain = [], hosts.prior_strength
    monkeypatch.setattr(hosts, "prior_strength", lambda level: strengths.append(plain(level)) or strengths[-1])
    got = {r.host: r for r in hosts.reputations(rows([(h,) for h in names], "host string"), rows(outcomes, "host string, good int")).collect()}
    x = (np.arange(200_000) + 0.5) / 200_000
    for h, (a, b) in plain_reputation(names, outcomes, strengths).items():
        if min(a, b) < 1:  # the density has no bound there
            assert got[h].mean == pytest.approx(a / (a + b))
            continue
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - ((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)).max())
        density /= density.sum()
        mean = (density * x).sum()
        upper = mean + hosts.Z * math.sqrt((density * (x - mean) ** 2).sum())
        assert got[h].mean == pytest.approx(mean, abs=2e-3) and got[h].upper == pytest.approx(upper, abs=5e-3)


def test_suffix_table(rows):
    df = rows([("a.b.co.uk",), ("co.uk",), ("x.co.uk",), ("www.x.org",), ("x.github.io",)], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", hosts.domain_of(df.host).alias("d"), hosts.suffix_of(df.host).alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.co.uk": ("x.co.uk", "co.uk"), "www.x.org": ("x.org", "org"), "x.github.io": ("github.io", "io")}
    own = df.select("host", hosts.domain_of(df.host, ("github.io",)).alias("d")).where("host = 'x.github.io'").first()
    assert own.d == "x.github.io"


def texts_of(rows, pages):
    df = rows([(i, f"http://h{h}.com/{i}", page, "x") for i, (h, page) in enumerate(pages)], "page_id bigint, url string, html string, pattern string")
    return [r.text for r in sorted(extract_text(df).collect(), key=lambda r: r.page_id)]


def test_names_of_elements_around_the_article(rows):
    body = "<article><h1>Title</h1><p>One.</p>{}</article>"
    pages = [
        (1, f"<body class='no-sidebar'>{body.format('')}</body>"), (2, f"<div class='content has-sidebar'>{body.format('')}</div>"),
        (3, body.format("<div class='related-work'><p>Two.</p></div>")), (4, body.format("<div class='related-posts'><p>Not this.</p></div><div class=share>Nor this.</div>")),
        (5, f"<div class='sidebar-left'>{body.format('')}</div>"), (6, f"<nav>{body.format('')}</nav>"),
    ]
    assert texts_of(rows, pages) == ["Title One.", "Title One.", "Title One. Two.", "Title One.", "Title One.", ""]


def test_deep_nesting_and_long_pages(rows):
    deep = "<article>" + "<div><p>x</p>" * 100_000 + "end" + "</div>" * 100_000 + "<aside>no</aside>after</article><p>menu</p>"
    wide = "<article>" + "".join(f"<p>{i}</p>" for i in range(100_000)) + "</article>"
    stray = "<article><p>a</p>" + "</section>" * 100_000 + "<p>b</p></article>"
    got = texts_of(rows, [(1, deep), (2, wide), (3, stray)])
    assert got[0] == "x " * 100_000 + "end after" and got[1] == " ".join(map(str, range(100_000))) and got[2] == "a b"


def test_many_pages_with_classes_of_their_own(rows):
    pages = [(1, f"<div class='post-{i}'><article class='id{i}'><p>Text {i}.</p></article><div class='x{i}'>more</div></div>") for i in range(2000)]
    pages[77] = (1, "<article><p>Another shape.</p></article>")
    assert texts_of(rows, pages) == [f"Text {i}." if i != 77 else "Another shape." for i in range(2000)]
    wrapper = infer_wrappers(rows([("h", p) for _, p in pages], "host string, html string")).first()
    assert wrapper.pages == 2000 and len(wrapper.pattern) < 2000
