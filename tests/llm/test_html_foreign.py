"""Pages written by hand in the manner of other sites: other tags, class words and nestings than the generator's or the
tables'. The extracted words are compared with the article's."""

import re
from collections import Counter

import pytest

from pricewell.llm import html_extract

A = "The harbour was built in 1874, when the town had barely two thousand people, most of whom lived from herring."
B = "By the turn of the century, the railway had reached the quay, and the catch could be sold inland on the same day."
C = "Storms in 1911 and 1913 broke the outer wall; it was rebuilt in granite, at three times the first estimate, and has stood since."
D = "Today only four boats land fish here, but the basin is full every summer with visitors from across the strait."
E = "Local historians keep a register of every vessel, its owner and its fate, which can be read in the old customs house."
LINKS = "".join(f'<li class="lvl1"><a href="/{x}">{x.title()}</a></li>' for x in "news sport weather culture travel business opinion".split())

PAGES = {
    "encyclopaedia": (
        f"""<html><head><title>Harbour</title><style>.a{{}}</style></head><body class="ltr"><div class="mw-page"><div id="mw-head-base"></div>
<div class="vector-col"><ul>{LINKS}</ul></div><div id="bodyContent" class="mw-body"><h1 id="firstHeading">Harbour</h1>
<div id="mw-text"><div class="parser-out"><p>{A}<sup>[1]</sup></p><p>{B}</p><h2><span class="hl">Storms</span></h2><p>{C}</p><ul><li>{D}</li></ul><p>{E}</p></div></div></div>
<div id="siteSub"><ul><li><a href="/p">Privacy</a></li><li><a href="/d">Disclaimers</a></li><li><a href="/c">Contact</a></li></ul></div></div></body></html>""",
        f"Harbour {A}[1] {B} Storms {C} {D} {E}",
    ),
    "old tables": (
        f"""<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD WIDTH=120><A HREF=/a>Home</A><BR><A HREF=/b>News</A><BR><A HREF=/c>Links</A><BR><A HREF=/d>Guestbook</A></TD>
<TD><H1>The harbour</H1><P>{A}<P>{B}<P>{C}<P>{D}<P>{E}</TD></TR></TABLE><HR><CENTER><FONT SIZE=1>Copyright 1999 <A HREF=/m>Webmaster</A> <A HREF=/s>Sitemap</A></FONT></CENTER></BODY></HTML>""",
        f"The harbour {A} {B} {C} {D} {E}",
    ),
    "press": (
        f"""<!doctype html><html><body><div class="masthead"><a href="/">The Courier</a><div class="edition"><a href="/uk">UK</a> <a href="/us">US</a></div></div><nav class="pillars"><ul>{LINKS}</ul></nav>
<div class="dcr-1"><main id="maincontent"><article class="dcr-2"><h1 class="headline">Harbour town turns to visitors</h1><div class="dcr-9"><p class="dcr-3">{A}</p><p class="dcr-3">{B}</p><figure><img src="x.jpg"><figcaption>The quay in 1905.</figcaption></figure><p class="dcr-3">{C}</p><p class="dcr-3">{D}</p></div></article></main>
<aside class="most-read"><h3>Most read</h3><ol><li><a href="/1">Ten walks near the sea you should not miss this spring</a></li><li><a href="/2">Why rents rise faster on the coast</a></li></ol></aside></div>
<section class="comments-panel" id="comments"><h2>Comments (2)</h2><div class="d-comment"><p>I was there last year and it was lovely, thank you for this piece.</p></div><div class="d-comment"><p>Prices have doubled since.</p></div></section>
<footer class="site-foot"><p>All rights reserved. The Courier Media Ltd.</p><ul><li><a href="/t">Terms</a></li><li><a href="/j">Jobs</a></li></ul></footer></body></html>""",
        f"Harbour town turns to visitors {A} {B} The quay in 1905. {C} {D}",
    ),
    "blog": (
        f"""<html><body class="home blog"><div id="page" class="hfeed"><div id="masthead" class="site-header"><p class="site-title"><a href="/">Sea notes</a></p></div><div id="content-wrap"><div id="primary"><div class="hentry"><h2 class="entry-title">A walk to the quay</h2><div class="entry-content"><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{C}</p><p>{D} <a href="/more">See the map</a> for the way.</p></div></div></div>
<div id="secondary" class="widget-area"><div class="widget"><h3>Archives</h3><ul><li><a href="/1">May 2019</a></li><li><a href="/2">June 2019</a></li></ul></div><div class="widget"><h3>Search</h3><form><input name="s"><button>Go</button></form></div></div></div><div id="colophon">Proudly powered by a press. <a href="/feed">Feed</a></div></div></body></html>""",
        f"A walk to the quay {A} {B} {C} {D} See the map for the way.",
    ),
    "manual": (
        f"""<html><body><div class="wy-grid"><div class="wy-side"><a href="/">Docs</a><ul><li><a href="/i">Install</a></li><li><a href="/u">Usage</a></li><li><a href="/r">Reference</a></li><li><a href="/f">FAQ</a></li></ul></div><section class="wy-wrap"><div class="rst"><div role="navigation" aria-label="breadcrumbs"><ul><li><a href="/">Docs</a></li><li>Usage</li></ul></div><div role="main"><h1>Usage</h1><p>{A}</p><pre>harbour --open --gate 3</pre><p>{B}</p><dl><dt>gate</dt><dd>{C}</dd></dl><p>{D}</p></div><footer><a href="/p">Previous</a> <a href="/n">Next</a><p>Built with a theme.</p></footer></div></section></div></body></html>""",
        f"Usage {A} harbour --open --gate 3 {B} gate {C} {D}",
    ),
    "no names at all": (
        f"""<html><body><div><div><a href="/">Start</a> <a href="/a">About</a> <a href="/k">Kontakt</a></div><div><h1>Harbour</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p><p>{E}</p></div><div><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></div></div></body></html>""",
        f"Harbour {A} {B} {C} {D} {E}",
    ),
    "french": (
        f"""<html lang=fr><body><header class="entete"><a href=/>Le Quai</a><ul class="onglets">{LINKS}</ul></header><div class="corps"><div class="texte-principal"><h1>Le port</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div class="colonne"><h4>À lire aussi</h4><ul><li><a href=/1>Un été au bord</a></li><li><a href=/2>La criée</a></li></ul></div></div><footer class="pied"><a href=/m>Mentions légales</a> <a href=/c>Contact</a></footer></body></html>""",
        f"Le port {A} {B} {C}",
    ),
    "consent first": (
        f"""<html><body><div id="cmp" role="dialog" class="consent-overlay"><p>We and our 812 partners store and access information on a device, such as cookies, to show you adverts that fit your interests and to measure them.</p><button>Agree</button><button>Options</button></div><div class="shell"><div class="story-stream"><h1>Harbour</h1><div><p>{A}</p><p>{B}</p></div><div class="ad-slot"><p>Advertisement: cruises from 99 a day, book now.</p></div><div><p>{C}</p><p>{D}</p></div></div></div><footer><p>Registered office: 1 Quay Street.</p></footer></body></html>""",
        f"Harbour {A} {B} {C} {D}",
    ),
}


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def agreement(got, want):
    a, b = (Counter(re.findall(r"\w+", x)) for x in (got, want))
    both = sum((a & b).values())
    return 2 * both / max(sum(a.values()) + sum(b.values()), 1)


def test_foreign_pages(model):
    """Word agreement (F1) with the article of every page: seven of eight nearly whole (the short one in French is missed)."""
    got = dict(zip(PAGES, html_extract.extract([p for p, _ in PAGES.values()], model)))
    scores = {name: round(agreement(got[name], want), 3) for name, (_, want) in PAGES.items()}
    assert sum(scores.values()) / len(scores) > 0.85 and sum(x > 0.95 for x in scores.values()) >= 7, scores


def test_a_table_of_only_long_pages(spark):
    """Pages of over 20,000 characters each train as well as short ones, and are extracted whole."""
    short = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect()
    pad = "<!-- " + "x" * 30_000 + " -->"
    rows = [(r["page_id"], r["url"], r["html"].replace("<article>", pad + "<article>")) for r in short if "<article>" in r["html"]]
    long = spark.createDataFrame([*rows, (-1, None, None), (-2, "u", "\x02 broken \x01 <p>"), (-3, "u", rows[0][2])], "page_id long, url string, html string")
    plain = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(short), html_extract.train(long)).collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(long).collect()}
    assert len(rows) > 20 and all(got[i] == plain[i] != "" for i, _, _ in rows) and got[-3] == got[rows[0][0]] and got[-1] == ""


def test_time_grows_with_length_alone():
    """Unclosed inline tags, stray ends and deep nests: twice the page takes some twice the time."""
    import time

    for unit in ("<b>x<i>y", "<i><div>" + "<b>" * 50 + "</i>" * 50, "<div>a", "<b><p>c", "<textarea><li>", "</b></p>", '<a "x', '</b "', "<a x", "<!x", "<b '>'", "<a '\"x>", "<title></title", "<!--"):
        seconds = []
        for n in (2_000, 16_000):
            page = unit * (n // max(1, unit.count("<") // 2))
            began = time.process_time()
            nodes, runs = html_extract.dom(page)
            judged, _ = html_extract.features(nodes, runs)
            html_extract.text_of(nodes, runs, set(judged))
            seconds.append(time.process_time() - began)
        assert seconds[1] < 24 * max(seconds[0], 0.02), (unit[:20], seconds)


def test_tags_without_an_end():
    """Quotes that never close, and pages that end within a tag: 64,000 repeats in a moment, and what a tag then is."""
    import time

    for unit in ('<a "x', '</b "', "<a x", "<!x", "</script", "<b '>'", "<a '\"x>"):
        began = time.process_time()
        html_extract.dom(unit * 64_000)
        assert time.process_time() - began < 6, unit
    tags = lambda page: [(n.tag, n.attrs) for n in html_extract.dom(page)[0][1:]]
    assert tags('<a class="x>y">t<b id=\'>\'>') == [("a", "x>y"), ("b", ">")]
    assert tags('<a class="x>t<b id=z>u<i') == [("a", '"x'), ("b", "z")]
    assert html_extract.dom("<p>a < b <3 c<x")[1] == [(1, "a < b <3 c<x")]
    assert html_extract.dom("<script>a</script")[1] == [] and html_extract.dom("<p>a<!-- b <i> ")[1] == [(1, "a")]
