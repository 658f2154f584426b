"""Labelled urls by rule, for fitting the url filter where a caller has none of their own.

Two grammars make them: ordinary sites (names of syllables, articles, languages, numbered pages, feeds) and junk sites
(names of trade words of spam, gambling, adult, advert and tracking hosts, with affiliate and redirect paths). Half of the
junk urls have the paths of ordinary ones, and some ordinary names have dashes or digits, so that no single feature
tells them apart. The same number and seed give the same urls; none is taken from a table or from a rule's verdict."""

from __future__ import annotations

import numpy as np

SYLLABLES = "al ber ca den el for gra hol in jo ker lan mon nor or pel qui ren sol tan ur ver wil xan yor zel the tion ing st er".split()
JUNK = "adult ads adserver affiliate bet bets bingo bonus buy casino cash cheap click coupon crack credit dating deal diet download drug earn escort escorts farm free gambling gift girls hack hot jackpot keygen loan lottery loans lucky meds money naked offer online payday pharmacy pills poker popup porn prize promo replica rich rx seo sex sexy slots spam spin torrent track tracker tracking traffic viagra vip warez watches webcam weight win winner x xxx".split()
ORDINARY_TLD = "com com com org org net net de fr es it edu gov io co.uk".split()
JUNK_TLD = "com com net org info biz xyz top click online".split()
LANGUAGES = "en de fr es it".split()


def labelled_urls(n: int, seed: int = 0, junk: list[str] | None = None) -> list[tuple[str, int]]:
    """n (url, blocked) in equal parts; junk: the words of junk hosts, all by default."""
    rng, words = np.random.default_rng(seed), JUNK if junk is None else junk
    one = lambda x: x[int(rng.integers(len(x)))]
    name = lambda a, b: "".join(one(SYLLABLES) for _ in range(int(rng.integers(a, b))))
    slug = lambda: "-".join(name(1, 4) for _ in range(int(rng.integers(2, 7))))
    number = lambda digits: str(int(rng.integers(10**digits)))
    token = lambda: "".join(one("0123456789abcdef") for _ in range(int(rng.integers(8, 40))))

    def path() -> str:
        k = int(rng.integers(8))
        if k < 3:
            end = one(["", "", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed"])
            return f"/{one(LANGUAGES)}/{number(3)}{end}"
        if k == 3:
            return f"/20{rng.integers(10, 26)}/{rng.integers(1, 13):02d}/{slug()}" + one(["", "/", ".html"])
        if k == 4:
            return f"/{one(['articles', 'news', 'blog', 'posts'])}/{slug()}"
        if k == 5:
            return f"/wiki/{name(2, 4).title()}_{name(1, 3)}"
        if k == 6:
            return f"/?p={number(4)}"
        return one(["", "/", "/about", "/contact.html", f"/docs/{name(2, 3)}/{name(1, 3)}.html"])

    def junk_path() -> str:
        k = int(rng.integers(4))
        if k == 0:
            return f"/{one(['go', 'out', 'click', 'r'])}?aff={number(6)}&sid={token()}&sub={number(3)}"
        if k == 1:
            return f"/redirect.php?url={token()}&utm_source=ads&cid={number(9)}"
        if k == 2:
            return f"/{one(words)}-{one(words)}-{number(4)}"
        return f"/track/{token()}.gif?id={number(8)}&t={number(9)}"

    out = []
    for k in range(n):
        scheme, blocked = one(["http", "https"]), k % 2
        if blocked:
            host = one(["-", "-", ""]).join(one(words) for _ in range(int(rng.integers(1, 4)))) + one(["", "", "", number(2)])
            host = one(["", "", "www."]) + host + one(["", "", "." + name(2, 4)]) + "." + one(JUNK_TLD)
            where = path() if rng.random() < 0.5 else junk_path()
        else:
            host = one(["", "www.", "blog.", "m.", "news."]) + one(["", "", name(1, 3) + "."]) + name(2, 5)
            host += ("-" + name(1, 3) if rng.random() < 0.12 else "") + (number(2) if rng.random() < 0.06 else "") + "." + one(ORDINARY_TLD)
            where = path()
        out.append((f"{scheme}://{host}{where}", blocked))
    return out
