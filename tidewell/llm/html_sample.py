"""Pages of our own making, with what is article and what isn't, from which the classifier of html_text learns.

A page is made of parts in a random order of layouts: menus, headers, notices,
adverts, sidebars, forms, readers' comments, footers and an article, in wrappers
with names that mean something, something else or nothing. ``PAGES`` bounds the
sample. Words are random syllables, so no text of a table is learnt.
"""

from __future__ import annotations

import random

#: Pages that the classifier learns from, and those that the ties are chosen by.
PAGES, CHOOSING = 500, 150

_SYLLABLES = "ka lo mi ren tas vel dor un sil pra ghe tor ban esh il quo rad ne".split()
_MARK = "\u0001"  # begins the text of a block that is article


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high)))

    def said(self, low: int, high: int) -> str:
        out = []
        n = self.rng.randint(low, high)
        while n > 0:
            k = min(n, self.rng.randint(3, 18))
            out.append(self.words(k, k).capitalize() + self.rng.choice(".....?!"))
            n -= k
        text = " ".join(out)
        if self.chance(0.15):
            text = text.replace(" ", f' <a href="/x">{self.words(1, 3)}</a> ', 1)
        return text

    def link(self, most: int = 3) -> str:
        return f'<a href="/{self.rng.randrange(99)}">{self.words(1, most)}</a>'

    def within(self, inside: str, names: str, tags: str = "div div div section") -> str:
        tag = self.rng.choice(tags.split())
        name = self.rng.choice(names.split())
        return f'<{tag} {self.rng.choice(("class", "class", "id"))}="{name}">{inside}</{tag}>' if name != "-" else f"<{tag}>{inside}</{tag}>"

    def paragraph(self, good: bool) -> str:
        mark = _MARK if good else ""
        kind = self.rng.random()
        if kind < 0.62:
            return f"<p>{mark}{self.said(4, 90)}</p>"
        if kind < 0.72:
            return f"<p>{mark}{self.words(1, 9).capitalize()}{self.rng.choice(('.', ':', ''))}</p>"
        if kind < 0.80:
            return f"<h{self.rng.choice('2233')}>{mark}{self.words(1, 8).capitalize()}</h2>"
        if kind < 0.90:
            items = "".join(f"<li>{mark}{self.said(1, 20) if self.chance(0.6) else self.words(1, 6)}" for _ in range(self.rng.randint(2, 6)))
            return f"<ul>{items}</ul>"
        if kind < 0.95:
            return f"<blockquote>{mark}{self.said(6, 40)}</blockquote>"
        rows = "".join(f"<tr><td>{mark}{self.words(1, 3)}<td>{mark}{self.words(1, 3)}</tr>" for _ in range(self.rng.randint(1, 4)))
        return f"<table>{rows}</table>"

    def menu(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.rng.randint(2, 9)))
        return f"<nav><ul>{items}</ul></nav>" if self.chance(0.5) else self.within(f"<ul>{items}</ul>", "menu nav navbar top-nav links -", "div ul")

    def links(self) -> str:
        return self.within(f"<h3>{self.words(1, 4)}</h3><ul>" + "".join(f"<li>{self.link(8)}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>", "related related-posts recommended more popular -")

    def advert(self) -> str:
        return self.within(self.said(3, 25) if self.chance(0.5) else f"<p>{self.said(3, 25)}</p>", "ad ads advert advertisement ad-slot sponsored promo")

    def notice(self) -> str:
        return self.within(f"<p>{self.rng.choice(('We use cookies. ', '', 'Notice: '))}{self.said(5, 30)}</p>" + self.rng.choice(("", "<button>OK</button>")), "cookie-notice cookie-banner notice alert consent gdpr banner")

    def form(self) -> str:
        inside = f"<p>{self.rng.choice(('Subscribe. ', '', 'Sign up. '))}{self.said(2, 15)}</p><input><button>{self.words(1, 2)}</button>"
        return f"<form>{inside}</form>" if self.chance(0.6) else self.within(f"<form>{inside}</form>", "newsletter subscribe signup login search -")

    def aside(self) -> str:
        inside = "".join(f"<p>{self.said(3, 30)}</p>" for _ in range(self.rng.randint(1, 3))) + (self.links() if self.chance(0.5) else "")
        return f"<aside>{inside}</aside>" if self.chance(0.4) else self.within(inside, "sidebar widget widgets side left-sidebar rail", "div div section")

    def comments(self) -> str:
        one = lambda: f"<p>{self.words(1, 2).title()} {self.rng.choice(('said', 'wrote', ''))}</p><p>{self.said(3, 60)}</p>"
        tag = self.rng.choice(("div", "li", "article"))
        inside = "".join(f'<{tag} class="{self.rng.choice(("comment", "comment reply", "comment-body"))}">{one()}</{tag}>' for _ in range(self.rng.randint(1, 12)))
        return self.within(f"<h3>{self.rng.randrange(9)} {self.words(1, 2)}</h3>{inside}", "comments comment-list comments-area responses disqus_thread", "div section ol")

    def top(self) -> str:
        inside = f"<p>{self.words(1, 4).title()}</p><p>{self.said(2, 12)}</p>"
        return f"<header>{inside}</header>" if self.chance(0.6) else self.within(inside, "header masthead site-header topbar banner", "div")

    def bottom(self) -> str:
        inside = f"<p>&copy; {self.words(1, 5)}{self.rng.choice(('', '. All rights reserved.'))}</p><p>{self.said(2, 20)}</p>" + (self.link() if self.chance(0.5) else "")
        return f"<footer>{inside}</footer>" if self.chance(0.7) else self.within(inside, "footer site-footer copyright legal", "div")

    def article(self) -> str:
        head = f"<h1>{_MARK}{self.words(2, 9).capitalize()}</h1>"
        if self.chance(0.2):
            head = f"<header>{head}" + (f'<p class="byline">{self.words(1, 4)}</p>' if self.chance(0.5) else "") + "</header>"
        body = [self.paragraph(True) for _ in range(self.rng.randint(1, 14))]
        if self.chance(0.35):  # a part with a name that says little
            some = "".join(self.paragraph(True) for _ in range(self.rng.randint(1, 4)))
            body.insert(self.rng.randrange(len(body) + 1), self.within(some, "discussion discussion survey-results results print-body search-strategy related-work feedback-loops header-text banner-years notice-of-terms - - intro", "div section"))
        for part, p in ((self.advert, 0.3), (self.form, 0.2), (self.links, 0.2), (self.aside, 0.15)):
            if self.chance(p):
                body.insert(self.rng.randrange(1, len(body) + 1), part())
        inside = head + "".join(body)
        kind = self.rng.random()
        if kind < 0.4:
            return f"<article{self.rng.choice(('', ' class=post', ' class=entry', ' id=discussion'))}>{inside}</article>"
        if kind < 0.5:
            return f"<main>{inside}</main>"
        if kind < 0.6:
            return f"<main><article>{inside}</article>{self.comments() if self.chance(0.4) else ''}</main>"
        return self.within(inside, "content post entry article-body main story text - - - column wrap has-sidebar page no-ads search-results", "div div div section")

    def page(self) -> str:
        before = [part() for part, p in ((self.top, 0.5), (self.menu, 0.8), (self.notice, 0.4), (self.advert, 0.4), (self.aside, 0.25)) if self.chance(p)]
        after = [part() for part, p in ((self.comments, 0.4), (self.links, 0.4), (self.aside, 0.25), (self.form, 0.2), (self.advert, 0.2), (self.bottom, 0.8)) if self.chance(p)]
        self.rng.shuffle(before)
        inside = "".join(before) + self.article() + "".join(after)
        kind = self.rng.random()
        if kind < 0.12:
            inside = f"<form>{inside}</form>"
        elif kind < 0.4:
            inside = self.within(inside, "layout page wrapper container has-sidebar no-sidebar site - search-page share-enabled comments-open", "div")
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{inside}</body></html>"


def pages(n: int, seed: int = 1) -> list[str]:
    """``n`` pages; the text of every block of an article begins with a mark that ``truth`` reads."""
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]


def truth(text: str) -> tuple[str, bool]:
    """A block's text without its mark, and whether it had one."""
    return text.replace(_MARK, ""), text.startswith(_MARK)
