"""Labelled training pages for the block labeller, made from templates.

Pages vary in their tags (semantic or plain containers with telling class names), in what surrounds
the article (menus, notices, adverts, side bars, forms, reader comments, footers), in languages and
in sloppiness (unclosed tags).  Texts are random syllables and common page words.  A private-use
character marks the texts of the article; ``labelled`` reads the page and takes the marks off.
"""

from __future__ import annotations

import random

from tabsmith.llm.html_blocks import Leaf, leaves

MARK = ""
SYLLABLES = ("the er on an re he in ed nd ha at en es or ti st ion ing ble ly ou ea th wh sh und ein ich der sch gen "
             "heit ung ver zu auf el la os ar ción mente que ado rr ll ñ í de les eau aux tre ment é è ê oi ais qu une "
             "ka to shi ma na ri po va da mi lo").split()
MENU = ("home about contact login search privacy terms menu news blog shop help more archive startseite kontakt impressum "
        "über anmelden suche inicio contacto ayuda buscar accueil aide connexion mentions").split()
NOTICE = ("this site uses cookies accept cookies privacy policy subscribe newsletter sign up now consent settings we value "
          "your privacy please enable sponsored advertisement anzeige publicidad publicité sale offer buy").split()
COMMENT = "i think great post thanks for sharing reply agree you are wrong lol nice article said wrote posted on hours ago".split()
FOOT = "copyright all rights reserved imprint powered by contact terms © 2021 2023 privacy follow us on".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pool = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(400)]

    def some(self, words: list, low: int, high: int, own: float = 0.3) -> str:
        n = self.r.randint(low, high)
        return " ".join(self.r.choice(self.pool) if self.r.random() < own else self.r.choice(words) for _ in range(n))

    def prose(self, low: int, high: int) -> str:
        out, n = [], self.r.randint(low, high)
        while n > 0:
            k = min(n, self.r.randint(1, 14))
            s = self.r.choices(self.pool, k=k)
            if len(s) > 6 and self.r.random() < 0.4:
                s[3] += ","
            out.append(" ".join(s).capitalize() + self.r.choice(". . . . ! ?".split()))
            n -= k
        return " ".join(out)

    def tag(self, names: str, classes: str, body: str) -> str:
        """A plain or semantic element: a telling tag, or a container with a telling class or id."""
        name = self.r.choice(names.split())
        attr = ""
        if name in ("div", "section", "ul", "aside", "p", "span", "table") or self.r.random() < 0.2:
            attr = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(classes.split())}"'
        return f"<{name}{attr}>{body}</{name}>"

    def links(self, n: int, words: list) -> str:
        wrap = self.r.choice(["li", "li", "span", "div"])
        items = "".join(f'<{wrap}><a href="/{i}">{self.some(words, 1, 4, 0.6)}</a></{wrap}>' for i in range(n))
        return f"<ul>{items}</ul>" if wrap == "li" else items

    def paragraph(self) -> str:
        r = self.r
        kind = r.random()
        text = MARK + self.prose(*r.choice([(1, 6), (8, 40), (20, 120)]))
        if kind < 0.7:
            if r.random() < 0.15:
                half = len(text) // 2
                text = f"{text[:half]}<br>{text[half:]}" if r.random() < 0.5 else f"<b>{text}"
            return f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}"
        if kind < 0.78:
            return f"<h2>{MARK}{self.prose(2, 7)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{MARK}{self.prose(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{MARK}{self.prose(1, 4)}</td><td>{MARK}{self.prose(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{text}</div>" if r.random() < 0.6 else f"<pre>{text}</pre>"

    def page(self) -> str:
        r = self.r
        ad = lambda: self.tag("div div aside ins", "ad ads advert banner sponsored ad-slot promo", f"{self.some(NOTICE, 2, 14, 0.7)}")
        notice = lambda: self.tag("div div section", "cookie notice consent gdpr banner alert cookie-banner", f"<p>{self.some(NOTICE, 6, 30)}</p><button>{self.some(NOTICE, 1, 2, 0)}</button>")
        form = lambda: f"<form><label>{self.some(NOTICE, 1, 4)}</label><input><button>{self.some(NOTICE, 1, 2)}</button></form>"
        menu = lambda: self.tag("nav nav div ul", "menu nav navbar navigation topnav breadcrumb", self.links(r.randint(3, 9), r.choice([MENU, self.pool])))
        side = lambda: self.tag("aside div section", "sidebar side widget related recommended popular sidebar-right", f"<h3>{self.some(MENU, 1, 4)}</h3>" + r.choice([self.links(r.randint(2, 7), self.pool), f"<p>{self.prose(5, 40)}</p>"]))
        talk = lambda: self.tag("div section div ol", "comments comment-list reader-comments discussion responses", f"<h3>{self.some(COMMENT, 1, 3, 0)}</h3>" + "".join(f'<div class="comment"><span class="author">{self.some(self.pool, 1, 2)}</span><p>{self.some(COMMENT, 4, 40, 0.7)}</p></div>' for _ in range(r.randint(1, 5))))
        foot = lambda: self.tag("footer footer div", "footer site-footer bottom copyright colophon", r.choice([f"&copy; {self.some(FOOT, 3, 12)} &middot; {self.prose(2, 14)}", f"<p>{self.some(FOOT, 3, 14)}</p>{self.links(3, MENU)}"]))
        head = lambda: self.tag("header header div", "header masthead site-header top logo", r.choice([f"<h1>{self.some(self.pool, 1, 3)}</h1>", f"<a href='/'>{self.some(self.pool, 1, 3)}</a>", f"<p>{self.some(MENU, 2, 8)}</p>"]) + (menu() if r.random() < 0.5 else ""))
        body = [f"<h1>{MARK}{self.prose(2, 10)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            body.append(self.paragraph())
            if r.random() < 0.06:
                body.append(r.choice([ad, form, side])())
        article = "".join(body)
        kind = r.random()
        if kind < 0.45:
            article = f"<article>{article}</article>"
        elif kind < 0.9:
            article = self.tag("div div section main", "content post entry article story article-body main post-content text", article)
        if r.random() < 0.3:
            article = r.choice(["<main>%s</main>", "<div id=\"main\">%s</div>", "<div class=\"container\">%s</div>", "<div>%s</div>"]) % article
        before = [f() for f, p in ((notice, 0.2), (head, 0.4), (menu, 0.8), (ad, 0.4), (form, 0.15), (side, 0.2)) if r.random() < p]
        after = [f() for f, p in ((ad, 0.2), (talk, 0.35), (side, 0.35), (form, 0.15), (notice, 0.1), (foot, 0.9)) if r.random() < p]
        r.shuffle(before)
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.prose(2, 10)}</title></head><body>{''.join(before)}{article}{''.join(after)}{end}"


def labelled(pages: int, seed: int) -> list[tuple[list[Leaf], list[int]]]:
    """(leaves, labels) of so many pages; label 1: text of the article."""
    out = []
    for i in range(pages):
        found = leaves(Maker(seed * 100_003 + i).page())
        labels = [int(MARK in x.text) for x in found]
        clean = [Leaf(x.path, " ".join(x.text.replace(MARK, "").split()), x.link_chars) for x in found]
        keep = [j for j, x in enumerate(clean) if x.text]
        out.append(([clean[j] for j in keep], [labels[j] for j in keep]))
    return out
