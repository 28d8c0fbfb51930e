"""Labelled pages for the main-text model: drawn from a grammar of page layouts, with the label of every text block."""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zu tion ing er en al ou th st é ü ñ".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, n: int) -> str:
    words = [_word(r) for _ in range(n)]
    if r.random() < 0.1:
        words = [w + r.choice(["%%%", "***", "&amp;", "$$$", "|"]) for w in words]
    if r.random() < 0.05:
        words = [w.upper() + "!!" for w in words]
    return " ".join(words)


def _sentences(r: random.Random, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, r.randint(1, 14))
        s = _words(r, k).capitalize()
        if k > 5 and r.random() < 0.5:
            s = s.replace(" ", ", ", 1)
        out.append(s + r.choice([".", ".", ".", "?", "!", ""]))
        n -= k
    return " ".join(out)


class _Page:
    def __init__(self, seed: int) -> None:
        self.r, self.out = random.Random(seed), []

    def text(self, label: int, body: str) -> str:
        """A text with its label: the parser's test hook reads \\x01 as main and \\x02 as boilerplate."""
        return ("\x01" if label else "\x02") + body

    def inline(self, body: str) -> str:
        words = body.split(" ")
        if len(words) > 3 and self.r.random() < 0.3:
            i = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", "span", 'a href="/x"'])
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        if len(words) > 6 and self.r.random() < 0.1:
            words[3] += "<br>"
        return " ".join(words)

    def paragraphs(self, label: int, few: int, many: int) -> str:
        r, out = self.r, []
        open_p = r.random() < 0.3
        for _ in range(r.randint(few, many)):
            n = r.choice([1, 2, 4, 9, 20, 40, 80, 160])
            body = self.text(label, self.inline(_sentences(r, n)))
            kind = r.random()
            if kind < 0.8:
                bold = "<b>" if r.random() < 0.2 else ""
                out.append(f"<p>{bold}{body}" + r.choice(["", "<br>"]) if open_p and r.random() < 0.5 else f"<p>{body}</p>")
            elif kind < 0.87:
                out.append(f"<h{r.randint(2, 4)}>{self.text(label, _words(r, r.randint(1, 7)))}</h2>")
            elif kind < 0.92:
                out.append("<ul>" + "".join(f"<li>{self.text(label, _sentences(r, r.randint(2, 20)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote>{self.text(label, _sentences(r, r.randint(4, 40)))}</blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{self.text(label, _words(r, 2))}</td><td>{self.text(label, _words(r, 2))}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<div>{body}</div>")
        return "".join(out)

    def links(self, attrs: str, tag: str) -> str:
        r = self.r
        rows = [f'<a href="/{_word(r)}">{self.text(0, _words(r, r.randint(1, 4)))}</a>' for _ in range(r.randint(2, 9))]
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " ", " &middot; "]).join(rows)
        head = f"<h3>{self.text(0, _words(r, 2))}</h3>" if r.random() < 0.3 else ""
        return f"<{tag}{attrs}>{head}{body}</{tag}>"

    def attr(self, names: str) -> str:
        r = self.r
        name = r.choice(names.split())
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{_word(r)} {name}"', f" class='{name} x{r.randint(1, 99)}'"])

    def boiler(self, kind: str) -> str:
        r, t = self.r, self.text
        if kind == "nav":
            return self.links(r.choice(["", self.attr("menu nav navbar topnav main-menu")]), r.choice(["nav", "nav", "div"])) if r.random() < 0.6 else self.links(self.attr("menu nav navbar breadcrumb breadcrumbs toc pagination tags"), r.choice(["div", "ul", "ol", "nav"]))
        if kind == "ad":
            tag = r.choice(["div", "div", "aside", "section", "ins", "p"])
            return f"<{tag}{self.attr('ad ads advert advertisement sponsored promo banner ad-slot')}>{t(0, self.inline(_sentences(r, r.randint(1, 40))))}</{tag}>"
        if kind == "header":
            return f"<header{r.choice(['', self.attr('site-header top masthead')])}><{r.choice(['h1', 'div', 'p', 'span'])}>{t(0, _words(r, r.randint(1, 5)))}</div>{self.links('', 'nav') if r.random() < 0.5 else ''}</header>"
        if kind == "footer":
            mark = r.choice(["&copy; ", "Copyright ", "", "&copy;"])
            body = t(0, mark + _word(r) + r.choice([".example.com", ".net", " Inc."]) + r.choice([" &middot; ", " | ", " - "]) + _sentences(r, r.randint(1, 30)))
            return f"<footer>{body}</footer>" if r.random() < 0.7 else f"<div{self.attr('footer site-footer copyright legal')}><p>{body}</p></div>"
        if kind == "side":
            inner = "".join(r.choice([lambda: self.links("", "div"), lambda: f"<p>{t(0, _sentences(r, r.randint(3, 50)))}</p>", lambda: f"<h3>{t(0, _words(r, 3))}</h3>"])() for _ in range(r.randint(1, 3)))
            return f"<aside{r.choice(['', self.attr('sidebar widget related')])}>{inner}</aside>" if r.random() < 0.6 else f"<div{self.attr('sidebar side-bar widget related recommended trending teaser rail')}>{inner}</div>"
        if kind == "notice":
            tag = r.choice(["div", "section", "p", "aside"])
            return f"<{tag}{self.attr('cookie cookie-notice notice consent gdpr banner alert popup modal newsletter subscribe disclaimer')}>{t(0, _sentences(r, r.randint(3, 40)))}{r.choice(['', '<button>' + t(0, _word(r)) + '</button>'])}</{tag}>"
        if kind == "form":
            return f"<form{r.choice(['', self.attr('search login signup')])}><label>{t(0, _words(r, r.randint(1, 12)))}</label><input type=text><button>{t(0, _words(r, 1))}</button>{'<p>' + t(0, _sentences(r, r.randint(3, 20))) + '</p>' if r.random() < 0.4 else ''}<select><option>{t(0, _word(r))}</option></select></form>"
        if kind == "share":
            return self.links(self.attr("share social follow meta byline author-box"), "div")
        rows = "".join(f"<{r.choice(['div', 'li', 'article'])}{self.attr('comment reply')}><b>{t(0, _word(r))}</b><p>{t(0, _sentences(r, r.randint(2, 70)))}</p></div>" for _ in range(r.randint(1, 5)))
        return f"<{r.choice(['section', 'div', 'ol'])}{self.attr('comments comment-list discussion responses disqus')}><h3>{t(0, _words(r, 2))}</h3>{rows}</section>"

    def make(self) -> str:
        r = self.r
        if r.random() < 0.05:
            return self.text(1, _sentences(r, r.choice([1, 3, 8, 30, 80])))
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{_words(r, 5)}</title><style>p{{margin:0}}</style><script>var t="</p>";track({r.randint(0, 9)});</script></head><body>'
        top = ["nav", "ad", "header", "notice", "form", "side", "share"]
        above = "".join(self.boiler(k) for k in r.sample(top, r.randint(0, 4)))
        below = "".join(self.boiler(k) for k in r.sample(["side", "comments", "share", "ad", "form", "notice", "nav"], r.randint(0, 4)))
        title = f"<h1>{self.text(1, _words(r, r.randint(1, 9)))}</h1>" if r.random() < 0.8 else ""
        body = self.paragraphs(1, 1, 9)
        if r.random() < 0.35:
            body += self.boiler(r.choice(["ad", "share", "side", "form", "notice", "comments"])) + (self.paragraphs(1, 1, 4) if r.random() < 0.6 else "")
        if r.random() < 0.15:
            body += self.boiler("comments")
        if r.random() < 0.1:
            title = f"<header>{title}</header>"
        tag = r.random()
        if tag < 0.55:
            main = f"<article{r.choice(['', self.attr('post entry')])}>{title}{body}</article>"
        elif tag < 0.7:
            main = f"<main>{title}{body}</main>"
        elif tag < 0.92:
            main = f"<div{self.attr('content main-content article-body post entry-content story text body')}>{title}{body}</div>"
        else:
            main = title + body
        wrap = r.random()
        if wrap < 0.15:
            main = f"<main>{main}</main>"
        elif wrap < 0.3:
            main = f"<div{self.attr('container wrapper page')}>{main}"
        foot = self.boiler("footer") if r.random() < 0.85 else ""
        return f"{head}{above}<!-- ad {r.randint(0, 99)} -->{main}{below}{foot}{r.choice(['</body></html>', '', '</body>'])}"


def pages(n: int, seed: int = 0) -> list[str]:
    """n pages of markup; \\x01 and \\x02 before a text give the label of its block."""
    return [_Page(seed * 1_000_003 + i).make() for i in range(n)]
