"""Labelled pages built from a rule: common layouts of articles with menus, adverts, notices, forms and reader comments.

Elements carry data-label="main", "links" or "talk", which holds for their content until overridden. Words are invented, so that only
structure can be learned from these pages.
"""

from __future__ import annotations

import random

LETTERS = "abcdefghijklmnoprstuvz"
# common names of page parts (class names and ids); fixed values
MAIN = ["content", "main", "mainContent", "article", "article-body", "post", "post-body", "entry", "entry-content", "story", "text", "body-text", ""]
HEAD = ["header", "masthead", "top", "site-header", "banner", "branding", "logo"]
MENU = ["nav", "menu", "navigation", "navbar", "breadcrumb", "links", "toolbar"]
SIDE = ["sidebar", "aside", "secondary", "widget", "rail", "right-column", "related", "popular", "recommended", "trending"]
ADS = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad", "teaser"]
NOTICES = ["notice", "cookie-notice", "cookie", "consent", "gdpr", "alert", "warning", "message", "popup", "modal", "overlay", "disclaimer", "paywall"]
FORMS = ["search", "newsletter", "subscribe", "signup", "login", "contact", "form"]
COMMENTS = ["comments", "comment-list", "discussion", "replies", "responses", "respond", "disqus", "reactions", "guestbook", "reader-comments"]
SHARE = ["share", "social", "tags", "pagination", "meta-links", "tools", "follow"]
FOOT = ["footer", "colophon", "site-info", "copyright", "bottom", "legal"]


class Builder:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(LETTERS) for _ in range(self.r.randint(2, 9)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(self.r.randint(a, b)))

    def link(self, a: int = 1, b: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.words(a, b)}</a>'

    def element(self, tags: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}>{inner}</{tag}>"

    def named(self, tags: list[str], names: list[str], inner: str, label: str = "") -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        if tag == "p" and ("<ul" in inner or "<p" in inner):
            tag = "div"  # a paragraph would end at the inner block
        where = self.r.choice(["class", "class", "id"])
        named = f' {where}="{name}"' if name and not (tag not in ("div", "section", "td", "ul", "p", "ol") and self.r.random() < 0.6) else ""
        return f'<{tag}{named}{f" data-label={label}" if label else ""}>{inner}</{tag}>'

    def links(self) -> str:
        items = [self.link() for _ in range(self.r.randint(3, 9))]
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(items)

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "head":
            return self.named(["header", "div"], HEAD, self.element(["h1", "h2", "p", "div"], self.words(1, 4)) + f"<p>{self.words(3, 8)}</p>" + (self.part("menu") if r.random() < 0.4 else ""), "links")
        if kind == "menu":
            return self.named(["nav", "nav", "div", "ul"], MENU, self.links(), "links")
        if kind == "side":
            box = f"<h3>{self.words(1, 3)}</h3>" + self.links() + (f"<p>{self.sentences(1, 2)}</p>" if r.random() < 0.5 else "")
            return self.named(["aside", "div"], SIDE, box, "links")
        if kind == "ad":
            inner = r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", f"<a href='/x'>{self.words(3, 8)}</a>", f"<span>{self.words(2, 6)}</span> {self.sentences(1, 2)}"])
            return self.named(["div", "div", "p", "aside", "section"], ADS, inner, "talk")
        if kind == "notice":
            inner = r.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)]) + (f"<button>{self.word()}</button>" if r.random() < 0.6 else "")
            return self.named(["div", "div", "section", "p"], NOTICES, inner, "talk")
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><p>{self.sentences(1, 2)}</p><button>{self.word()}</button>"
            return self.named(["form", "form", "div"], FORMS, inner, "talk")
        if kind == "comments":
            tags = r.choice([["div"], ["div"], ["div"], ["li"], ["li"], ["li"], ["article"]])
            items = [self.named(tags, ["comment", "reply", "item", "message"], f"<b>{self.words(1, 2)}</b> <p>{self.sentences(1, 6)}</p>") for _ in range(r.randint(1, 6))]
            return self.named(["ol", "ul"] if tags == ["li"] else ["section", "div"], COMMENTS, f"<h3>{self.words(1, 3)}</h3>" + "".join(items), "talk")
        if kind == "share":
            return self.named(["div", "p", "ul"], SHARE, self.links(), "links")
        return self.named(["footer", "footer", "div"], FOOT, r.choice([f"&copy; {self.words(2, 5)}.", f"<p>&copy; {self.words(2, 6)}. {self.sentences(1, 1)}</p>"]) + (self.links() if r.random() < 0.4 else ""), "links")

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.7:
            text = self.sentences(1, 7)
            if r.random() < 0.3:
                text = text.replace(" ", f" <{r.choice(['b', 'em', 'i', 'strong', 'span'])}>", 1)
            if r.random() < 0.25:
                text += " " + self.link(1, 3) + "."
            return f"<p>{text}" + ("</p>" if r.random() < 0.9 else "<br>")
        if kind < 0.8:
            return self.element(["h2", "h3"], self.words(1, 7))
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{self.words(2, 12)}{r.choice(['', '.'])}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{self.sentences(1, 3)}</blockquote>"
        if kind < 0.94:
            return f"<figure><img src=x><figcaption>{self.sentences(1, 1)}</figcaption></figure>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<pre>{self.words(5, 20)}</pre>"

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            parts.append(f"<h1>{self.words(2, 10)}</h1>")
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            parts.append(self.block())
            if r.random() < 0.06:
                parts.append(self.part(r.choice(["ad", "ad", "share", "side", "form", "notice"])))
        if r.random() < 0.15:
            parts.append(self.part(r.choice(["comments", "share", "comments"])))
        if r.random() < 0.12:
            parts = [self.sentences(1, 3) + "<br><br>" for _ in range(r.randint(1, 4))]
        inner = "".join(parts)
        if r.random() < 0.25:
            inner = f"<div>{inner}</div>"
        return self.named(["article", "article", "main", "div", "div", "div", "section", "td"], MAIN, inner, "main")

    def page(self) -> str:
        r = self.r
        some = lambda p, *kinds: "".join(self.part(k) for k in kinds if r.random() < p)
        before = some(0.2, "notice") + some(0.6, "head") + some(0.75, "menu") + some(0.35, "ad") + some(0.15, "form")
        if r.random() < 0.15:
            before = ""
        middle = [self.article(), some(0.35, "side")]
        if r.random() < 0.3:
            middle.reverse()
        after = some(0.3, "comments") + some(0.25, "side", "share", "ad", "form") + some(0.85, "foot") + some(0.15, "notice")
        inner = "".join(middle)
        if r.random() < 0.5:
            inner = f'<div{r.choice([" class=wrapper", " id=page", "", " class=container"])}>{inner}</div>'
        body = before + inner + (after if r.random() < 0.9 else "")
        if r.random() < 0.1:
            body = f"<form id=aspnetForm>{body}</form>"
        return f"<html><head><title>{self.words(2, 8)}</title><script>x='<p>'</script></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    build = Builder(seed)
    return [build.page() for _ in range(n)]
