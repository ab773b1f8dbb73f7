"""Synthetic labelled pages that train the block labeller of html_extract.

Pages are drawn from a small grammar: a body with a header, menus, side columns,
notices, adverts, forms, the article, reader comments and a footer, in varying
order, nesting, tags and class names. Words are invented, so that the labeller
learns from structure, not from a vocabulary. Article blocks are marked by an
attribute that the reader of features never sees.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber chi do er fa gen ho in ka lo men ni or pra qui re son ti un ver wa yo zu ett ing lle é ü ñ".split()

#: Names by which real pages mark their parts (fixed word lists).
PARTS = {
    "header": ("header site-header masthead top-bar branding page-header banner-top", "header div"),
    "menu": ("nav menu navbar main-menu navigation breadcrumb breadcrumbs topnav links pagination tabs", "nav div ul"),
    "side": ("sidebar side aside widget related widget-area right-column secondary recommended trending popular more-stories tags", "aside div section"),
    "notice": ("cookie cookie-notice notice alert banner gdpr consent popup modal newsletter subscribe-box overlay message", "div section aside p"),
    "advert": ("ad ads advert advertisement sponsored promo banner-ad adsbox sponsor promotion google-ad", "div section aside p a"),
    "form": ("form search search-form login signup contact-form subscribe newsletter-form comment-form", "form div"),
    "comments": ("comments comment-list commentlist responses discussion replies user-comments disqus reader-comments", "section div ol"),
    "footer": ("footer site-footer bottom copyright page-footer legal colophon credits", "footer div"),
}
ARTICLE = ("article content post entry-content main story post-body article-body text body-text page-content", "article main div section")
NEUTRAL = "wrap container row col inner box block x1 c-2 layout outer grid group".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _text(r: random.Random, low: int, high: int, cues: tuple = ()) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    if cues and r.random() < 0.5:
        words.insert(r.randint(0, len(words)), r.choice(cues))
    out = " ".join(words).capitalize()
    return out + ("." if r.random() < 0.7 else "")


def _attrs(r: random.Random, names: str, sure: bool) -> str:
    if not sure and r.random() < 0.35:
        return f' class="{r.choice(NEUTRAL)}"' if r.random() < 0.5 else ""
    name = r.choice(names.split())
    if r.random() < 0.3:
        name += " " + r.choice(NEUTRAL)
    return f' {r.choice(("class", "class", "id"))}="{name}"'


def _links(r: random.Random) -> str:
    items = [f'<a href="/{_word(r)}">{_text(r, 1, 3)}</a>' for _ in range(r.randint(2, 8))]
    kind = r.random()
    if kind < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return (" | ".join(items)) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in items)


def part(r: random.Random, kind: str) -> str:
    names, tags = PARTS[kind]
    tag = r.choice(tags.split())
    semantic = tag in ("header", "nav", "aside", "footer", "form")
    attrs = _attrs(r, names, not semantic)
    if kind == "menu":
        body = _links(r) if tag != "ul" else "".join(f'<li><a href="#">{_text(r, 1, 3)}</a></li>' for _ in range(r.randint(2, 8)))
    elif kind == "header":
        body = f"<div>{_text(r, 1, 5)}</div>" * (r.random() < 0.7) + (_links(r) if r.random() < 0.6 else f"<p>{_text(r, 2, 9)}</p>")
    elif kind == "side":
        body = f"<h3>{_text(r, 1, 4)}</h3>" * (r.random() < 0.7) + (_links(r) if r.random() < 0.6 else f"<p>{_text(r, 5, 40)}</p>" * r.randint(1, 2))
    elif kind == "notice":
        body = _text(r, 5, 25, ("cookies", "privacy", "accept", "subscribe")) if r.random() < 0.6 else f"<p>{_text(r, 5, 25, ('cookies',))}</p><button>{_text(r, 1, 2)}</button>"
    elif kind == "advert":
        body = _text(r, 3, 30, ("buy", "sale", "offer")) if r.random() < 0.7 else f'<p>{_text(r, 3, 20)}</p><a href="#">{_text(r, 1, 4)}</a>'
    elif kind == "form":
        body = f'<label>{_text(r, 1, 3)}</label><input name="q"><button>{_text(r, 1, 2)}</button>' + f"<p>{_text(r, 3, 12)}</p>" * (r.random() < 0.4)
    elif kind == "comments":
        one = lambda: f'<{"li" if tag == "ol" else "div"} class="{r.choice(("comment", "reply", "c", "response"))}"><b>{_text(r, 1, 2)}</b><p>{_text(r, 4, 60)}</p></{"li" if tag == "ol" else "div"}>'
        body = f"<h3>{_text(r, 1, 3, ('comments',))}</h3>" * (r.random() < 0.6 and tag != "ol") + "".join(one() for _ in range(r.randint(1, 5)))
    else:
        body = f"<p>{_text(r, 3, 30, ('copyright', 'reserved'))}</p>" if r.random() < 0.4 else "&copy; " + _text(r, 3, 30) if r.random() < 0.6 else _links(r) + f"<p>{_text(r, 3, 12)}</p>"
    return f"<{tag}{attrs}>{body}</{tag}>"


def article(r: random.Random) -> str:
    names, tags = ARTICLE
    tag = r.choice(tags.split())
    good = ' data-gold="1"'
    out = []
    if r.random() < 0.85:
        out.append(f"<h1{good}>{_text(r, 1, 12)}</h1>")
    for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14, 24, 40))):
        kind = r.random()
        if kind < 0.68:
            inner = _text(r, 1, r.choice((1, 3, 8, 30, 90, 90)))
            if r.random() < 0.25:
                inner += f' <a href="#">{_text(r, 1, 4)}</a> <em>{_text(r, 1, 6)}</em> ' + _text(r, 1, 20)
            if r.random() < 0.15:
                out.append(f"<p{good}><b>{inner}<br>")
            else:
                out.append(f"<p{good}>{inner}</p>")
        elif kind < 0.76:
            out.append(f"<h2{good}>{_text(r, 1, 8)}</h2>")
        elif kind < 0.84:
            t = r.choice(("ul", "ol"))
            out.append(f"<{t}>" + "".join(f"<li{good}>{_text(r, 2, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
        elif kind < 0.88:
            out.append(f"<blockquote{good}>{_text(r, 5, 40)}</blockquote>")
        elif kind < 0.91:
            out.append(f"<div{good}>{_text(r, 5, 60)}</div>")
        elif kind < 0.94:
            out.append("<table>" + "".join(f"<tr><td{good}>{_text(r, 1, 3)}</td><td{good}>{_text(r, 1, 3)}</td></tr>" for _ in range(2)) + "</table>")
        elif kind < 0.96:
            out.append(f"<pre{good}>{_text(r, 5, 30)}</pre>")
        else:
            out.append(part(r, r.choice(("advert", "side", "form", "notice", "advert"))))
    if r.random() < 0.12:
        out.append(part(r, "comments"))
    sure = tag in ("div", "section") and r.random() < 0.75
    return f"<{tag}{_attrs(r, names, sure) if sure or r.random() < 0.5 else ''}>{''.join(out)}</{tag}>"


def page(r: random.Random) -> str:
    before = [part(r, k) for k, p in (("header", 0.5), ("menu", 0.75), ("notice", 0.3), ("form", 0.2), ("advert", 0.45), ("side", 0.25)) if r.random() < p]
    after = [part(r, k) for k, p in (("side", 0.4), ("advert", 0.2), ("comments", 0.45), ("form", 0.15), ("notice", 0.2), ("menu", 0.1), ("footer", 0.85)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(before)
    middle = article(r)
    if r.random() < 0.3:
        middle = f'<div class="{r.choice(NEUTRAL)}">{middle}{after.pop(0) if after and r.random() < 0.4 else ""}</div>'
    return f"<html><head><title>{_text(r, 2, 8)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
