"""Generated pages whose main text is known, to train the extraction on."""

from __future__ import annotations

import numpy as np

_SYLLABLES = "ba de ki lo mu ra se ti vo na the er an st in re al de la mi con per tra lin gra é ü ñ".split()
MAIN = "article post content entry story main body text prose page single detail blog news".split()
OTHER = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links mainmenu tabs pager pagination toc".split(),
    "header": "header masthead top brand logo sitename topbar branding hero tagline".split(),
    "footer": "footer foot copyright legal bottom colophon credits imprint siteinfo".split(),
    "aside": "sidebar side aside widget rail related popular trending recommended more teaser author bio tags".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay paywall message warning privacy disclaimer announcement".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner promotion adsense commercial".split(),
    "form": "newsletter subscribe search signup login register contact form poll survey".split(),
    "comments": "comments comment reply replies discussion respond thread disqus reader feedback responses".split(),
    "share": "share social sharing toolbar buttons follow like print meta actions".split(),
}
_PHRASES = ["Home", "About us", "Contact", "Log in", "Privacy policy", "Read more", "Next", "Subscribe", "Share", "All rights reserved", "Reply", "Terms"]


_maker = np.random.default_rng(3)
_LEXICON = np.array(["".join(_maker.choice(_SYLLABLES, _maker.integers(1, 4))) for _ in range(3000)], dtype=object)


def _word(rng) -> str:
    return _LEXICON[rng.integers(len(_LEXICON))]


def _sentence(rng, least: int = 1, most: int = 22) -> str:
    words = _LEXICON[rng.integers(0, len(_LEXICON), rng.integers(least, most + 1))].tolist()
    if rng.random() < 0.05:
        words = [w + str(rng.choice(["$$$", "###", " |", "!!", ",", " 12", "&amp;"])) for w in words]
    text = " ".join(words)
    return (text.upper() if rng.random() < 0.03 else text.capitalize()) + str(rng.choice([".", ".", ".", "!", "?", "", "", ","]))


def _prose(rng, most: int = 7) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.integers(1, most + 1)))


def _attributes(rng, names: list[str]) -> str:
    if rng.random() < 0.12:
        return ""
    parts = [str(rng.choice(names))]
    if rng.random() < 0.4:
        parts.insert(0, str(rng.choice(["site", "page", "block", "box", "wrap", "js", "col", "container", "inner", "c", "list"])))
    if rng.random() < 0.3:
        parts.append(str(rng.choice(["wrapper", "inner", "box", "1", "list", "item", "area", "section"])))
    value = str(rng.choice(["-", "_", " "])).join(parts)
    return f' {rng.choice(["class", "class", "class", "id"])}="{value}"'


def _links(rng) -> str:
    items = [f'<li><a href="/{k}">{rng.choice(_PHRASES) if rng.random() < 0.5 else _word(rng)}</a></li>' for k in range(rng.integers(2, 10))]
    if rng.random() < 0.3:
        return " ".join(x[4:-5] for x in items)
    return f"<ul>{''.join(items)}</ul>"


def _other(rng, kind: str) -> str:
    tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog"],
           "ad": ["div", "div", "aside", "section"], "form": ["form", "div", "section"], "comments": ["section", "div", "div"], "share": ["div", "ul"]}[kind]
    tag = str(rng.choice(tag))
    names = OTHER[kind]
    if kind == "nav":
        inner = _links(rng)
    elif kind == "header":
        inner = f"<{(h := rng.choice(['h1', 'div', 'p', 'h2']))}>{_sentence(rng, 1, 4)}</{h}>" + (_links(rng) if rng.random() < 0.5 else "")
    elif kind == "footer":
        inner = f"&copy; {_word(rng)} &middot; {_sentence(rng, 2, 14)}" if rng.random() < 0.6 else f"<p>&copy; {_sentence(rng, 1, 8)}</p>{_links(rng)}"
    elif kind == "aside":
        inner = f"<h3>{_sentence(rng, 1, 4)}</h3>" + (_links(rng) if rng.random() < 0.6 else f"<p>{_prose(rng, 3)}</p>" * 1)
    elif kind in ("notice", "ad"):
        inner = _prose(rng, 3) if rng.random() < 0.6 else f"<p>{_prose(rng, 2)}</p><a href=x>{rng.choice(_PHRASES)}</a>"
    elif kind == "form":
        inner = f"<p>{_sentence(rng, 2, 10)}</p><label>{_word(rng)}</label><input name=q><button>{rng.choice(_PHRASES)}</button>"
        inner = inner if tag == "form" else f"<form action=/s>{inner}</form>"
    elif kind == "comments":
        each = str(rng.choice(["div", "li", "article"]))
        many = "".join(f"<{each}{_attributes(rng, names)}><p>{_word(rng)}</p><p>{_prose(rng, 3)}</p></{each}>" for _ in range(rng.integers(1, 6)))
        inner = f"<h3>{_sentence(rng, 1, 3)}</h3>{f'<ol>{many}</ol>' if each == 'li' else many}"
    else:
        inner = " ".join(f"<a href=x>{rng.choice(_PHRASES)}</a>" for _ in range(rng.integers(1, 5)))
    attributes = _attributes(rng, names)
    if tag in ("div", "section", "ul", "dialog") and not attributes:
        attributes = f' class="{rng.choice(names)}"'
    return f"<{tag}{attributes}>{inner}</{tag}>"


def _main(rng) -> list[str]:
    """Blocks of main text, as markup."""
    out = []
    if rng.random() < 0.85:
        h = rng.choice(["h1", "h1", "h1", "h2"])
        out.append(f"<{h}>{_sentence(rng, 1, 16)}</{h}>")
    for _ in range(rng.integers(0, int(rng.choice([3, 8, 14, 25])))):
        kind = rng.random()
        if kind < 0.68:
            out.append(f"<p>{_prose(rng, int(rng.choice([1, 3, 7, 30])))}</p>" if rng.random() < 0.8 else f"<p>{_sentence(rng, 1, 3)}</p>")
        elif kind < 0.76:
            out.append(f"<p><b>{_prose(rng)}<br>")
        elif kind < 0.82:
            out.append(f"<h2>{_sentence(rng, 1, 7)}</h2>")
        elif kind < 0.87:
            out.append("<ul>" + "".join(f"<li>{_sentence(rng, 1, 15)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
        elif kind < 0.91:
            out.append(f"<blockquote><p>{_prose(rng, 3)}</p></blockquote>")
        elif kind < 0.94:
            out.append("<table>" + "".join(f"<tr><td>{_word(rng)}</td><td>{_sentence(rng, 1, 5)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.97:
            out.append(f'<p>{_sentence(rng)} <a href="/x">{_word(rng)} {_word(rng)}</a> {_sentence(rng)}</p>')
        else:
            out.append(f"<div>{_prose(rng, 3)}</div>")
    return out


def sample(rng) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    from .html_extract import parse

    blocks = _main(rng) if rng.random() < 0.96 else []
    main = {t for t in parse("".join(blocks)).text if t}
    inside, often = [], float(rng.choice([0.0, 0.05, 0.3]))
    for b in blocks:
        inside.append(b)
        if rng.random() < often:
            inside.append(_other(rng, str(rng.choice(["ad", "share", "aside", "form", "notice"]))))
    if rng.random() < 0.15:
        inside.append(_other(rng, str(rng.choice(["share", "comments", "aside"]))))
    body = "".join(inside)
    if blocks:
        tag = str(rng.choice(["article", "article", "article", "main", "div", "section"]))
        attributes = _attributes(rng, MAIN) if tag == "div" or rng.random() < 0.4 else ""
        body = f"<{tag}{attributes}>{body}</{tag}>"
        if rng.random() < 0.2:
            body = f"<main>{body}</main>"
    before = [_other(rng, k) for k in ("notice", "header", "nav", "ad", "form", "share") if rng.random() < 0.4]
    after = [_other(rng, k) for k in ("share", "aside", "ad", "comments", "form", "nav", "notice", "footer") if rng.random() < 0.35]
    if rng.random() < 0.25:
        before.append(_other(rng, "aside"))
    if rng.random() < 0.5:  # the plain layout: menu, advert, text, footer
        before, after = [_other(rng, "nav"), _other(rng, "ad")], [_other(rng, "footer")]
    else:
        rng.shuffle(before)
    page = "".join(before) + body + "".join(after)
    for _ in range(rng.integers(0, 2)):
        page = f"<div{_attributes(rng, ['container', 'wrapper', 'page', 'layout', 'site'])}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{_sentence(rng, 1, 6)}</title><script>var a='<p>';</script></head><body>{page}</body></html>", main
