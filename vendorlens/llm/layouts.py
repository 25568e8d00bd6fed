"""Labelled pages to train the main-text model on.

Pages are put together from layouts labelled by hand: ``data-main="1"`` marks the article, ``data-main="0"`` what stands
inside it without belonging to it. Words are invented, so that the model learns places and shapes, not a topic.
"""

import random
import re

_SYLLABLES = ["ka", "lo", "mi", "ter", "an", "ve", "sun", "dor", "el", "pra", "ti", "on", "ges", "ur", "ma", "qui", "é", "ßen", "ño", "der"]

#: Layouts around an article; {} is the article.
MAIN = [
    '<article data-main="1">{}</article>',
    '<main><article data-main="1">{}</article></main>',
    '<main data-main="1">{}</main>',
    '<main id="main"><div class="container"><div class="post" data-main="1">{}</div></div></main>',
    '<div id="content" data-main="1">{}</div>',
    '<div class="wrapper"><div class="content-area"><div class="entry-content" data-main="1">{}</div></div></div>',
    '<div class="article-body" itemprop="articleBody" data-main="1">{}</div>',
    '<section class="story" data-main="1">{}</section>',
    '<table><tr><td class="left"><ul><li><a href="/">Aba</a></li><li><a href="/x">Lomi</a></li></ul></td><td class="main" data-main="1">{}</td></tr></table>',
    '<div role="main"><div data-main="1">{}</div></div>',
    '<div id="primary" data-main="1">{}</div>',
    '<div class="post-text markdown-body" data-main="1">{}</div>',
    '<div class="content" data-main="1">{}</div>',
    '<div class="page"><div class="main-content" data-main="1">{}</div></div>',
    '<article class="post hentry" data-main="1"><div class="entry-content">{}</div></article>',
]
#: Layouts whose elements have no telling name.
PLAIN = [
    '<div data-main="1">{}</div>',
    '<div><div data-main="1">{}</div></div>',
    '<div class="x1f"><div class="k9" data-main="1">{}</div></div>',
    '<div class="row"><div class="col-8" data-main="1">{}</div></div>',
    '<section data-main="1">{}</section>',
    '<table width="100%"><tr><td data-main="1">{}</td></tr></table>',
]
#: Elements around a whole page.
AROUND = ["", "", "", '<div id="page">{}</div>', '<div class="wrapper">{}</div>', '<div class="container">{}</div>', '<div id="site">{}</div>', '<div id="root"><div class="app">{}</div></div>', '<div>{}</div>']

#: Pieces that are not the article; L a link text, S a sentence, W a word.
BEFORE = [
    '<header><div class="logo"><a href="/">W W</a></div><p>S</p></header>',
    '<header class="site-header"><h1>W W</h1><nav><ul><li><a href="/">L</a></li><li><a href="/">L</a></li><li><a href="/">L</a></li></ul></nav></header>',
    '<nav><ul><li><a href="/a">L</a></li><li><a href="/b">L</a></li><li><a href="/c">L</a></li><li><a href="/d">L</a></li></ul></nav>',
    '<div class="menu"><a href="/">L</a> | <a href="/">L</a> | <a href="/">L</a></div>',
    '<div id="top-menu"><ul><li><a href="/">L</a><li><a href="/">L</a><li><a href="/">L</a></ul></div>',
    '<div class="breadcrumbs"><a href="/">L</a> &gt; <a href="/">L</a> &gt; W</div>',
    '<ol class="breadcrumb"><li><a href="/">L</a></li><li>W</li></ol>',
    '<div class="cookie-notice"><p>S S</p><button>W</button></div>',
    '<div id="cookie-consent" role="dialog"><p>S</p><a href="/p">L</a></div>',
    '<div class="notice">S</div>', '<div class="alert" role="alert"><p>S S</p></div>',
    '<div class="banner">S S</div>', '<div class="ad">S</div>', '<div class="ads"><p>S</p></div>',
    '<div class="advert"><a href="/">S</a></div>', '<div id="ad-top"><p>S S S</p></div>',
    '<a class="skip-link" href="#main">W W</a>', '<div class="masthead"><h2>W W</h2><span>S</span></div>',
    '<form class="search" action="/s"><label>W</label><input name="q"></form>',
    '<div id="header"><h1><a href="/">W W</a></h1><p>S</p></div>',
    '<div class="top-bar"><span>W</span><span>W W</span></div>',
    '<div class="hero-promo"><h2>W W W</h2><p>S S</p></div>',
]
SIDE = [
    '<aside><h3>W W</h3><ul><li><a href="/">L</a></li><li><a href="/">L</a></li></ul></aside>',
    '<aside class="sidebar"><h2>W</h2><p>S S</p><p>S</p></aside>',
    '<div class="sidebar"><div class="widget"><h4>W W</h4><p>S S S</p></div></div>',
    '<div id="sidebar"><p>S</p><ul><li>W W</li><li>W W</li></ul></div>',
    '<div class="right-rail"><h3>W</h3><p><a href="/">S</a></p></div>',
    '<section class="related"><h3>W W</h3><ul><li><a href="/">S</a></li><li><a href="/">S</a></li></ul></section>',
    '<div class="recommended"><h3>W</h3><p><a href="/">S</a></p></div>',
    '<div class="promo sponsored"><p>S S</p></div>', '<aside class="ad-slot"><p>S</p></aside>', '<aside><p>S S</p></aside>',
]
INSIDE = [
    '<div class="ad" data-main="0"><p>S</p></div>', '<div class="advertisement" data-main="0">S</div>',
    '<aside class="related" data-main="0"><p><a href="/">S</a></p></aside>', '<aside data-main="0"><p>S S</p></aside>',
    '<div class="share social" data-main="0"><a href="/">W</a> <a href="/">W</a></div>',
    '<form class="newsletter" data-main="0"><p>S</p><label>W <input></label></form>',
    '<div class="subscribe-box" data-main="0"><h3>W W</h3><p>S S</p></div>',
    '<div class="notice" data-main="0">S</div>', '<nav class="toc" data-main="0"><ol><li><a href="#a">L</a></li><li><a href="#b">L</a></li></ol></nav>',
    '<div class="sponsor" data-main="0"><p>S S</p></div>', '<div class="promo" data-main="0"><p>S</p></div>',
]
COMMENTS = [
    '<section class="comments" data-main="0"><h2>W</h2><div class="comment"><b>W</b><p>S S</p></div><div class="comment"><p>S S S</p></div></section>',
    '<section id="comments" data-main="0"><h3>2 W</h3><article class="comment"><p>S S S</p></article><article class="comment"><p>S</p></article></section>',
    '<div id="comments" data-main="0"><ol class="commentlist"><li><p>S S</p></li><li><p>S S S S</p></li></ol></div>',
    '<ul class="comment-list" data-main="0"><li>S S</li><li>S</li><li>S S S</li></ul>',
    '<div class="discussion responses" data-main="0"><div class="reply"><p>S S</p></div><div class="reply"><p>S S S</p></div></div>',
    '<div class="user-comments" data-main="0"><p>S</p><p>S S</p><p>S S S</p></div>',
    '<div class="reader-comments" data-main="0"><div><p>S S</p></div><div><p>S</p></div></div>',
]
AFTER = [
    '<footer><p>&copy; 2021 W W</p></footer>', '<footer>&copy; W.example &middot; S</footer>', '<footer><p>S S</p><ul><li><a href="/">L</a></li></ul></footer>',
    '<div id="footer"><p>&copy; 2019 W. S</p><a href="/">L</a></div>', '<div class="site-footer"><div>S</div><div>S S</div></div>',
    '<div class="footer"><a href="/">L</a> | <a href="/">L</a></div>', '<div class="legal">S S S</div>', '<div class="copyright">&copy; W</div>',
    '<form id="login"><p>S</p><label>W</label><input></form>', '<form action="/c"><h3>W W W</h3><p>S</p><label>W<input></label></form>',
    '<div class="newsletter-signup"><h3>W W</h3><p>S S</p></div>', '<div class="pagination"><a href="/">1</a> <a href="/">2</a></div>',
    '<div class="tags">W, <a href="/">L</a>, <a href="/">L</a></div>', '<div class="modal popup"><p>S S</p></div>',
    '<div class="disclaimer"><p>S S S</p></div>', '<div><p>(c) 2001 W. S</p></div>', '<div role="contentinfo"><p>S</p></div>',
]


#: Names that pages give to what is not the article, by its kind; each is used as class or id, alone or with another word.
NAMES = {
    "menu": "nav navbar navigation menu main-menu topnav nav-links mega-menu breadcrumb pager pagination toolbar tab-bar language-switcher sitemap".split(),
    "head": "header masthead top topbar site-title logo brand tagline branding page-head".split(),
    "foot": "footer foot bottom colophon copyright legal imprint site-info credits disclaimer terms".split(),
    "side": "sidebar side aside widget widget-area rail column-right related recommended popular trending more-stories recent-posts archive blogroll teaser read-next also".split(),
    "note": "notice alert cookie cookies consent gdpr privacy-banner announcement message warning info-bar overlay modal popup paywall hint".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion promoted commercial adsense partner offer".split(),
    "form": "form newsletter subscribe subscription signup sign-up login register search contact poll survey feedback".split(),
    "talk": "comment comments comment-list replies reply respond responses discussion thread user-comments reader-comments guestbook".split(),
    "share": "share sharing social social-links follow like-buttons tools print".split(),
}
#: Shapes of such blocks; N the name in an attribute.
SHAPES = {
    "menu": ['<div N><a href="/">L</a> <a href="/">L</a> <a href="/">L</a></div>', '<ul N><li><a href="/">L</a></li><li><a href="/">L</a></li></ul>', '<div N><span>W</span> / <a href="/">L</a></div>'],
    "head": ['<div N><h1>W W</h1><p>S</p></div>', '<header N><a href="/">W W</a><p>S</p></header>', '<div N>W W</div>'],
    "foot": ['<div N><p>&copy; 2020 W</p></div>', '<div N><p>Copyright 2020 W. All rights reserved.</p></div>', '<div><p>Copyright W 1999</p></div>', '<div N>S</div>', '<section N><p>S S</p><a href="/">L</a></section>', '<footer N><div>S</div></footer>'],
    "side": ['<div N><h3>W W</h3><p>S S</p></div>', '<aside N><p>S</p><p>S S</p></aside>', '<section N><h2>W</h2><ul><li><a href="/">S</a></li><li>S</li></ul></section>', '<div N><p>S S S</p></div>'],
    "note": ['<div N>S</div>', '<div N><p>S S</p></div>', '<section N><p>S</p><p>S</p></section>', '<p N>S</p>'],
    "ad": ['<div N>S</div>', '<div N><p>S S</p></div>', '<aside N><p>S S</p></aside>', '<p N>S S</p>', '<div N><a href="/">S</a></div>'],
    "form": ['<form N><p>S</p><label>W <input></label></form>', '<div N><form><h3>W W</h3><p>S S</p><input></form></div>', '<div N><p>S</p></div>', '<form N>S<input></form>'],
    "talk": ['<div N><p>S S</p><p>S S S</p></div>', '<section N><h2>W</h2><div><p>S S</p></div><div><p>S</p></div></section>', '<ul N><li>S S</li><li><p>S</p></li></ul>',
             '<ol N><li><b>W</b><p>S S</p></li><li><p>S S S</p></li></ol>', '<div N><blockquote>S S</blockquote><p>S</p></div>'],
    "share": ['<div N><a href="/">W</a> <a href="/">W</a></div>', '<p N><a href="/">W W</a></p>', '<ul N><li><a href="/">W</a></li></ul>'],
}


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def word(self):
        return "".join(self.random.choices(_SYLLABLES, k=self.random.randint(1, 4)))

    def sentence(self):
        style, words = self.random.random(), [self.word() for _ in range(self.random.randint(3, 22))]
        if style < 0.06:
            return " ".join(w.upper() + "!!" for w in words)
        if style < 0.12:
            return " ".join(w + self.random.choice(["$$$", "###", "&amp;&amp;", "%%%"]) for w in words)
        if style < 0.16:
            return " | ".join(words)
        if style < 0.2:
            return " ".join([words[0]] * len(words))
        return " ".join(words).capitalize() + self.random.choice([".", ".", ".", "?", "!", ""])

    def filled(self, piece: str):
        """S, L and W as words of their own become text."""
        out, at = [], 0
        while at < len(piece):
            c = piece[at]
            alone = not (piece[at - 1:at].isalnum() or piece[at + 1:at + 2].isalnum())
            if c in "SLW" and alone:
                out.append(self.sentence() if c == "S" else " ".join(self.word().capitalize() for _ in range(self.random.randint(1, 2 + (c == "L")))))
            else:
                out.append(c)
            at += 1
        return "".join(out)

    def aside(self, kind: str, inside: bool = False):
        """A block that is not the article, of one kind, under one of its names."""
        pick, name = self.random.random, self.random.choice(NAMES[kind])
        name = name if pick() < 0.6 else f"{self.word()}{self.random.choice('-_')}{name}"
        name = name if pick() < 0.85 else f"{name} {self.word()}"
        name = "".join(p.capitalize() if k else p for k, p in enumerate(name.split("-"))) if pick() < 0.15 and " " not in name else name
        attribute = f'{self.random.choice(["class", "class", "id"])}="{name}"' + ' data-main="0"' * inside
        return self.filled(self.random.choice(SHAPES[kind])).replace(" N>", f" {attribute}>", 1)

    def paragraph(self):
        text = " ".join(self.sentence() for _ in range(self.random.choice([1, 1, 2, 3, 5, 8])))
        if self.random.random() < 0.2:
            text += f' <a href="/r">{self.word()}</a> {self.sentence()}'
        return text

    def article(self):
        pick, out = self.random.random, []
        if pick() < 0.85:
            name = self.random.choice(["", "", "", ' class="entry-title"', ' class="post-title"', ' class="headline"', ' class="title"', ' id="article-title"'])
            out.append(f"<{(h := self.random.choice(['h1', 'h1', 'h2']))}{name}>{self.sentence() if pick() < 0.6 else self.word()}</{h}>")
        for _ in range(self.random.choice([1, 2, 3, 5, 8, 13])):
            kind, text = pick(), self.paragraph()
            if kind < 0.6:
                out.append(f"<p>{text}</p>")
            elif kind < 0.62:
                out.append(f'<p class="{self.random.choice(["lead", "intro", "summary", "text", "first"])}">{text}</p>')
            elif kind < 0.72:
                out.append(f"<p><b>{text}<br><p>{self.paragraph()}</p>")
            elif kind < 0.77:
                out.append(f"<h2>{self.word().capitalize()} {self.word()}</h2><p>{text}</p>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.89:
                out.append(f"<div>{text}</div>")
            elif kind < 0.92:
                out.append(f"<table><tr><th>{self.word()}</th><td>{self.sentence()}</td></tr></table>")
            elif kind < 0.94:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.96:
                out.append(f"<figure><img src='/i.png'><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                out.append(text + "<br>" + self.paragraph() + "<p>")
            if pick() < 0.08:  # articles quote such lines too
                out.append("<p>" + self.filled(self.random.choice(["All rights reserved.", "Copyright 2020 W. S", "&copy; W W", "Released under the W License."])) + "</p>")
            if pick() < 0.18:
                out.append(self.filled(self.random.choice(INSIDE)) if pick() < 0.4 else self.aside(self.random.choice(["side", "note", "ad", "form", "share", "menu"]), True))
        body = "".join(out)
        if pick() < 0.08:
            body = f"<header>{out[0]}</header>{''.join(out[1:])}"
        elif pick() < 0.1:
            body = f"<section>{body}</section><section><h2>{self.word()}</h2><p>{self.paragraph()}</p></section>"
        return body

    def page(self):
        choose, pick = self.random.choice, self.random.random

        def some(pieces, kinds, most):
            return [self.filled(choose(pieces)) if pick() < 0.5 else self.aside(choose(kinds)) for _ in range(self.random.randint(0, most))]

        parts = some(BEFORE, ["menu", "head", "note", "ad", "form"], 4)
        if pick() < 0.2:
            parts += some(SIDE, ["side"], 1)
        inner = self.article()
        talk, inside = pick() < 0.4, pick() < 0.3
        comments = "" if not talk else self.filled(choose(COMMENTS)) if pick() < 0.5 else self.aside("talk", True)
        parts.append(choose(PLAIN if pick() < 0.35 else MAIN).format(inner + (comments if inside else "")))
        if comments and not inside:
            parts.append(comments)
        if pick() < 0.35:
            parts += some(SIDE, ["side", "ad"], 2)
        parts += some(AFTER, ["foot", "form", "note", "share", "menu"], 3)
        head = f"<!DOCTYPE html><html><head><title>{self.word()}</title></head>"
        if pick() < 0.12:  # no element around the article
            at = next(i for i, p in enumerate(parts) if inner in p)
            parts = [inner + (comments if inside else "") if i == at else re.sub("(<[a-z]+)", r'\1 data-main="0"', p, count=1) for i, p in enumerate(parts)]
            return f'{head}<body data-main="1">{"".join(parts)}</body></html>'
        around = choose(AROUND) or "{}"
        return f"{head}<body>{around.replace('{}', ''.join(parts))}</body></html>"


def labelled_pages(pages: int, seed: int = 7) -> list:
    """``pages`` pages, the same for the same seed."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(pages)]
