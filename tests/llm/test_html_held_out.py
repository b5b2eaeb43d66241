"""Main text on pages that were written and labelled by hand, with no part of them in the table that the tree is grown from.

The tree's settings and the kinds of parts in its table were chosen while looking at PAGES, which are therefore no estimate
of what it gets wrong elsewhere. FRESH were written afterwards and run once: nine of the ten came out right, and nothing was changed for the tenth."""

import re

import numpy as np
import pytest

from gridloom.llm import html_blocks as hb

A = "Glass was blown in this valley for three hundred years before the railway came and the furnaces moved south to the coal."
B = "The last master kept his tools in a shed behind the chapel, where his grandson found them wrapped in oilcloth and newspapers."
C = "Most of the moulds were pear wood, soaked overnight so that the steam would keep the hot glass from sticking to the grain."
D = "A museum now shows the work on Saturdays, and visitors may try a bubble of their own if the season is not too dry."

#: Every block that is main text begins with an asterisk; nothing else does.
PAGES = {
    "cards below a named wrapper": f"<div id=content><h1>*Glass</h1><p>*{A}</p><p>*{B}</p></div><section><h2>Keep reading</h2><article><a href=/1>Pottery in the north</a></article><article><a href=/2>Weavers of the coast</a></article></section>",
    "one card": f"<div class=post><h1>*Glass</h1><p>*{A}</p><p>*{C}</p></div><div><article><a href=/x>Pottery in the north</a></article></div>",
    "cards before the story": f"<section><article><h3><a href=/x>Pottery</a></h3><p>What the kilns of the north still make.</p></article></section><div class=story><h1>*Glass</h1><p>*{A}</p><p>*{D}</p></div>",
    "cards with summaries": f"<div id=main><h1>*Glass</h1><p>*{A}</p><p>*{B}</p><p>*{D}</p></div><section><article><h3><a href=/x>Pottery</a></h3><p>What the kilns of the north still make.</p></article><article><h3><a href=/y>Weavers</a></h3><p>A loom for every house.</p></article></section>",
    "list word on a wrapper": f"<article><h1>*Glass</h1><div class='text more'><p>*{A}</p><p>*{B}</p></div></article>",
    "form word on a wrapper": f"<nav><a href=/>Home</a></nav><article><h1>*Glass</h1><div class=form-letter><p>*{C}</p><p>*{B}</p></div></article>",
    "sidebar word on the page": f"<div class='site right-sidebar'><nav><a href=/>Home</a></nav><article><h1>*Glass</h1><p>*{A}</p><p>*Short.</p></article><div class=sidebar><p>{D}</p></div></div>",
    "share bar first": f"<article><div class=social-share><a href=#>Post</a> <a href=#>Mail</a></div><h1>*Glass</h1><p>*{A}</p><p>*{C}</p></article>",
    "advert first": f"<article><div class=ad>Two lamps for the price of one, only until the end of the month.</div><h1>*Glass</h1><p>*{B}</p></article>",
    "advert slot between": f"<article><h1>*Glass</h1><p>*{A}</p><div class=dfp-slot>Two lamps for the price of one, this week only.</div><p>*{C}</p></article>",
    "links without a name inside": f"<article><h1>*Glass</h1><p>*{A}</p><p>*{B}</p><ul><li><a href=/1>Pottery in the north</a></li><li><a href=/2>Weavers</a></li><li><a href=/3>A short history of soap</a></li><li><a href=/4>Salt</a></li></ul></article>",
    "a linked line inside": f"<article><h1>*Glass</h1><p>*{A}</p><p><a href=/1>*{B}</a></p><p>*{C}</p></article>",
    "comments in article elements": f"<main><h1>*Glass</h1><p>*{A}</p><p>*{B}</p></main><ol><li><article><p>My aunt had one of these. {C}</p></article></li><li><article><p>Lovely!</p></article></li></ol>",
    "comments in a named list": f"<article><h1>*Glass</h1><p>*{A}</p><p>*{C}</p><section id=comments><article><p>{B}</p></article><article><p>Lovely!</p></article></section></article>",
    "no element and no name": f"<div><a href=/>Home</a> <a href=/a>Crafts</a> <a href=/b>Shop</a></div><div><h1>*Glass</h1><p>*{A}</p><p>*{B}</p></div><div><a href=/c>Terms</a> <a href=/d>Contact</a></div>",
    "old tables": f"<table><tr><td><a href=/>Home</a></td><td><a href=/a>Crafts</a></td><td><a href=/b>Shop today</a></td></tr></table><table><tr><td>*{A} {B}</td></tr></table><div>Made by hand</div>",
    "a form around all": f"<form id=f><nav><a href=/>Home</a></nav><div id=content><h1>*Glass</h1><p>*{A}</p><p>*{D}</p></div><footer>{B}</footer></form>",
    "header and footer of its own": f"<header><h1>Crafts weekly</h1><p>{D}</p></header><article><header><h1>*Glass</h1></header><p>*{A}</p><p>*{B}</p><footer>By our own reporter, with help from the museum.</footer></article><footer>&copy; 1999</footer>",
    "newsletter box inside": f"<main><h1>*Glass</h1><p>*{A}</p><div class='box newsletter-box'><p>A letter from the valley every Sunday, free of charge, to your own door.</p></div><p>*{C}</p><p>*{D}</p></main>",
    "related posts after": f"<article><h1>*Glass</h1><p>*{A}</p><p>*{B}</p></article><div class=related-posts><h3>More like this</h3><p>{C}</p></div><aside>{D}</aside>",
    "lists and quotations": f"<article><h1>*Glass</h1><p>*{A}</p><ul><li>*Sand</li><li>*Ash</li><li>*Lime</li></ul><blockquote>*{B}</blockquote><p>*The end.</p></article>",
    "a short story among much else": f"<nav><ul><li><a href=/>Home</a></li><li><a href=/a>Crafts of the valley</a></li></ul></nav><article><h1>*Glass</h1><p>*It is gone.</p></article><div class=sidebar><p>{A}</p><p>{B}</p></div><footer><p>{C}</p></footer>",
}


FA = "Every spring the council counts the toads that cross the lane, and every spring someone proposes a tunnel for them."
FB = "Last year four hundred and six were carried over in buckets by children from the school, wearing vests that glowed."
FC = "Drivers are asked to take the upper road after dark, although few of them do, since it adds ten minutes to the way home."

FRESH = {
    "blog": f"<div id=wrap><div id=masthead><h2><a href=/>Lane notes</a></h2></div><div id=nav><a href=/a>About</a><a href=/b>Archive</a></div><div class=entry><h1>*Toads</h1><p>*{FA}</p><p>*{FB}</p><p>*{FC}</p></div><div id=footer>Powered by tea</div></div>",
    "main and aside": f"<header><a href=/>Gazette</a></header><main><article><h1>*Toads</h1><p class=lead>*{FA}</p><figure><figcaption>*A toad in a bucket</figcaption></figure><p>*{FB}</p></article><aside><h2>Popular</h2><p>{FC}</p></aside></main><footer>Imprint</footer>",
    "forum-like replies": f"<article class=thread><h1>*Toads</h1><p>*{FA}</p></article><div class=replies><div class=reply><p>{FB}</p></div><div class=reply><p>{FC}</p></div></div>",
    "promo within": f"<article><h1>*Toads</h1><p>*{FA}</p><div class='inline-promo'><p>Get our calendar of toads for the coming year now.</p></div><p>*{FB}</p></article>",
    "cookie bar": f"<div class='cc-window cookie-bar'><p>We store small files on your machine so that we know you again.</p><button>Fine</button></div><div class=text><h1>*Toads</h1><p>*{FA}</p><p>*{FC}</p></div>",
    "author box": f"<article><h1>*Toads</h1><p>*{FA}</p><p>*{FB}</p><div class='social share-links'><a href=#>Send</a></div></article><section><h3>Read on</h3><article><h4><a href=/1>Frogs of the pond</a></h4><p>They are louder than ever.</p></article><article><h4><a href=/2>Newts</a></h4><p>Nobody counts them yet.</p></article></section>",
    "tags and pager": f"<main><h1>*Toads</h1><p>*{FC}</p><p>*{FA}</p><ul class=tags><li><a href=/t1>toads</a></li><li><a href=/t2>lane</a></li></ul><div class=pagination><a href=/p>Previous</a> <a href=/n>Next</a></div></main>",
    "notice on top": f"<div class='alert alert-warning'><p>This page will move to another address in the coming month.</p></div><main><h1>*Toads</h1><p>*{FA}</p><p>*{FB}</p></main>",
    "plain divs": f"<div><a href=/>Start</a></div><div>*{FA} {FC}</div><div>*{FB}</div><div><a href=/x>Contact</a> <a href=/y>Help</a></div>",
    "skip link and search": f"<a href=#c>Skip to content</a><form role=search><label>Search</label><input></form><article id=c><h1>*Toads</h1><p>*{FA}</p><blockquote>*{FB}</blockquote></article><div class=newsletter-signup><p>Write your address here for a letter each week.</p></div>",
}


def expected(page):
    return [b.text for b in hb.Page(page).blocks if b.text.startswith("*")]


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    assert hb.main_text(PAGES[name]).split("\n") == expected(PAGES[name])


def test_word_and_link_features_decide():
    """Without the blocks' and neighbours' words and link density, answers on these pages are others."""
    tree, changed = hb.trained(), 0
    for page in PAGES.values():
        x = np.array(hb.Page(page).features())
        y = x.copy()
        y[:, :6], y[:, 11] = 0, 0  # linked_run is the link density of neighbours, too
        changed += int((hb.classify(tree, x) != hb.classify(tree, y)).any())
    assert changed >= len(PAGES) / 4


def test_only_the_six_dealt_features_decide_plain_pages():
    tree, changed = hb.trained(), 0
    for name in ("no element and no name", "old tables", "cards below a named wrapper", "one card"):
        x = np.array(hb.Page(PAGES[name]).features())
        y = x.copy()
        y[:, :6] = 0
        changed += int((hb.classify(tree, x) != hb.classify(tree, y)).sum())
    assert changed >= 5


def test_the_article_is_chosen_by_text():
    one = lambda page: [re.sub(r"\W+", " ", " ".join(b.text for b in p.blocks[r.first : r.end]))[:9] for p in [hb.Page(page)] for r in p.article]
    assert one(PAGES["cards below a named wrapper"]) == [] and one(PAGES["comments in article elements"]) == [" Glass Gl"]
    assert one(f"<article><h2>One</h2><p>{A}</p></article><article><h2>Two</h2><p>{B}</p></article><article><h2>Three</h2><p>No.</p></article>") == ["One Glass", "Two The l"]
    assert one("<article></article>") == [] and one("<main><main><main>") == []
    tied = hb.Page(f"<div><article>{A}</article></div><div><article>{A}</article></div>")
    assert [r.first for r in tied.article] == [0]
    assert np.isfinite(tied.features()).all()


def test_pages_that_nothing_was_fitted_to():
    right = [name for name, page in FRESH.items() if hb.main_text(page).split("\n") == expected(page)]
    assert len(right) >= 9
