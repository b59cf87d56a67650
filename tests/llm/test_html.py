"""Pages whose frame is named like clutter, and clutter inside paragraphs."""

import pytest

from quire.llm.html_extract import main_text

PARAGRAPHS = [
    "The first paragraph of the piece, which is long enough, has commas, and says what it is about.",
    "A second one follows it, with more to read, more commas, and no link at all in its sentences.",
    "The third closes the piece, again at some length, so that nobody takes it for a caption, or a note.",
]
BODY = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(["Title", *PARAGRAPHS])
COMMENTS = "<div class='comments'>" + "<div class=comment><p>I read this, and I liked it, a lot, but not all of it, to be fair.</p></div>" * 2 + "</div>"
MENU = "<nav><a href=/>Home</a> <a href=/b>Books</a></nav><ul class=menu><li><a href=/c>Contact</a></li></ul>"


@pytest.mark.parametrize("frame", ["<form id=aspnetForm action=/>", "<div class='sidebar-right'>", "<div class='sidebar-right-layout'>", "<section id='related'>", "<form><div class=widget><div class='sidebar'>"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div class=body>{}</div>"])
def test_a_frame_round_the_page_is_opened(frame, inner):
    page = f"<html><body>{frame}{MENU}{inner.format(BODY)}<div class='sidebar'><p>Also read, today, this, that and others, all of them good.</p></div><footer>Contact us</footer></body></html>"
    assert main_text(page) == TEXT


def test_clutter_beside_an_article_stays_cut():
    page = f"<body>{MENU}<article>{BODY}</article><form><p>Sign up, now, for more, of the same, every week, at no cost.</p><input></form>{COMMENTS}</body>"
    assert main_text(page) == TEXT
    many = page.replace(COMMENTS, COMMENTS * 3)
    assert main_text(many) == TEXT  # more comments than article


def test_hidden_frames_and_small_forms_stay_cut():
    assert main_text(f"<body><div hidden>{BODY}</div></body>") == "" and main_text(f"<body><div role=dialog>{BODY}</div></body>") == ""
    assert main_text("<body><form><label>Name</label><input></form></body>") == ""


@pytest.mark.parametrize("clutter", ["<span class=advertisement>Buy now</span>", "<span hidden>secret</span>", "<b style='display: none'>gone</b>", "<i aria-hidden=true>icon</i>", "<span class='ad'>Buy <span>now</span> <b>here</b></span>", "<a class=sponsored href=/x>Buy</a>", "<em id='promo'>one <em>two</em> three</em>"])
def test_inline_clutter_goes(clutter):
    page = f"<body><article>{BODY.replace('second one', f'second {clutter}one')}</article></body>"
    assert main_text(page) == TEXT


def test_inline_elements_that_only_look_like_it_stay():
    for tag in ("<span class=comment>", "<span class='read-ad-free'>", "<span class=shared>", "<a class=related href=/>", "<span data-hidden=no>", "<b style='display:inline'>"):
        name = tag[1:].split()[0].rstrip(">")
        page = f"<body><article>{BODY.replace('second one', f'second {tag}one</{name}>')}</article></body>"
        assert main_text(page) == TEXT, tag


def test_unclosed_inline_clutter_ends_with_its_block():
    page = f"<body><article>{BODY.replace('in its sentences.</p>', 'in its sentences.<span class=ad>Buy now</p>')}</article></body>"
    assert main_text(page) == TEXT
    assert main_text("<body><p>Some words, quite a few of them, to read here. <span hidden>never closed") == "Some words, quite a few of them, to read here."
