"""No text of an article is lost to elements that are closed in another way, or not at all."""

import pytest

from vendorlens.llm import mainhtml

TEXT = "The quick article text goes on here, with several words and commas, until it ends."
PARAGRAPHS = [f"<p>{TEXT} {i}.</p>" for i in range(3)]
WHOLE = "\n".join(f"{TEXT} {i}." for i in range(3))


@pytest.mark.parametrize("between", [
    '<svg width="1"/>', "<svg/>", "<math/>", "<button>Share", "<select><option>One", "<audio src=x>", "<video src=x>No video", "<canvas>", "<template>",
    "<div><button>Share</div>", "<button type=button>Share<button>More</button>", "<svg><path d='M0'/><title>Icon</title></svg>", "<svg><use/><text>Chart</text></svg>",
    "<noscript>Turn it on</noscript>", "<button><div>Share</div><p>this</p></button>", "<audio controls/>"])
def test_what_stands_between_paragraphs_hides_itself_only(between):
    page = f"<article>{PARAGRAPHS[0]}{between}{PARAGRAPHS[1]}{between}{PARAGRAPHS[2]}</article>"
    assert mainhtml.trained().extract(page) == WHOLE


def test_text_inside_a_paragraph():
    def text(inner):
        return mainhtml.trained().extract(f"<article>{PARAGRAPHS[0]}<p>{inner}</p>{PARAGRAPHS[1]}</article>").split("\n")[1]

    long = "and some more words, so that it is a sentence of the article."
    assert text(f"Let <math><mi>x</mi></math> be it, {long}") == f"Let x be it, {long}"
    assert text(f"See <object data=a>the picture</object>, {long}") == f"See the picture, {long}"
    assert text(f"Press <button>OK</button> now, {long}") == f"Press now, {long}"
    assert text(f"An icon <svg><text>i</text></svg>here, {long}") == f"An icon here, {long}"
    assert text(f"As <math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math> says, {long}") == f"As y says, {long}"


def test_containers_are_told_apart_whatever_stands_before():
    """Two separate containers are two after few siblings and after very many different ones."""
    for n in (3, 300):
        siblings = "".join(f"<i class=c{k}>y</i>" for k in range(n))
        found = mainhtml.blocks(f"<body>{siblings}<div class=x><p>one</p><p>two</p></div><div class=x><p>three</p></div></body>")
        assert mainhtml._joined(found)[-2:] == [1, 0], n


def test_links_are_found_through_any_depth():
    (_, _, text, linked, _), = mainhtml.blocks("<p><a href=x><b><i><u><em><strong>all of it</strong></em></u></i></b></a></p>")
    assert (text, linked) == ("all of it", 1.0)
