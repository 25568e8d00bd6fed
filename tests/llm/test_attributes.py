import pytest

from vendorlens.llm import mainhtml


@pytest.mark.parametrize("attribute", ['data-title="The hidden cost of rent"', "aria-label='Hidden figures'", '''onclick="x='hidden'"''',
                                       'data-style="overflow: hidden"', 'title = "a hidden thing"', 'data-x="style=display:none"', "title=hidden"])
def test_hidden_inside_a_value_hides_nothing(attribute):
    (element, _, text, *_), = mainhtml.blocks(f"<article {attribute} class=story><p>Words of it.</p></article>")
    assert text == "Words of it." and not element.hidden and "name:story" in element.features


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN", 'hidden=""', "aria-hidden=true", "style='display: none'", 'title="x" hidden'])
def test_the_attribute_itself_hides(attribute):
    (element, *_), = mainhtml.blocks(f"<div {attribute}>x</div>")
    assert element.hidden


def test_all_names_of_a_long_class_list_count():
    names = " ".join(f"mt-{'abcdefghijklmnopqrstuvwxyz'[i % 26]}x-{'abcdefgh'[i % 8]}y" for i in range(40))
    (element, *_), = mainhtml.blocks(f'<div class="{names} newsletter">x</div>')
    assert "name:newsletter" in element.features
