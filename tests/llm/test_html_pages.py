"""Main text: pages that once lost their article, and pages that once took too long."""

import time

import pytest

from fslink.llm.html_main_text import main_text

SENTENCE = "The river rose, the town slept, and nobody saw the water come, not even the dog."
ARTICLE = "".join(f"<p>{SENTENCE} Part {k}.</p>" for k in range(6))
WANT = "\n\n".join(f"{SENTENCE} Part {k}." for k in range(6))


@pytest.mark.parametrize("lead", ["İ" * 40, "İstanbul " * 30, "ǅ" * 40])
def test_letters_that_grow_in_lower_case(lead):
    assert main_text(f"<article><p>{lead.strip()}</p><SCRIPT>var a = '<p>no</p>';</ScRiPt>{ARTICLE}</article>") == f"{lead.strip()}\n\n{WANT}"


@pytest.mark.parametrize("about", ["layout has-sidebar", "elementor-widget elementor-widget-text-editor", "main-column with-ads", "articleBody promo-free", "page-header-fixed", "no-comments"])
def test_class_words_only_weigh(about):
    page = f'<html><body><div class="nav"><a href=/>Home</a></div><div class="{about}">{ARTICLE}</div><div class="footer">Imprint</div></body></html>'
    assert main_text(page) == WANT


def test_headline_in_an_entry_header_stays():
    page = f'<body><div class="wrap"><div class="entry-header"><h1>Flood</h1></div>{ARTICLE}<div class="entry-footer">Filed under floods</div></div></body>'
    assert main_text(page) == f"Flood\n\n{WANT}"


def test_words_within_attribute_values_do_not_hide():
    assert main_text(f'<article><p title="a hidden gem of the valley">{SENTENCE}</p><p hidden>gone</p><p style="color:red; display: none">gone</p><p aria-hidden=true>gone</p></article>') == SENTENCE


def test_a_short_article_is_not_replaced_by_an_advert():
    page = '<body><nav><a href=/>Home</a></nav><div class="ad">Buy this, now, please, while it is still there, and cheap, and new.</div><article><p>Gone.</p></article></body>'
    assert main_text(page) == "Gone."


@pytest.mark.parametrize(
    "page, want",
    [
        (lambda n: "<div>" * n + ARTICLE + "</span>" * n, WANT),
        (lambda n: "</p>" * n + ARTICLE + "</section>" * n, WANT),
        (lambda n: "<b>" * n + "<p>x</p>" * n, None),
        (lambda n: "<table>" + "<ul>" * n + "<td>a</td>" * n, None),
        (lambda n: '<a "' * n, ""),
    ],
)
def test_time_is_linear(page, want):
    start = time.time()
    got = main_text(page(100_000))
    assert time.time() - start < 30
    assert want is None or got == want
