"""Extraction: fitted costs, what the edges change, parts with doubtful names, and the time of bad markup."""

import random
import time

import numpy as np
import pytest

from riskscan.llm import html_extraction as H

LONG = "A sentence of the article that goes on for quite some time and says what there is to say."


def made_page(r, marked=True):
    """A page and the blocks of its article; unmarked pages tell by nothing but their texts."""
    tag = lambda name, text: f"<{name}>{text}</{name}>" if marked else f"<div>{text}</div>"
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(r.randint(3, 7)))
    body = [f"{LONG} {i}." if r.random() < 0.75 else f"Short {i}" for i in range(r.randint(5, 12))]
    body[0] = body[-1] = LONG
    article = "".join(f"<p>{x}</p>" if x.startswith(LONG) else f"<div>{x}</div>" for x in body)
    page = f"<body>{tag('nav', f'<ul>{links}</ul>')}{tag('article', article)}{tag('footer', '<p><a href=/t>Terms of use</a></p>')}</body>"
    return page, body


def test_edges_help_where_places_say_nothing():
    r = random.Random(4)
    weights = H.fit(np.array([row for _ in range(80) for row in H._placed(made_page(r)[0])]))
    changed = right = alone = total = 0
    for _ in range(60):
        page, body = made_page(r, marked=False)
        found = H.blocks(page)
        content = H.labels(found, weights)
        truth = [b.text in body for b in found]
        changed += sum((b.odds > 0) != c for b, c in zip(found, content, strict=True))
        right += sum(c == t for c, t in zip(content, truth, strict=True))
        alone += sum((b.odds > 0) == t for b, t in zip(found, truth, strict=True))
        total += len(found)
    assert changed > 0 and right >= alone and right / total > 0.95


def test_fit_separates_and_falls_back():
    r = random.Random(5)
    rows = np.array([row for _ in range(50) for row in H._placed(made_page(r)[0])])
    weights = H.fit(rows)
    assert weights != H.WEIGHTS and ((rows[:, :-1] @ np.array(weights) > 0) == (rows[:, -1] == 1)).mean() > 0.8
    assert H.fit(np.zeros((0, 8))) == H.WEIGHTS and H.fit(rows[rows[:, -1] == 1]) == H.WEIGHTS


def test_fitted_on_tables(spark):
    r = random.Random(6)
    rows = [(i, "u", made_page(r)[0]) for i in range(40)] + [(None, None, None), (41, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = H.fitted(df)
    assert weights == H.fitted(df.repartition(7)) == H.fitted(df.unionByName(df)) != H.WEIGHTS
    assert H.fitted(df.limit(0)) == H.WEIGHTS
    assert H.extracted(df, weights=weights).filter("n_relabelled >= 0").count() == 42


@pytest.mark.parametrize("name", sorted(H.DOUBTFUL))
def test_doubtful_names_inside_the_article(name):
    page = f'<main><h1>Title</h1><p>{LONG}</p><div class="{name}-work"><p>{LONG} Again.</p></div></main>'
    assert H.main_text(page)[0] == f"Title\n\n{LONG}\n\n{LONG} Again."
    links = f'<main><h1>Title</h1><p>{LONG}</p><div class="{name}"><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div></main>'
    assert H.main_text(links)[0] == f"Title\n\n{LONG}"
    assert H.main_text(f'<body><div class="{name}"><p>Posts.</p></div><article><p>{LONG}</p></article></body>')[0] == LONG


def test_one_short_sentence():
    assert H.main_text("<body><p>One short sentence.</p></body>")[0] == "One short sentence."


@pytest.mark.parametrize(
    "html",
    ["<a " * 500_000, "<a '\"" * 250_000 + ">", "<div>" * 50_000 + "x</p>" * 100_000, "<li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<p title=\"" * 150_000, "<td><div>" * 50_000],
    ids=["open tags", "quotes", "stray ends", "items", "open quotes", "cells"],
)
def test_bad_markup_takes_linear_time(html):
    begun = time.process_time()
    H.main_text(html)
    assert time.process_time() - begun < 15


def test_quotes_that_never_close_lose_no_text():
    assert "Seen." in H.main_text(f'<article><p title="x>Seen.</p><p>{LONG}</p></article>')[0]
