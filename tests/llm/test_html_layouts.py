"""Whole articles on made hosts of many layouts, and on the given pages with the names of their elements taken away."""

import random
import re

import pytest

from skein.llm import html

SF = "/root/testdata/sf0.01"
SHELL = "<html><head><title>t</title></head><body><nav><a>home</a></nav><div class=qx><p>Site slogan of words</p></div>{}<div class=qz><p>Imprint and more</p></div></body></html>"


def words(rng, n):
    return " ".join(rng.choice("ab cde fgh ijkl mno pq rstu vw".split()) + str(rng.randrange(10**6)) for _ in range(n))


def lead_and_story(rng, closing):
    a, b, c = words(rng, 6), words(rng, 20), words(rng, 70)
    return f"<main><div class=lead><p>{a}</p></div><div class=story><p>{b}</p><p>{c}</p></div></main>", [a, b, c]


def sections(rng, closing):
    parts = [[words(rng, 5), words(rng, rng.choice((8, 60)))] for _ in range(rng.randint(1, 3))]
    return "<article>" + "".join(f"<section><h2>{h}</h2><p>{p}</p></section>" for h, p in parts) + "</article>", [x for p in parts for x in p]


def closed(rng, closing):
    a, b = words(rng, 4), words(rng, 40)
    return f"<div class=box><h1>{a}</h1><p>{b}</p><p>{closing}</p></div>", [a, b, closing]


def closed_article(rng, closing):
    a, b = words(rng, 4), words(rng, 40)
    return f"<article><h1>{a}</h1><div class=tx><p>{b}</p></div><div class=sig><p>{closing}</p></div></article>", [a, b, closing]


def headed(rng, closing):
    a, b = words(rng, 4), words(rng, 40)
    return f"<main><h1>{a}</h1><article><p>{b}</article></main>", [a, b]


def inside_others(rng, closing):
    a, b = words(rng, 4), words(rng, 40)
    return f"<main><div class=tease><p>{words(rng, 5)}</p></div><article><h1>{a}</h1><p>{b}</article></main>", [a, b]


def unclosed(rng, closing):
    a, b, c = words(rng, 4), words(rng, 30), words(rng, 30)
    return f"<div class=box><div class=in><h1>{a}</h1><p>{b}</div><div class=in2><p>{c}", [a, b, c]


@pytest.mark.parametrize("pages", [3, 9, 10, 14])
def test_the_whole_article_on_every_page(spark, pages):
    rng, rows, want = random.Random(pages), [], {}
    for h, layout in enumerate([lead_and_story, sections, closed, closed_article, headed, inside_others]):
        for k in range(pages):
            body, blocks = layout(rng, "Written by our own desk")
            rows.append((100 * h + k, f"https://h{h}.example/{k}", SHELL.format(body)))
            want[100 * h + k] = "\n".join(blocks)
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_unclosed_containers(spark):
    rng = random.Random(3)
    made = [unclosed(rng, "") for _ in range(12)]
    rows = [(k, f"https://u.example/{k}", f"<html><body><div class=qx><p>Site slogan</p></div>{body}") for k, (body, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join(blocks) for k, (_, blocks) in enumerate(made)}


def test_copies_of_one_article_with_another_date(spark):
    rows = [(k, f"https://c.example/{k}", SHELL.format(f"<div class=when><p>Date {k}</p></div><div class=box><h1>Head</h1><p>{'same words ' * 60}</p></div>")) for k in range(5)]
    got = {r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"Head\n" + ("same words " * 60).strip()}


def test_given_pages_without_names_need_the_template(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()

    def bare(page):
        page = re.sub(r"<(/?)(article|nav|footer|header|aside)\b[^>]*>", r"<\1div>", page or "")
        return re.sub(r"<div class=\"[^\"]*\">", "<div>", page)

    host = lambda u: re.sub(html.HOST, r"\1|", u or "").split("|")[0]
    of = {}
    for r in given:
        of.setdefault(host(r["url"]), set()).add(r["html"])
    rows = [(r["page_id"], r["url"], bare(r["html"])) for r in given if len(of[host(r["url"])]) >= 3]
    want = {r["page_id"]: html.extract(r["html"], "") for r in given}
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = {i: html.extract(page, "") for i, _, page in rows}
    kept = sum(got[i] == want[i] for i in got)
    assert len(got) > 20 and kept >= 0.9 * len(got)
    assert sum(alone[i] == want[i] for i in got) < 0.1 * len(got)
