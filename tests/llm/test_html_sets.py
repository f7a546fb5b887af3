"""Generated sites whose article text is known: recall and precision of the text, comments, small hosts."""

import random

import pytest

from quillon.llm import html_extract

PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}


def sentence(rnd, n=14):
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("count", [1, 2, 6])
@pytest.mark.parametrize("holder", ['div id="comments"', 'div class="comments"', 'section class="comment-list"', 'ol class="commentlist"', 'div id="disqus_thread"', 'div class="user-comments"'])
def test_comments_are_never_the_article(spark, count, holder):
    rnd = random.Random(count)
    pages, expected = [], {}
    for i in range(count):
        story, talk = sentence(rnd, 30), "".join(f"<div class='comment'><p>{sentence(rnd, 30)}</p></div>" for _ in range(6))
        pages.append((f"https://h.example/{i}", f"<html><body><div id=content><p>{story}</p></div><{holder}>{talk}</{holder.split()[0]}></body></html>"))
        expected[i] = story
    assert texts(spark, pages) == expected


def test_how_comments_are_set_says_nothing(spark):
    rnd = random.Random(1)
    stories = [sentence(rnd, 60) for _ in range(4)]
    pages = [(f"https://h.example/{i}", f"<html><body class='single comments-open'><div class='post comments-closed'><p>{s}</p></div></body></html>") for i, s in enumerate(stories)]
    assert texts(spark, pages) == dict(enumerate(stories))


@pytest.mark.parametrize("count", [2, 3, 4, 6])
def test_small_hosts_lose_what_all_pages_show(spark, count):
    rnd = random.Random(count)
    stories = [[sentence(rnd, 40) for _ in range(3)] for _ in range(count)]
    shell = "<html><body><div class='top'>The Daily Example</div><div class='text'>{}</div><div class='end'>All rights with the Daily Example</div></body></html>"
    pages = [(f"https://h.example/{i}", shell.format("".join(f"<p>{p}</p>" for p in s))) for i, s in enumerate(stories)]
    assert texts(spark, pages) == {i: "\n".join(s) for i, s in enumerate(stories)}


def test_recall_and_precision_on_generated_sites(spark):
    rnd = random.Random(7)
    pages, expected = [], {}
    for host in range(25):
        body, talk, menu, side = rnd.choice(["entry", "story", "text"]), rnd.choice(["comments", "comment-list", "replies"]), rnd.choice(["nav", "menu", "navbar"]), rnd.choice(["sidebar", "widget", "related"])
        marked, name = rnd.random() < 0.4, sentence(rnd, 3)
        links = "".join(f"<li><a href='/{i}'>{sentence(rnd, 2)}</a></li>" for i in range(8))
        for _ in range(rnd.choice([1, 2, 3, 5, 9])):
            blocks = [sentence(rnd, rnd.randint(5, 60)) for _ in range(rnd.randint(1, 6))]
            inner = "".join(f"<p>{b}</p>" for b in blocks)
            article = f"<article>{inner}</article>" if marked else f"<div class='{body}'>{inner}</div>"
            comments = "".join(f"<div class='comment'>{sentence(rnd, rnd.randint(3, 60))}</div>" for _ in range(rnd.randint(0, 8)))
            expected[len(pages)] = blocks
            pages.append((f"https://h{host}.example/{len(pages)}", f"<html><body><header>{name}</header><ul class='{menu}'>{links}</ul>{article}<div class='{side}'>{sentence(rnd, 9)}</div><div class='{talk}'>{comments}</div><footer>{name} 2024</footer></body></html>"))
    got = texts(spark, pages)
    found = {i: t.split("\n") if t else [] for i, t in got.items()}
    right = sum(len(set(found[i]) & set(b)) for i, b in expected.items())
    assert right >= 0.99 * sum(map(len, expected.values())) and right >= 0.99 * sum(map(len, found.values()))
