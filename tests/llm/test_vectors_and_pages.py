"""Embedding links against brute force, and main texts of page shapes."""

import random

import numpy as np
import pytest

from rollcall.llm.embedding_dedup import embedding_duplicates, linked_pairs
from rollcall.llm.extraction import extract_text, main_text

SCHEMA = "vec_id long, embedding array<float>, label int, cid string"


def vectors(seed=0, n=160, dim=16):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dim))
    rows = [(k, (centers[k % 12] + r.normal(size=dim) * r.choice([0.02, 0.08, 0.2])).astype(np.float32).tolist(), int(k % 3), "x") for k in range(n)]
    odd = [(900, None, 1, "x"), (901, [0.0] * dim, 1, "x"), (902, [float("nan")] * dim, 1, "x"), (903, rows[0][1], None, "x"), (None, rows[0][1], 0, "x"), (904, [], 1, "x"), (905, [1.0, None], 1, "x"), (906, rows[0][1], 0, None), (907, [2.0, 0.0], 1, "x"), (908, [1.0, 0.0], 1, "x")]
    return rows + odd


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_and_components(spark, tile):
    rows = vectors()
    good = [(i, np.array(e, float), lab) for i, e, lab, _ in rows if i is not None and lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    parent = {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    n = {i: sum(i in pair for pair in links) for i in parent}
    found = embedding_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(str((i, n[i], root(i), root(i) == i)) for i, *_ in rows) and len(links) > 50
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tiny_and_huge_components(spark):
    rows = [(1, "a", [5e-324, 0.0, 0.0]), (2, "a", [1e-200, 1e-202, 0.0]), (3, "a", [1e300, 1e299, 0.0]), (4, "a", [0.0, 0.0, 3.0]), (5, "a", [0.0, 0.0, 0.0])]
    found = {x.vec_id: (x.n_links, x.component_id) for x in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(2)
    a = r.normal(size=(200, 24))
    b = a + r.normal(size=a.shape) * 0.2
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = set(zip(*map(np.ndarray.tolist, np.nonzero(unit(a) @ unit(b).T >= 0.97)), strict=True))
    i, j, again = linked_pairs(a, b, 0.97)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and again < 400


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


P = ["One sentence, with commas, and words.", "Another paragraph &amp; more.", "Third one."]


@pytest.mark.parametrize(
    "body",
    [
        "<nav><ul><li><a href=/a>A</a></li></ul></nav><div class='ad'>Buy now, please, today.</div><article><h1>T</h1><p>{0}<p><b>{1}<br><p>{2}</p></article><footer>&copy; x</footer>",
        "<header><p>Site, name, here, and, there</p></header><main><div id=content><h1>T</h1><p>{0}</p><p>{1}</p><p>{2}</p></div><aside><p>a, b, c, d</p></aside></main><div class=sidebar><p>x, y</p></div>",
        "<div id='cookie-notice'><p>We use cookies, you know, always.</p></div><div class=post><h2>T</h2><p>{0}</p><form><p>Your mail</p><input></form><p>{1}</p><p>{2}</p></div><div class='comments'><p>First, really, first!</p><article class=comment><p>a, b, c</p></article></div>",
        "<article><h1>T</h1><section><p>{0}</p></section><section><p>{1}</p></section><section><p>{2}</p></section><ul class=related><li><a href=/x>x y z</a></li></ul></article>",
    ],
)
def test_main_text(body):
    expected = "\n".join(["T", P[0], "Another paragraph & more.", P[2]])
    assert main_text(page(body.format(*P))) == expected


def test_odd_pages(spark):
    r = random.Random(1)
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain, text only"), (4, "u", "<p>cut off, here <a hre"), (5, "u", "<b>" * 3000 + "deep, text" + "</b>" * 10), (6, "u", "<p>a  \n b&nbsp;c</p>" * 2), (None, "u", "<div>" * 2000 + "x, y"), (8, "u", "<script>only(1)</script>"), (9, "u", "".join(r.choice("<>/p\"' =") for _ in range(3000)))]
    found = {r.page_id: (r.text, r.n_chars) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == ("", 0) == found[2] == found[8] and found[3] == ("plain, text only", 16) and found[4][0] == "cut off, here" and found[5][0] == "deep, text" and found[6][0] == "a b c\na b c" and found[None][0] == "x, y"
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LONG = "This is a sentence of the article, with a comma, and with some more words so that it is a real paragraph of it."


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("İ" * 200 + "<script>var a = '<p>';</SCRIPT ><article><p>{0}</p><p>{1}</p></article>", [LONG, "Second, short."]),
        ("<div class='content with-sidebar'><article><p>{0}</p><p>{1}</p></article></div><div class=sidebar><p>a, b, c</p></div>", [LONG, "Second, short."]),
        ("<article class='post has-comments'><p>{0}</p><p>{1}</p></article><footer>About, us, and, more</footer><div class=comments-area><p>First, really, and more words!</p></div>", [LONG, "Second, short."]),
        ("<article><p>{0}</p><h2>References</h2><ol><li><a href=/a>A first source</a></li><li><a href=/b>A second source</a></li></ol></article>", [LONG, "References", "A first source", "A second source"]),
        ("<article><p>{0}</p><section class='related-work'><h2>Related work</h2><p>{1}</p></section></article>", [LONG, "Related work", "Second, short."]),
        ("<form id=aspnet><div class=main-menu><a href=/a>A</a> <a href=/b>B</a></div><div id=text><p>{0}</p><p>{1}</p></div></form>", [LONG, "Second, short."]),
        ("<div id=text><section><p>{0}</p><p>{0}</p></section><section><p>{1}</p></section><table><tr><td>cell</td></tr></table><ul><li>item</li></ul></div><ul><li><a href=/>Home</a></li><li><a href=/x>Other</a></li></ul>", [LONG, LONG, "Second, short.", "cell", "item"]),
        ("<div class=cookie-notice><p>We use cookies, as you know, and more.</p></div><div class='post'><p>{0}</p><div class='share-links'><a href=/x>Tweet</a></div><p>{1}</p></div>", [LONG, "Second, short."]),
    ],
)
def test_containers_by_score(body, expected):
    found = main_text(page(body.format(LONG, "Second, short.")))
    assert found.removeprefix("İ" * 200 + "\n").split("\n") == expected


POST = ["Short post."]
TALK = ["I think, and I say it, that this is wrong, all of it, from the first word on.", "No, it is right, as anyone can see, who reads it twice.", "You, again, of all people, with the same old thing, and the same words.", "Well, well, well, said the fourth, and went on, and on, and on."]
TALKED = "".join(f"<p>{t}</p>" for t in TALK)


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<h1>T</h1><p>Short post.</p><div class='comments'>" + TALKED + "</div>", ["T", *POST]),
        ("<h1>T</h1><p>Short post.</p><section id=user-comments-section-v3>" + "".join(f"<article class='c'><p>{t}</p></article>" for t in TALK) + "</section>", ["T", *POST]),
        ("<div class='cookie-consent-v2'><p>We use cookies, as you know.</p></div><div class=post><p>{0}</p></div>", [LONG]),
        ("<div class='l-sidebar'><p>About us, and you, and more.</p></div><div><p>{0}</p><p>{1}</p></div>", [LONG, "Second, short."]),
        ("<article><p>{0}</p><div class='js-ad-slot-x'>Buy it, now, and here.</div><ins class='adsbygoogle'>Or there, tomorrow.</ins><p>{1}</p></article>", [LONG, "Second, short."]),
        ("<article><header><h1>TITLE</h1><p>by someone, on a day</p></header><p>{0}</p></article>", ["TITLE", LONG]),
        ("<header><h1>Site</h1></header><article><p>{0}</p></article>", [LONG]),
        ("<div class='widget'><p>{0}</p><p>{0}</p><p>{1}</p></div><footer>c</footer>", [LONG, LONG, "Second, short."]),  # nothing else is on the page
        ("<div class='comments'><p>{0}</p></div>", [LONG]),
        ("<main class='no-sidebar'><div class='sidebar-layout-grid'><p>{0}</p><p>{1}</p></div></main>", [LONG, "Second, short."]),
    ],
)
def test_names_only_discount(body, expected):
    assert main_text(page(body.format(LONG, "Second, short."))).split("\n") == expected


def test_pages_of_known_parts():
    """Random pages put together from an article and other parts, under class names put together by chance: the text is the article's blocks."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    say = lambda n: " ".join(word() + r.choice(["", "", "", ","]) for _ in range(n)) + "."
    around = lambda core: "-".join(x for x in (r.choice(["", "l", "js", "site", "page", "main"]), core, r.choice(["", "v2", "box", "wrapper", "section", "3"])) if x)
    for _ in range(300):
        blocks = [say(r.randrange(8, 60)) for _ in range(r.randrange(2, 7))]
        title = say(4)
        tag, name = r.choice([("article", ""), ("div", "post"), ("div", "entry-content"), ("section", "story has-sidebar"), ("main", "")])
        head = r.choice([f"<h1>{title}</h1>", f"<header><h1>{title}</h1><span>{say(3)}</span></header>"]) if tag in ("article", "main") else f"<h1>{title}</h1>"
        inside = [f"<p>{b}</p>" for b in blocks]
        for _ in range(r.randrange(3)):
            inside.insert(r.randrange(len(inside) + 1), r.choice([f"<div class='{around('ad')}'>{say(5)}</div>", f"<aside><p>{say(20)}</p></aside>", f"<script>{say(9)}</script>", f"<form><p>{say(4)}</p><input></form>"]))
        core = f"<{tag} class='{name}'>{head}{''.join(inside)}</{tag}>"
        before = [f"<nav><ul>{''.join(f'<li><a href=/>{word()}</a></li>' for _ in range(5))}</ul></nav>", f"<div class='{around('cookie-notice')}'><p>{say(12)}</p></div>", f"<header><p>{say(9)}</p></header>"]
        after = [f"<div class='{around('sidebar')}'><p>{say(25)}</p></div>", f"<div id='{around('comments')}'>{''.join(f'<div><p>{say(30)}</p></div>' for _ in range(r.randrange(1, 9)))}</div>", f"<footer>{say(6)}</footer>", f"<div class='{around('newsletter')}'>{say(7)}</div>"]
        body = "".join(r.sample(before, r.randrange(4)) + [core] + r.sample(after, r.randrange(5)))
        assert main_text(page(body)).split("\n") == [title, *blocks], body
