import pytest
from pyspark.sql import functions as F

from satchel.operators import pages

LONG = "word " * 60
P = lambda n: "<p>" + "x" * n + "</p>"
CASES = [
    ("two articles don't run together", f"<body><article><h1>A</h1><p>{LONG}one</p></article><div>between</div><article><p>{LONG}two</p></article></body>", "A " + LONG.strip() + " one"),
    ("a short article is passed over", f"<body><article>short</article><main><p>{LONG}</p></main></body>", LONG.strip()),
    ("role=main before main", f"<body><div role='main'><p>{LONG}a</p></div><main>{LONG}b</main></body>", LONG.strip() + " a"),
    ("id content", f'<body><div class="x"><p>{LONG}n</p></div><div id="content">{LONG}c</div></body>', LONG.strip() + " c"),
    ("class post-content", f'<body><div class="a post-content b">{LONG}c</div></body>', LONG.strip() + " c"),
    ("the densest container", f"<body><div><p>menu</p><div>{P(150)}{P(150)}</div><section>{P(250)}</section></div></body>", "x" * 150 + "\n" + "x" * 150),
    ("direct children alone", f"<body><div>{P(201)}<ul><li>{P(300)}</li></ul></div><section><div>{P(210)}</div></section></body>", "x" * 210),
    ("the first of equals", f"<body><div>{P(300)}a</div><div>{P(300)}b</div></body>", "x" * 300 + "\na"),
    ("few paragraphs: the body", f"<html><head><title>t</title></head><body><div>{P(100)}</div>rest</body></html>", "x" * 100 + "\n\nrest"),
    ("unclosed and stray tags", f"<body><div></span></section>{P(150)}<p>{'y' * 120}<div>z</div></body>", "x" * 150 + "\n" + "y" * 120 + "z"),
    ("scripts don't count", f"<body><article><script>{LONG}</script>few</article><div>{P(220)}</div></body>", "x" * 220),
    ("no element at all", "plain &amp; simple", "plain & simple"),
]


def test_page_root(spark):
    df = spark.createDataFrame([(n, h) for n, h, _ in CASES] + [("null", None), ("empty", "")], "name string, html string")
    got = {r.name: r.body for r in df.select("name", pages.block_text(F.col("html")).alias("body")).collect()}
    squeeze = lambda t: None if t is None else " ".join(t.split())
    for name, _, want in CASES:
        assert squeeze(got[name]) == squeeze(want), name
    assert got["null"] is None and got["empty"] == ""


@pytest.mark.parametrize("seed", range(3))
def test_page_root_brute_force(spark, seed):
    """Random trees: the densest container found by walking a real tree."""
    import random

    r = random.Random(seed)
    tags = ["div", "section", "ul", "li", "td"]

    def node(depth):
        kids = [("p", r.randrange(20, 160)) if r.random() < 0.5 or not depth else (r.choice(tags), node(depth - 1)) for _ in range(r.randrange(1, 5))]
        return kids

    def html(kids):
        return "".join(f"<p>{'x' * k}</p>" if t == "p" else f"<{t}>{html(k)}</{t}>" for t, k in kids)

    def best(kids, found):
        for t, k in kids:
            if t != "p":
                if t in ("div", "section"):
                    found.append((sum(n for x, n in k if x == "p"), html(k)))
                best(k, found)
        return found

    pages_ = [[("div", node(4))] for _ in range(40)]
    want = {}
    for i, kids in enumerate(pages_):
        found = best(kids, [])
        top = max(n for n, _ in found)
        want[i] = next(h for n, h in found if n == top) if top > 200 else html(kids)
    df = spark.createDataFrame([(i, f"<body>{html(k)}</body>") for i, k in enumerate(pages_)], "i int, html string")
    got = {x.i: x.t for x in df.select("i", F.regexp_replace(pages.page_root(F.col("html")), r"^<(?:div|section|body)>", "").alias("t")).collect()}
    assert got == want
