from textloom.llm import html as X

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a><li><a href="/c">Gamma</a></ul></nav><!-- <p>not this</p> -->
<div id="main"><h1>Head</h1><p>First long paragraph of the article with &amp; sign and plenty of words to count.<p>Second long paragraph of the article, which is not closed either and goes on.</div>
<div class="side"><a href="x">one</a> <a href="y">two</a></div><footer>short</footer></body></html>"""


def brute_counts(names, parents, content, i):
    def below(k):
        return [k] + [y for x in content[k] if not isinstance(x, str) for y in below(x)]

    nodes = below(i)
    chars = sum(len(x) for n in nodes for x in content[n] if isinstance(x, str))
    return chars, len(nodes) - 1


def test_tree():
    names, parents, content = X.parse(PAGE)
    assert names.count("li") == 3 and names.count("p") == 2
    assert all(names[parents[i]] == "ul" for i, n in enumerate(names) if n == "li")
    assert all(names[parents[i]] == "div" for i, n in enumerate(names) if n == "p")
    assert "not this" not in str(content) and "var a" not in str(content)


def test_density_is_the_formula():
    import math

    names, parents, content = X.parse(PAGE)
    body = names.index("body")
    density, sums = X.densities(names, parents, content, body)
    total, _ = brute_counts(names, parents, content, body)
    links = sum(brute_counts(names, parents, content, i)[0] for i, n in enumerate(names) if n == "a")
    for i, name in enumerate(names):
        c, t = brute_counts(names, parents, content, i)
        if not c or name == "a":
            continue
        inside = [k for k, n in enumerate(names) if n == "a" and k != i and up(parents, k, i)]
        lc = sum(brute_counts(names, parents, content, k)[0] for k in inside)
        want = c / (t or 1) * math.log(c / (lc or 1) * (t or 1) / (len(inside) or 1)) / math.log(math.log(c / (c - lc or 1) * lc + links / total * c + math.e))
        assert abs(density[i] - want) < 1e-9 * max(1, abs(want))
    for i in range(len(names)):
        assert abs(sums[i] - sum(density[k] for k in range(len(names)) if parents[k] == i)) < 1e-6


def up(parents, k, i):
    while k >= 0:
        if k == i:
            return True
        k = parents[k]
    return False


def test_main_text():
    text, *_ = X.extract(PAGE)
    assert "First long paragraph" in text and "& sign" in text and "Second long" in text
    assert "Alpha" not in text and "two" not in text


def test_hostile_pages(spark):
    pages = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "no tags at all", "x"), (4, "u", "<p <<< a='>' b=\"", "x"), (5, "u", "<div>" * 3000 + "deep", "x"), (6, "u", PAGE, "x"), (6, "u", PAGE, "x"), (None, "u", "<body></body>", "x"), (7, "u", "<script>never closed", "x"), (8, "u", "<p>" + "long text " * 100_000, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, content string")
    got = X.extract_pages(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert by[1].content is None and by[2].content == "" and by[3].content == "no tags at all" and by[5].content == "deep"
    assert by[7].content == "" and by[None].content == "" and by[8].chars > 900_000
    assert X.extract_pages(df.limit(0)).count() == 0


def brute_choice(page):
    """The subtrees that the definition chooses, node by node."""
    names, parents, content = X.parse(page)
    body = names.index("body") if "body" in names else 0
    density, sums = X.densities(names, parents, content, body)
    inside = lambda i: [k for k in range(len(names)) if up(parents, k, i)]
    best = lambda i: max(inside(i), key=lambda k: (sums[k], -k))
    top = best(body)
    path = [i for i in range(len(names)) if up(parents, top, i) and up(parents, i, body)]
    threshold = min(density[i] for i in path)
    chosen = []

    def walk(i):
        if any(up(parents, i, c) for c in chosen) or density[i] < threshold - 1e-9 or not density[i]:
            return
        b = best(i)
        if b != top and sums[b] < threshold:
            return
        if not any(up(parents, b, c) for c in chosen):
            chosen.append(b)
        for x in content[i]:
            if not isinstance(x, str):
                walk(x)

    walk(body)
    chosen = [c for c in chosen if not any(c != o and up(parents, c, o) for o in chosen)]
    texts = lambda i: [w for x in content[i] for w in (x.split() if isinstance(x, str) else texts(x))]
    return [w for c in sorted(chosen) for w in texts(c)]


def test_the_choice_of_subtrees_is_that_of_brute_force():
    import random

    rng = random.Random(8)

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 3, 12, 40])))
            return f"<a href='x'>{words} </a>" if rng.random() < 0.25 else f"<p>{words} </p>"
        return "<div>" + "".join(node(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    for _ in range(150):
        page = f"<body>{node(4)}{node(3)}</body>"
        assert X.extract(page)[0].split() == brute_choice(page)


def test_ties_go_to_the_first_node():
    part = "<div><p>one two three four five six</p><p>seven eight nine ten eleven</p></div>"
    names, parents, content = X.parse(f"<body>{part}{part}</body>")
    _, sums = X.densities(names, parents, content, names.index("body"))
    first, second = (i for i, n in enumerate(names) if n == "div")
    assert sums[first] == sums[second]
    assert X.extract(f"<body>{part}{part}</body>") == X.extract(f"<body>{part}{part}</body>")
    assert X.extract(f"<body>{part}{part}</body>")[0].split() == brute_choice(f"<body>{part}{part}</body>")
