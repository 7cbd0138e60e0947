from quillspark.llm import boiler


def page(i, name="Acme", url=True, extra=""):
    title = f"Notes on things {'abcdefghij'[i]}"
    lines = [
        "Menu", "Skip to content", "* [Guides](https://www.acme.test/guides)", f"We use cookies to improve {name.lower()}. By continuing you accept our cookie policy.", f"Guides > {title}", title, "",
        f"The body of page number {i} says something long about topic {chr(97 + i)} in a sentence.", "## A heading of its own",
        "- An item that ends like a sentence does.", "Aaa | Bbb", f"{i} | {i + 1}", f"Try {name} free for {i + 3} days. No card needed.", f"Privacy on page {i} means that tokens are rebuilt {chr(97 + i)} gradually.",
        "More pages", "- Notes on things z", f"© 2025 {name}. All rights reserved.",
    ]
    return (f"p{i}", f"https://www.acme.test/{i}" if url else None, title, "\n".join(lines) + extra)


BOILER = {1, 2, 3, 4, 5, 13, 15, 16, 17}


def test_consensus(spark):
    pages = [page(i) for i in range(5)]
    other = [(f"q{k}{i}", f"http://{n}.example/{i}", f"Title {n} {i}", f"Title {n} {i}\nA sentence on {"xyz"[k]} and {"uv"[i]} that nobody else has.\n© 2025 {n.title()}. All rights reserved.\nWe use cookies to improve {n}. By continuing you accept our cookie policy.") for k, n in enumerate(("bolt", "cord", "dune")) for i in range(2)]
    lost = [page(7, url=False)]
    df = spark.createDataFrame(pages + other + lost + [("n", None, None, None), ("e", None, "t", "")], "id string, url string, title string, content string").selectExpr("*", "'x' as host", "1 as path")
    got = {}
    for r in boiler.boilerplate_lines(df).collect():
        got.setdefault(r.source_id, set()).add(r.line_no)
    for i in range(5):
        assert got[f"p{i}"] == BOILER, (i, got[f"p{i}"])
    assert got["q00"] == {3, 4}
    assert BOILER - {13} <= got["p7"] and 8 not in got["p7"]
    body = {r.source_id: r.content for r in boiler.main_text(df).collect()}
    assert body["p1"].startswith("Notes on things b\n\nThe body") and "cookies" not in body["p1"] and body["n"] is None and body["e"] == ""
    assert boiler.boilerplate_lines(df.where("false")).count() == 0


def test_forms():
    assert boiler.host_of("HTTPS://Www.Acme.test:80/x?y") == "acme.test" and boiler.host_of("acme.test/x") == "acme.test" and boiler.host_of("http://[bad") == ""
    assert boiler.strip_tags('<li><a href="/x">Docs &amp; more</a></li>') == ("Docs & more", "li", True)
    assert boiler.strip_tags('<div class="c-5f0b">x</div>')[1] == "div.c-*"
    rows = boiler.score("A page\r\n```\ncode\n```\n> said so\n[10:20] Ann: hello", "A page", None)
    assert [r[1] for r in rows] == [boiler.TITLE, boiler.CODE, boiler.CODE, boiler.CODE, boiler.QUOTE, boiler.SAID]
    lines = boiler.score('<nav class="top-3">\n<ul>\n<li><a href="/a">Docs</a></li><li>\nMore\n</li>\n</ul>\n</nav>\n<p>Some text, and <b>bold</b>\nnext line\n<p>another', "t", None)
    assert [(r[0], r[2]) for r in lines] == [(1, "nav.top-*"), (2, "nav.top-*>ul"), (3, "nav.top-*>ul>li"), (4, "nav.top-*>ul>li"), (5, "nav.top-*>ul>li"), (6, "nav.top-*>ul"), (7, "nav.top-*"), (8, "p"), (9, "p"), (10, "p")]


def test_word_keys():
    words = "a b c a".split()
    key, parts = boiler.word_keys(words)
    for i in range(4):
        other = [*words[:i], "x", *words[i + 1 :]]
        assert boiler.word_keys(other)[0] == (key + (boiler._hash("x") - boiler._hash(words[i])) * parts[i]) % (1 << 64)
    assert boiler.word_keys("c b a a".split())[0] != key


def test_hosts_with_few_pages_follow_the_others(spark):
    """A label in a paragraph is boilerplate on most hosts; a host with one page follows them, one with many pages decides for itself."""
    def pages(host, n, inside):
        for i in range(n):
            title = f"On {host} and {i}"
            word = "".join("abcdefghij"[int(c)] for c in f"{i:03d}") + "xyz"[len(host) % 3] + "".join("klmnopqrst"[int(c)] for c in host if c.isdigit())
            body = f"Sentence {word} says something that no other page {word} says, and it goes on until it is more than long enough to be sure of it, as here."
            lines = [title, body, "Label here", body + " Again."] if inside else ["Label here", title, body, body + " Again."]
            yield (f"{host}{i}", f"https://{host}.test/{i}", title, "\n".join(lines))
    rows = [r for k in range(30) for r in pages(f"h{k}", 3, False)] + list(pages("own", 120, True)) + list(pages("few", 1, True))
    df = spark.createDataFrame(rows, "id string, url string, title string, content string")
    got = {}
    for r in boiler.boilerplate_lines(df).collect():
        got.setdefault(r.source_id, set()).add(r.line_no)
    assert got["h00"] == {1} and "own5" not in got


def test_containers_are_voted_on(spark):
    """Teasers in a container of their own, with another text on each page, once within the body."""
    pages = []
    for i in range(6):
        title = f"Notes on things {'abcdef'[i]}"
        body = [f'<p class="text">Paragraph {w} of page {"uvwxyz"[i]} is a sentence about something {w}{"klmnop"[i]} that nobody else has, and it goes on until it is long enough to be sure of it.</p>' for w in ("one", "two")]
        tease = f'<div class="teaser-{i}">Readers of {"uvwxyz"[i]} also enjoy the {"klmnop"[i]} story.</div>'
        pages.append((f"p{i}", f"https://acme.test/{i}", title, "\n".join([title, *(body if i else [body[0], tease, body[1]]), *([tease] if i else [])])))
    df = spark.createDataFrame(pages, "id string, url string, title string, content string")
    got = {(r.source_id, r.line_no) for r in boiler.boilerplate_lines(df).collect()}
    assert got == {("p0", 3)} | {(f"p{i}", 4) for i in range(1, 6)}
