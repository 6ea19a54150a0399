"""Markup against the standard library's parser, and links of pages case by case."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from reelspan.functions import html
from reelspan.sources import annotations


class Plain(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.silent, self.nodes, self.now, self.tags = "", [], "", []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        self.nodes.append(self.now.strip())
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.silent = tag if tag in ("script", "style") else self.silent
        if tag not in ("script", "style"):
            self.tags.append((tag, False, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.cut()
        self.silent = "" if tag == self.silent else self.silent
        if tag not in ("script", "style"):
            self.tags.append((tag, True, {}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_comment(self, data):
        self.cut()

    handle_decl = handle_pi = handle_comment

    def handle_data(self, data):
        if not self.silent:
            self.now += data


def page(r):
    def attribute():
        name, value = r.choice(["href", "CLASS", "title", "data-x", "disabled"]), r.choice(["a", "b>c", "x y", "", "/w?a=1&amp;b=2", "it's", 'say "x"', "é/ö"])
        if '"' in value:
            return f"{name}='{value}'"
        forms = [f'{name}="{value}"', f'{name} = "{value}"', name]
        if "'" not in value:
            forms.append(f"{name}='{value}'")
        if value and not set(value) & set(" >'\"/"):
            forms.append(f"{name}={value}")
        return r.choice(forms)

    def piece():
        return r.choice(
            [
                lambda: f"<{r.choice(['p', 'DIV', 'a', 'x-y', 'b'])}{''.join(' ' + attribute() for _ in range(r.randrange(4)))}{r.choice(['', ' ', '/', ' /'])}>".replace("=a/>", "=a />").replace("=a/", "=a /"),
                lambda: f"</{r.choice(['p', 'div', 'A'])}{r.choice(['', ' '])}>",
                lambda: r.choice(["<!-- a > b -->", "<!---->", "<!DOCTYPE html>", "<?pi x?>", '<script>if (a<b) "</p>"</script>', "<style a='b'>p>b{}</style>"]),
                lambda: r.choice(["one", " two ", "\n", " a < b ", "&eacute;", "&#233;", "&#x1F600;", "&amp;lt;", "&nbsp;", "é", "x　y", "&hearts;&copy;"]),
            ]
        )()

    return "".join(piece() for _ in range(r.randrange(25)))


def test_text_and_tags_equal_the_standard_parser(spark):
    r = random.Random(4)
    pages = [page(r) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = df.select("i", html.text_of(F.col("t")).alias("text"), html.tags(F.col("t")).alias("tags")).collect()
    for x in got:
        want = Plain(pages[x.i])
        assert x.text == " ".join(n for n in want.nodes if n), pages[x.i]
        assert [(t.name, t.ends, t.attributes) for t in x.tags] == want.tags, pages[x.i]


def test_text(spark):
    cases = {
        "<p>one</p><p>two</p><!-- a > b --><script>var x=1<2;</script>&eacute;&#8212;": "one two é—",
        "&#150;&#x80;&#xD800;&#0;x &unknown; AT&T &amp x": "–€�\0x &unknown AT&T & x",
        "a<!-- c -->b<template>no</template><rt>no</rt>c": "a b c",
        "<![CDATA[raw]]> x": "raw x",
        "&#99999999999999999999999;": "�",
        None: "",
        "": "",
        "<p>" * 3000 + "deep" + " &amp;" * 3000: "deep" + " &" * 3000,
    }
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "i int, t string")
    assert {x.i: x.x for x in df.select("i", html.text_of(F.col("t")).alias("x")).collect()} == dict(enumerate(cases.values()))


LINKS = [
    ("<a href='/wiki/File:A_b.jpg'>", ["File:A b.jpg"]),
    ("<a href=./File:B%2Bc+d.png>", ["File:B+c+d.png"]),
    ('<a class=x HREF = "/wiki/File:100%_pure.jpg">', ["File:100% pure.jpg"]),
    ('<a href="/w/index.php?x=1&amp;title=File:Q_%C3%A9.png&amp;y">', ["File:Q é.png"]),
    ('<a href="/w/index.php?title=Article&amp;f=File:N.png">', []),
    ('<a href="https://h/wiki/Special:FilePath/C_d.svg?width=9">', ["File:C d.svg"]),
    ('<a href="/wiki/File:Song.ogg"><a href="/wiki/File:Film.WEBM"><a href="/wiki/Article"><a name=x>', []),
    ('<img src="//upload.wikimedia.org/w/thumb/1/12/D_e.png/9px-D_e.png">', ["File:D e.png"]),
    ("<img src=https://upload.wikimedia.org/w/1/12/E_f.gif?x=1#y>", ["File:E f.gif"]),
    ('<img src="//upload.wikimedia.org/w/1/12/x.png" data-file-name="Named_o.jpg">', ["File:Named o.jpg"]),
    ('<img src="//upload.wikimedia.org/thumb/1"><img src="//elsewhere/w/1/12/x.png">', []),
    ('<img src="//upload.wikimedia.org/a/Z.png"><a href="./File:Y.png"><a href="/wiki/File:Y.png">', ["File:Y.png", "File:Z.png"]),
    ('<aside><nav><a href="/wiki/File:A.png"></nav></aside><div class="reflist"><a href="/wiki/File:B.png"></div>', ["File:A.png", "File:B.png"]),
    ("<div class='big navbox'><div><a href='/wiki/File:No.png'></div><a href='/wiki/File:No2.png'></div><a href='/wiki/File:Yes.png'>", ["File:Yes.png"]),
    ("<div class=navboxes><a href='/wiki/File:Yes.png'></div>", ["File:Yes.png"]),
    ("<a href='/wiki/File:Out.png'><div class='mw-parser-output'><div></div><a href='/wiki/File:In.png'></div><a href='/wiki/File:After.png'>", ["File:In.png"]),
    ("<!-- <a href='/wiki/File:No.png'> --><script>'<a href=/wiki/File:No.png>'</script>", []),
    ("<img class=noprint src='//upload.wikimedia.org/a/No.png'><span class=noprint /><a class='side-box' href='/wiki/File:No.png'>x</a><a href='/wiki/File:Yes.png'>", ["File:Yes.png"]),
    (None, []),
    ("", []),
]


def test_media_links_case_by_case(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(LINKS)], "page_id long, html string")
    got: dict[int, list[str]] = {}
    for x in annotations.media_links(df).orderBy("page_id", "pos").collect():
        got.setdefault(x.page_id, []).append(x.title)
    assert {k: got.get(k, []) for k in range(len(LINKS))} == {k: want for k, (_, want) in enumerate(LINKS)}
