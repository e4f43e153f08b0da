"""Main text extraction against a tree that knows what is main text."""

import html
import random
import time

import pytest

from piiguard.llm import html_extract as H

LINE = "The cat and the dog of the house are in the garden with a friend of ours."


class Tree:
    """Builds a random page and, from the same tree, the text that is to be found in it."""

    def __init__(self, seed):
        self.rng, self.want = random.Random(seed), []

    def words(self, n):
        return " ".join(self.rng.choice("the of and to a river stone é 世 <b &amp; 5 > x".split()) for _ in range(n))

    def inline(self, main):
        """A run of inline markup; its text is one block."""
        parts, text = [], []
        for _ in range(self.rng.randint(1, 4)):
            piece = self.words(self.rng.randint(1, 9))
            tag = self.rng.choice(["", "b", "em", "a", "span", "code", "math"])
            body = html.escape(piece)
            parts.append(f"<{tag} href=x>{body}</{tag}>" if tag else body)
            text.append(piece)
        if main:
            self.want.append(" ".join(" ".join(text).split()))
        return self.rng.choice([" ", "\n  ", " <br> ", " <!-- note <p> --> "]).join(parts)

    def furniture(self):
        shell = self.rng.choice([
            "<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", "<form>{}</form>", "<div class='cookie-notice'>{}</div>", "<div class=comments>{}</div>",
            "<section id='reader-comments'>{}</section>", "<div class='ad-slot'>{}</div>", "<div hidden>{}</div>", "<div style='display:none'>{}</div>", "<div role=navigation>{}</div>",
            "<script>{}</script>", "<style>{}</style>", "<ul class='related-posts'>{}</ul>", "<div class='share-buttons'>{}</div>", "<div class=newsletter>{}</div>",
        ])
        return shell.format("".join(f"<p>{self.inline(False)}</p>" for _ in range(self.rng.randint(1, 3))))

    def block(self, depth=0):
        kind = self.rng.choice(["p", "p", "p", "h2", "li", "td", "blockquote", "pre", "div", "section", "furniture", "related"])
        if kind == "furniture":
            return self.furniture()
        if kind == "li":
            return "<ul>" + "".join(f"<li>{self.inline(True)}" for _ in range(self.rng.randint(1, 3))) + "</ul>"
        if kind == "td":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.inline(True)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        if kind in ("div", "section", "related") and depth < 4:
            name = self.rng.choice(["", " class='related-work'", " class=post-header", " id='category-social'", " class='no-comments'", " class=entry-content"])
            return f"<div{name}>" + "".join(self.block(depth + 1) for _ in range(self.rng.randint(1, 3))) + "</div>"
        tag = kind if kind in ("p", "h2", "blockquote", "pre") else "p"
        return f"<{tag}>{self.inline(True)}" + ("" if tag == "p" and self.rng.random() < 0.3 else f"</{tag}>")

    def page(self):
        tag = self.rng.choice(["article", "main"])
        head = "<html><head><title>no</title></head><body class='has-sidebar'><header>Site</header>" + self.furniture()
        body = f"<div class='content-sidebar-wrap'><{tag} class='comments-open'><header><h1>{self.inline(True)}</h1></header>" + "".join(self.block() for _ in range(6)) + f"</{tag}></div>"
        return head + body + self.furniture() + "<footer>end</footer></body></html>"


@pytest.mark.parametrize("seed", range(150))
def test_generated_pages(seed):
    tree = Tree(seed)
    page = tree.page()
    assert H.main_text(page) == " ".join(t for t in tree.want if t), page


def test_an_article_keeps_all_its_blocks():
    inner = "<div class='post-header'><h1>Title</h1></div><p><a href=x>only a link</a></p><section class='related-work'><p>Related work of others.</p></section><table><tr><td>cell</td></tr></table><p>x <math><mi>y</mi></math></p>"
    assert H.main_text(f"<body><article>{inner}<p>{LINE}</p></article></body>") == f"Title only a link Related work of others. cell x y {LINE}"


def test_neighbours_label_short_blocks_outside_articles():
    page = f"<body><div><p>{LINE}</p><p>Short.</p></div><div><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul><p>tail</p></div></body>"
    assert H.main_text(page) == f"{LINE} Short."


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "</span>" * 20_000 + LINE, "<b>" * 20_000 + "<p>x" * 20_000, "<aside>" + "<article>" * 20_000 + "x", "<p>" * 100_000, "<a title=\"x" * 20_000, "<" * 200_000, "&" * 200_000,
    "<!--" * 50_000, "<div><p>" * 30_000 + "</p></div>" * 30_000,
])
def test_odd_pages_take_little_time(page):
    start = time.time()
    H.main_text(page)
    assert time.time() - start < 10


def test_table_edge_cases(spark):
    long = "<article>" + f"<p>{LINE}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 5), (1, "u", None, 5), (2, None, "", 5), (None, "v", "<article>a&nbsp; b</article>", 5), (3, "w", long, 5), (3, "w", long, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in H.extract(pages).collect())
    whole = " ".join([LINE] * 20_000)
    assert got == sorted([("1", "u", "", 0)] * 2 + [("2", None, "", 0), ("None", "v", "a b", 3)] + [("3", "w", whole, len(whole))] * 2)
    assert H.extract(pages.where("page_id = 9")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Before.</p><script src='a.js'/>var a=1;</script><p>After.</p></article>", "Before. After."),
        ("<article><p>Before.</p><script src=/js/>var a=1;</script><p>After.</p></article>", "Before. After."),
        ("<article><p>Before.</p><style media=all/>p {}</style><p>After.</p></article>", "Before. After."),
        ("<article><p>Before <svg/>and <svg a=b /><math><mi/>x</math> after.</p><svg a=b/>no</svg></article>", "Before and x after."),
        ("<article><p>One <span/>two</span> three</p><video src=x/><p>Four</p></article>", "One two three Four"),
    ],
)
def test_only_void_and_foreign_elements_close_themselves(page, want):
    assert " ".join(H.main_text(page).split()) == want


def test_unquoted_links_count_as_links():
    links = "".join(f"<p><a href=/topic/{i}/>The page of the river and of the house in the garden {i}</a></p>" for i in range(4))
    assert H.main_text(f"<body><div>{links}</div><p>{LINE}</p></body>") == LINE


@pytest.mark.parametrize(
    "line",
    ["今天早上我们在河边散步，看到了很多美丽的花朵和小鸟。后来下雨了，我们就回家吃饭，并且谈到了明天的计划以及下个月的旅行，大家都非常高兴。",
     "Сегодня утром мы гуляли у реки и видели много красивых цветов. Потом пошёл дождь, и мы вернулись домой.",
     "Tänään kävelimme joen rannalla ja näimme paljon kauniita kukkia. Sitten alkoi sataa, joten menimme kotiin syömään."],
)
def test_languages_without_stop_words(line):
    assert len(line) >= H.LONG_CHARS
    assert H.main_text(f"<body><nav><a href=x>home</a></nav><p>{line}</p><footer>{line}</footer></body>") == line
    assert H.main_text(f"<body><div><a href=x>{line}</a></div></body>") == ""
    assert H.main_text(f"<body><p>{LINE}</p><p>{'keyword casino bonus ' * 5}</p></body>") == LINE


class Bare(Tree):
    """Pages without article or main: paragraphs of stop words are main text, link lists and furniture are not."""

    def page(self):
        parts = []
        for _ in range(self.rng.randint(1, 6)):
            kind = self.rng.randint(0, 2)
            if kind == 0:
                parts.append(self.furniture())
            elif kind == 1:
                parts.append("<ul>" + "".join(f"<li><a href={self.rng.choice(['x', '/x/', chr(39) + 'x' + chr(39)])}>{html.escape(LINE)}</a>" for _ in range(3)) + "</ul>")
            else:
                text = " ".join([LINE, self.words(3), LINE])
                self.want.append(text)
                parts.append(f"<p>{html.escape(text)}</p>")
        return "<html><head><title>no</title></head><body>" + "\n".join(parts) + "</body></html>"


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages_without_article(seed):
    tree = Bare(seed)
    page = tree.page()
    assert H.main_text(page) == " ".join(tree.want)
