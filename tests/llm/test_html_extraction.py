import random
import time

from loomgraph.llm.html_extraction import extract, extract_pages

LONG = "This is the sentence of the article that was written for all of the readers and it is long enough to be decided on its own."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div><!-- x -->
<article><header><h1>Title &amp; more</h1></header><p><b>First{chr(10)}  line<br>two.<p>{LONG}</p><p>Of.</p><div class="ad">{LONG}</div>
<ul><li>One</li><li>Two</li></ul><form><input><label>Name</label></form><section id="comments"><p>{LONG}</p></section></article>
<aside>{LONG}</aside><footer>&copy; 2020 {LONG}</footer>"""


def test_article_without_what_is_around():
    assert extract(PAGE).split("\n") == ["Title & more", "First line two.", LONG, "Of.", "One", "Two"]


def test_page_without_an_article():
    page = f'<body><div><a href="/">Home</a> <a href="/b">Blog</a></div><div><h1>A title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div><a href="/x">More</a></div></body>'
    assert extract(page).split("\n") == ["A title", LONG, "Short one.", LONG]


def test_names_in_values_drop_nothing():
    page = f"""<body><article class="post has-sidebar"><header class="entry-header"><h1>Title</h1></header><h2 id="social-structure">Structure</h2><h2 id="search">Search</h2>
<div class="content with-sidebar overflow-hidden"><p>{LONG} <a href="/hidden-valley" title="not hidden" data-id="ad">valley</a> {LONG}</p></div>
<p hidden>{LONG}</p><p style="color:red; display: none">{LONG}</p><p aria-hidden="true">{LONG}</p><p hidden="until-found">Found.</p><div class="x cookie-notice">{LONG}</div><div class="share_buttons">{LONG}</div></article>"""
    assert extract(page).split("\n") == ["Title", "Structure", "Search", f"{LONG} valley {LONG}", "Found."]


def test_what_readers_write_and_adverts_go():
    for element in (
        'div class="comment-body"', 'section id="respond"', 'section class="user-comments"', 'section class="discussion"', 'div class="ad-slot"', 'div class="reader-comments__thread"', 'ol class="commentlist"', 'div id="ad_unit"',
        'div class="post-comment"', 'p class="sponsored-content"', 'div class="comment-text"',
    ):
        tag = element.split()[0]
        inner = f"<li>{LONG}</li>" if tag == "ol" else LONG
        page = f"<body><article><h1>Title</h1><p>{LONG}</p><{element}>{inner}</{tag}></article></body>"
        assert extract(page).split("\n") == ["Title", LONG], element
        assert extract(f"<body><div><p>{LONG}</p><p>{LONG}</p></div><{element}>{inner}</{tag}></body>").split("\n") == [LONG, LONG], element


def test_names_of_an_articles_own_parts_stay():
    for element in ('section id="discussion"', 'div class="article-header"', 'div class="header-content"', 'div class="no-comments"', 'div class="commented-text"', 'section class="discussion-of-results"', 'div class="related-work"'):
        tag = element.split()[0]
        page = f"<body><article><h1>Title</h1><p>{LONG}</p><{element}><p>{LONG}</p></{tag}></article></body>"
        assert extract(page).split("\n") == ["Title", LONG, LONG], element


def test_linked_sentences_and_code_are_text():
    link = '<a href="/r">The first report of the council on the state of the river</a>'
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><p>{link}</p><p>{LONG}</p><ul><li><a href='/x'>Other news of this day and of the next day here</a></li></ul></article></body>"
    assert extract(page).split("\n") == ["Title", LONG, "The first report of the council on the state of the river", LONG]
    code = "int main(int argc, char **argv) { return printf(\"%d\", argc); } // gcc -O2 -Wall -Wextra main.cpp --output=main.bin"
    page = f"<body><div><h1>Title</h1><p>{LONG}</p><pre>{code}</pre><p>{LONG}</p></div><pre>{code}</pre></body>"
    assert extract(page).split("\n") == ["Title", LONG, code, LONG]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain &lt;text&#33;"), (None, "u", "<p>un<b>closed"), (5, "u", "<script>x"), (6, "u", "<p>" + "word " * 20_000 + "</p>"), (6, "u", "<<>> <p <p>a</p>"), (7, "u", "<" * 500)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = extract_pages(pages).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    by_id = {r["page_id"]: r["text"] for r in out}
    assert by_id[1] == by_id[2] == by_id[5] == "" and by_id[3] == "plain <text!" and by_id[None] == "unclosed"
    assert extract_pages(pages.limit(0)).count() == 0


#: Sentences of languages with and without a list of stop words.
SENTENCES = {
    "en": "The river was high in the spring and all of the people who live by it had to go to the hills for a time",
    "de": "Der Fluss war im Frühling hoch und die Leute mussten für eine Zeit in die Berge gehen weil es nicht anders ging",
    "fr": "La rivière était haute au printemps et les gens qui vivent sur la rive sont partis dans les collines pour un temps",
    "es": "El río estaba alto en la primavera y la gente que vive en la orilla se fue a las colinas por un tiempo",
    "it": "Il fiume era alto in primavera e tutti gli abitanti delle rive dovettero salire sulle colline per qualche settimana",
    "pl": "Rzeka była wysoka wiosną i wszyscy mieszkańcy brzegów musieli przenieść się na wzgórza przez kilka długich tygodni",
    "fi": "Joki oli korkealla keväällä ja kaikki rannan asukkaat joutuivat muuttamaan kukkuloille muutamaksi pitkäksi viikoksi",
    "el": "Το ποτάμι ήταν ψηλά την άνοιξη και όλοι οι κάτοικοι της όχθης έπρεπε να ανέβουν στους λόφους για μερικές εβδομάδες",
    "ja": "春になると川の水位が高くなり、岸辺に住む人々はみな数週間のあいだ丘の上に移らなければならなかった。" * 3,
}


def made_page(rnd, sentence):
    """A page without an article, and the main text that it was made of."""
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{rnd.choice(["Home", "News", "Über uns", "次へ"])} {k}</a></li>' for k in range(n)) + "</ul>"
    main, html = [], []
    for k in range(rnd.randint(1, 3)):
        title = f"{k} {sentence[:20].strip()}"
        main.append(title)
        html.append(f"<h2>{title}</h2>")
        for _ in range(rnd.randint(1, 4)):
            p = " ".join([sentence + "."] * rnd.randint(1, 3))
            main.append(p)
            html.append(rnd.choice([f"<p>{p}</p>", f"<p>{p}", f"<div><span>{p}</span></div>", f"<blockquote><p>{p}</p></blockquote>", f'<p class="lead form overflow-hidden">{p}</p>']))
            if rnd.random() < 0.4:
                main.append("Short.")
                html.append("<p>Short.</p>")
    wrapper = rnd.choice(["<div>", '<div class="content with-sidebar">', '<div id="widget">', "<section>", "<table><tr><td>"])
    close = {"<d": "</div>", "<s": "</section>", "<t": "</td></tr></table>"}[wrapper[:2]]
    around = [
        f"<nav>{links(4)}</nav>", f"<div>{links(5)}</div>", f"<header><p>{sentence}.</p></header>", f'<p class="advert">{sentence}.</p>' if wrapper != '<div id="widget">' else "",
        "<form><label>Name</label><input></form>", f'<div style="display:none">{sentence}.</div>',
    ]
    return "<body>" + "".join(rnd.sample(around, 4)) + wrapper + "".join(html) + close + f"<footer>© {sentence}.</footer></body>", "\n".join(main)


def test_pages_without_an_article_in_several_languages():
    rnd = random.Random(4)
    for sentence in SENTENCES.values():
        for _ in range(12):
            page, main = made_page(rnd, sentence)
            assert extract(page) == main, page


def test_the_first_pass_decides_in_an_article_too():
    crowd = "".join(f'<a href="/t{k}">some other story of the day</a> ' for k in range(4))
    page = f"<article><h1>Title</h1><p>{LONG}</p><p>{crowd}</p><p>x1 y2 z3</p><pre>{'a1 = b2; ' * 20}</pre><p>{LONG}</p></article><div><p>{LONG}</p></div>"
    assert extract(page).split("\n") == ["Title", LONG, "x1 y2 z3", ("a1 = b2; " * 20).strip(), LONG]
    assert extract("<article><p>One.</p><p>Two.</p></article>") == "One.\nTwo."
    assert extract(f'<article><p>One.</p></article><div class="comments"><p>{LONG}</p></div>') == "One."
    assert extract(f"<p>{LONG} <math><mi>x</mi></math></p>") == f"{LONG} x"


def test_work_grows_with_the_page():
    def seconds(page):
        began = time.process_time()
        extract(page)
        return time.process_time() - began

    for make in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<a<" * n + '"', lambda n: "<p><b>x" * n, lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<p>&amp;</q>" * n):
        seconds(make(1000))
        assert seconds(make(40_000)) < 40 * max(seconds(make(4_000)), 0.02)


def plain_classify(blocks):
    """The second pass as its rules are stated, each block by a walk over all others."""
    from loomgraph.llm import html_extraction as H

    labels = H.first_pass(blocks)
    shown = [k for k, b in enumerate(blocks) if not b.boiler]
    article = any(b.inside and not b.hint and x is not False for b, x in zip(blocks, labels, strict=True))
    good = [k for k, x in enumerate(labels) if x]
    if article or any(not blocks[k].hint for k in good) or not good:
        shown = [k for k in shown if not blocks[k].hint]
    if any(blocks[k].inside and labels[k] is not False for k in shown):
        shown = [k for k in shown if blocks[k].inside]
    kept = []
    for j, k in enumerate(shown):
        before, after = [i for i in range(j) if labels[shown[i]] is not None], [i for i in range(j + 1, len(shown)) if labels[shown[i]] is not None]
        some_good = any(labels[shown[i]] for i in before + after + [j])
        if labels[k]:
            kept.append(k)
        elif labels[k] is False:
            if blocks[k].tag in H.CODE and blocks[k].links <= H.MAX_LINKS and 0 < j < len(shown) - 1 and shown[j - 1] in kept and labels[shown[j + 1]]:
                kept.append(k)
        elif not before and not after or not some_good and blocks[shown[0]].inside:
            kept.append(k)
        elif blocks[k].heading and after:
            if labels[shown[after[0]]]:
                kept.append(k)
        else:
            near = before[-1:] + after[:1]
            least = min(abs(i - j) for i in near)
            if any(labels[shown[i]] for i in near if blocks[k].inside or abs(i - j) == least):
                kept.append(k)
    return [k in kept for k in range(len(blocks))]


def test_second_pass_equals_its_plain_form():
    from loomgraph.llm import html_extraction as H

    rnd = random.Random(8)
    texts = [LONG, "Short.", "x1 y2 z3 " * 12, "Of the day and of the night and the sea, seen by Anna Bellini Carlo Donati Elena Ferri Gino"]
    for _ in range(400):
        blocks = []
        for _ in range(rnd.randint(0, 9)):
            b = H.Block(rnd.random() < 0.1, rnd.random() < 0.4, rnd.random() < 0.15, rnd.choice(["p", "pre", "h2", "li", "td", "div"]))
            b.text, b.links, b.anchors = rnd.choice(texts), rnd.choice([0.0, 0.0, 0.0, 0.9]), rnd.randint(0, 2)
            blocks.append(b)
        assert H.classify(blocks) == plain_classify(blocks), [(b.text[:9], b.tag, b.inside, b.hint, b.links) for b in blocks]
