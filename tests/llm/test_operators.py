"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from walkrank.llm import bpe, decontaminate, html_text, neardup, substrings, token_files, topk, toxicity, urls, warc
from walkrank.llm.queries import URL_RULES, tokenizer_path
from walkrank.llm.scratch import Scratch
from walkrank.llm.words import hashes, split

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


BASE, PASSAGE = prose(1, 120), prose(2, 60)
TEXTS = [
    None, "", " \t\n", "one", "One two", "one two three four", "one two three four five", "ONE two three four five",
    BASE, BASE, BASE.replace("w", "W"), BASE + " extra", "new " + BASE, " ".join(BASE.split()[:100]), BASE.replace(" ", "\n\n", 20),
    prose(3, 50) + " " + PASSAGE + " " + prose(4, 70), PASSAGE + " " + prose(5, 40), prose(6, 30) + " " + PASSAGE, PASSAGE + " " + PASSAGE,
    prose(7, 35), prose(7, 34), "É" + prose(8, 10) + " ünï\u00a0x <|endoftext|> \u2028 end", "a" * 5000, prose(9, 4000, 50), "x\ud7ff\U0001f600 \x1c\x0b y  z ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, i, "x", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, d int, x int, spans string, n_words int").repartition(3)


def empty(frame):
    return frame.where("false")


def test_urls(spark):
    cases = [(1, "http://A.example.COM/en/7x?q"), (2, "https://example.com/en/8"), (3, "http://notexample.com/en/7"), (4, "http://xcom/en/"), (5, "ftp://net/de/1#f"), (6, "https://a.b.example.net/de/80"), (7, None), (8, ""), (9, "no scheme"), (10, "http://org"), (11, "http://org.com/es/?x"), (12, "http://x.org/en/../es/"), (13, "http://foo.de/x.com/en/"), (14, "a://b://c.com/en/"), (15, "http://com/en/" + "z" * 20000), (15, "http://com/en/" + "z" * 20000), (16, "http://ü.org/es/ü"), (17, "HTTP://WWW.Example.org/es/#")]
    frame = spark.createDataFrame(cases, "page_id int, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    got = sorted(urls.url_filter(frame, [urls.UrlRule(*r) for r in URL_RULES]).select("page_id", "host", "path", "rule", "verdict").collect(), key=lambda r: r.page_id)
    for (i, url), row in zip(cases, got, strict=True):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert tuple(row) == (i, host, path, best[1], best[2])
    assert urls.url_filter(empty(frame), []).count() == 0


def test_rules_are_those_of_the_contract(spark):
    assert sorted(URL_RULES) == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.net", "/de/8", "block"), ("net", "/de/", "allow"), ("org", "/es/", "block")]
    frame = spark.createDataFrame([(1, "http://a.example.net/de/7"), (2, "http://a.example.net/de/8"), (3, "http://net/de/")], "page_id int, url string")
    got = urls.url_filter(frame, [urls.UrlRule(*r) for r in URL_RULES], default="block").orderBy("page_id").select("rule", "verdict").collect()
    assert [tuple(r) for r in got] == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab.*?", max_size=5), st.text("/ab*?é", max_size=6)), min_size=1, max_size=30), st.lists(st.tuples(st.text("ab.", max_size=6), st.text("/abé", max_size=8)), min_size=1, max_size=8))
def test_shift_and_is_glob(rules, sites):
    def pattern(glob, any_):
        return "".join({"*": f"{any_}*", "?": any_}.get(c, re.escape(c)) for c in glob)

    automaton = urls.ShiftAnd([urls.UrlRule(h, p, "v") for h, p in rules])
    rows = [b"." + h.encode() + b"\xff" + p.encode() for h, p in sites]
    got = automaton.run(np.cumsum([0, *map(len, rows)]), np.frombuffer(b"".join(rows), np.uint8))
    for (h, p), best in zip(sites, got.tolist(), strict=True):
        fits = [i for i in automaton.order if re.fullmatch((".*\\." + pattern(rules[i][0], ".") if rules[i][0] else ".*"), "." + h, re.S) and re.match(pattern(rules[i][1], "."), p, re.S)]
        assert best == (fits[0] if fits else -1)


def test_topk(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(90)]
    odd = [(200, None), (201, [1.0, None, 2.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (None, [1.0] * 5), (204, [1.0, 2.0]), (205, []), (3, vectors[3][1]), (220, [1e7] * 5)]
    frame = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<double>").withColumn("value", F.lit(1)).withColumn("score", F.lit(1))
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, candidate_block=16, query_block=2).collect()
    known = {i: [int(np.floor(64 * x)) for x in v] for i, v in [*vectors, (204, [1.0, 2.0]), (205, []), (220, [1e7] * 5)]}
    want = []
    for q in (i for i in known if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(known[q], v, strict=False)), i) for i, v in known.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:7])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(empty(frame), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(frame.where("vec_id < 2"), F.col("vec_id") % 20 == 0, k=20).count() == 1


@pytest.mark.parametrize("most, kind", [(7, np.int16), (90, np.int16), (3000, np.int32), (2**20, np.int64)])
def test_topk_accumulates_in_the_shortest_integers(most, kind):
    rng = np.random.default_rng(most)
    candidates = rng.integers(-most, most + 1, (500, 4)) * (rng.random((500, 4)) < [1.0, 0.9, 0.2, 0.05])
    queries = np.vstack([rng.integers(-most, most + 1, (20, 4)), candidates[:1]])
    assert topk._kind(queries, candidates) is kind
    postings = topk._postings(candidates, kind)
    assert [isinstance(rows, slice) for rows, _ in postings] == [True, True, True, False]
    ids = np.arange(500) + 100
    for i, got in enumerate(topk._accumulate(queries, candidates, 9, np.arange(21), ids)):
        scores = candidates @ queries[i]
        best = np.lexsort((ids, -scores))[:9]
        assert got.vec_id.tolist() == ids[best].tolist() and got.score.tolist() == scores[best].tolist()



PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><a href=a>Home</a></nav>
<div class="sidebar"><p>Side words, and more of them, for the score, that is long.</p></div><div id="main"><article><h1>Head &amp; line</h1><p>First <b>paragraph</b>, with&nbsp;text<br>and
more, so that it counts.<p>Second one, &#x41;&lt;b&gt;, goes on, and on.<script>var p="<p>no</p>";</script><div class="ad">Buy</div><form><p>Your name, please, here, in this form</p></form>
<ul><li>item one, long enough to count</li><li>two</li></ul></article></div><div id="comments"><p>I think, dear all, that this is a comment, really.</p></div><footer>&copy; all</footer></body></html>"""


def test_html(spark):
    cases = [(1, PAGE), (2, None), (3, ""), (4, "plain"), (5, "<div>a<div>b"), (6, "<p>" + "word, " * 30000), (7, "<div>" * 3000 + "deep"), (8, "<p x='"), (1, PAGE)]
    frame = spark.createDataFrame(cases, "page_id int, html string").withColumn("text", F.lit("old")).withColumn("url", F.lit("u"))
    got = html_text.extract_text(frame).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "Head & line\n\nFirst paragraph, with text and more, so that it counts.\n\nSecond one, A<b>, goes on, and on.\n\nitem one, long enough to count\n\ntwo"
    assert (by[2].text, by[3].text, by[4].text, by[5].text, by[7].text, by[8].text) == ("", "", "plain", "a\n\nb", "deep", "")
    assert by[6].n_chars == len(by[6].text) == 6 * 30000 - 1
    assert len(got) == 9 and html_text.extract_text(empty(frame)).count() == 0


def test_html_with_drawings_and_formulas():
    def text(inner):
        return html_text.main_text(f"<html><body><article><p>First part, before it.</p>{inner}<p>Last part, after it.</p></article></body></html>").split("\n\n")

    ends = ["First part, before it.", "Last part, after it."]
    for inner in ("<svg/>", '<svg viewBox="0 0 1 1"/>', "<math />", "<svg><svg><text>in</text></svg><text>tail</text></svg>", "<svg><g><text>no end</text>", "<svg><title/><style/><path d='m'/></svg>", "<template><div>a<template><p>b</template>tail</template>", "<svg><foreignObject><div><p>in</div></foreignObject><text>tail</text></svg>"):
        assert text(inner) == ends, inner
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>") == [ends[0], "Let x=1 be.", ends[1]]
    assert text("<p>An <svg/>icon <svg><title>t</title></svg>here.</p>") == [ends[0], "An icon here.", ends[1]]


def test_html_without_article_element():
    def text(inner):
        return html_text.main_text(f"<html><body>{inner}</body></html>").split("\n\n")

    long, more = "A paragraph, with commas, and words enough to count as text of an article.", "Another one, as long, and with some more words in it, to be on the safe side."
    entry = f"<div class=entry><p>{long}</p><p>{more}</p></div>"
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul>"
    sources = "<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul>"
    assert text(f"<div><h1>Title</h1>{entry}</div>") == ["Title", long, more]
    assert text(f"<h1>Title</h1><div id=page><div>{entry}</div></div>") == ["Title", long, more]
    assert text(f"{menu}<div><h1>Title</h1>{entry}<h2>Next</h2><p>Short.</p><ul><li>one</li></ul><div><p>Also short.</p></div></div>{menu}") == ["Title", long, more, "Next", "Short.", "one", "Also short."]
    assert text(f"<div>{entry}<h2>Sources</h2>{sources}</div>") == [long, more, "Sources", "Source one", "Source two"]
    assert text(f"<article><p>{long}</p>{sources}<p>{more}</p>{sources}</article>{menu}") == [long, "Source one", "Source two", more, "Source one", "Source two"]
    assert text(f"<div><h1>Title</h1><article><p>{long}</p></article><article><p>Two.</p></article></div>") == ["Title", long, "Two."]
    assert text(f"<div class=sidebar><p>{more}</p></div>{entry}<div class=comments><p>{long}</p></div>") == [long, more]


LONG, MORE = "A first paragraph, with commas, and words enough to count as text of an article.", "Another one, as long, and with some more words in it, to be on the safe side."
ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>{MORE}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<form id=aspnetForm>{ARTICLE}<input name=q><button>Send</button><select><option>one</select></form>",
        f"<form id=aspnetForm><div class=sidebar><p>Beside, and long enough to count.</p></div><div class=content>{ARTICLE}</div></form>",
        f"<article class='post comments-open'>{ARTICLE}</article>",
        f"<div class='post has-comments'>{ARTICLE}</div>",
        f"<div class='no-sidebar'>{ARTICLE}</div>",
        f"<div class=noSidebar>{ARTICLE}</div>",
        f"<div class='layout sidebar-right'>{ARTICLE}<div class=sidebar><p>Beside, and long.</p></div></div>",
        f"<div class='page hidden-sidebar'>{ARTICLE}</div>",
        f"<div class='elementor-widget'>{ARTICLE}</div>",
        f"<div class=widget-area><div class=modal>{ARTICLE}<div class=cookie>Cookies?</div></div></div><footer>All rights</footer>",
        f"<article>{ARTICLE}<div class=related-posts><ul><li><a href=a>One of these</a><li><a href=b>And another</a></ul></div><div class=social><a href=c>Share</a></div></article>",
        f"<article>{ARTICLE}<form><p>Your name, please, and your address, too.</p><input></form></article>",
    ],
)
def test_names_drop_no_whole_article(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n\n") == ["Title", LONG, MORE]


def test_names_of_parts_of_an_article():
    for part in ("<p class='modal-verbs'>{}</p>", "<figure class=banner><figcaption>{}</figcaption></figure>", "<ul><li class='tags-of'>{}</li></ul>", "<div class=related><p>{}</p></div>"):
        told = "Such verbs, as may and can, are shown here."
        assert html_text.main_text(f"<article>{ARTICLE}{part.format(told)}</article>").split("\n\n") == ["Title", LONG, MORE, told], part
    for part in ("<p class=ad>{}</p>", "<figure class=advert>{}</figure>", "<div class=modal>{}</div>", "<div class='comment-list'>{}</div>", "<section class=comments><p>{}</p></section>"):
        assert html_text.main_text(f"<article>{ARTICLE}{part.format(LONG)}</article>").split("\n\n") == ["Title", LONG, MORE], part
    assert html_text.main_text(f"<article><p>{LONG}</p></article><div class=comments>{f'<p>{MORE}</p>' * 20}</div>") == LONG


SURROUNDS = st.sampled_from(["<div class=sidebar><p>{}</p></div>", "<div id=comments><p>{}</p></div>", "<nav><a href=x>{}</a></nav>", "<div class='share bar'>{}</div>", "<aside>{}</aside>", "<div class=newsletter><form>{}<input></form></div>", "<div class=popup-box><p>{}</p></div>"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([LONG, MORE, "Short one.", "It ends, as it has begun, with a sentence of some length."]), min_size=2, max_size=6), st.lists(SURROUNDS, max_size=4), st.sampled_from(["<div class=entry>{}</div>", "<form>{}</form>", "<div class='has-sidebar'>{}</div>", "<div class='widget-wrap'><div>{}</div></div>", "<section>{}</section>"]), st.booleans())
def test_html_is_what_was_put_in(paragraphs, around, wrapper, before):
    """Made-up pages without an article element: the paragraphs of the wrapper, and nothing around it."""
    side = "".join(a.format("Beside.") for a in around)
    body = wrapper.format("".join(f"<p>{p}</p>" for p in [LONG, *paragraphs]))
    assert html_text.main_text(f"<html><body>{side if before else ''}{body}{'' if before else side}</body></html>").split("\n\n") == [LONG, *paragraphs]


class Articles(HTMLParser):
    """Brute force for pages that have an article element: its blocks, without what the contract drops."""

    BLOCKS = {"p", "h1", "h2", "h3", "ul", "ol", "li", "div", "section", "blockquote", "table", "tr", "td", "article", "figure", "figcaption", "pre", "hr"}
    GONE = {"nav", "header", "footer", "aside", "form", "script", "style"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside, self.gone = [], "", 0, []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if words := self.text.split():
            self.blocks.append(" ".join(words))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if self.gone:
            self.gone += [tag] if tag == self.gone[0] else []
        elif tag in self.GONE or dict(attrs).get("class") in ("ad", "comments", "share", "newsletter"):
            self.flush()
            self.gone = [tag]
        else:
            self.inside += tag == "article"
            if tag in self.BLOCKS:
                self.flush()
            self.text += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if self.gone:
            self.gone = self.gone[1:] if tag == self.gone[0] else self.gone
            return
        if tag in self.BLOCKS:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.text += data


def test_html_is_brute_force_on_whole_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = html_text.extract_text(rows.select("page_id", "html")).collect()
    pages = {r.page_id: r.html for r in rows.collect()}
    assert len(got) == len(pages)
    for r in got:
        assert r.text == "\n\n".join(Articles(pages[r.page_id] or "").blocks) and r.n_chars == len(r.text)


WORDS = st.lists(st.sampled_from(["word", "long,", "text", "&amp;", "&#233;t&eacute;", "a<br>b", "<b>bold</b>", "<a href=x>link</a>", "it's", "1&lt;2"]), min_size=1, max_size=30).map(" ".join)
PARTS = st.one_of(
    WORDS.map(lambda t: f"<p>{t}</p>"),
    WORDS.map(lambda t: f"<p class='tags-intro'>{t}</p>"),
    WORDS.map(lambda t: f"<p class=search-results>{t}"),
    WORDS.map(lambda t: f"<h2>{t}</h2>"),
    st.lists(WORDS, min_size=1, max_size=3).map(lambda x: "<ul>" + "".join(f"<li>{t}</li>" for t in x) + "</ul>"),
    WORDS.map(lambda t: f"<blockquote><p>{t}</p></blockquote>"),
    WORDS.map(lambda t: f"<title-card>{t}</title-card>"),
    st.sampled_from(["<div class=ad>Buy now, buy</div>", "<script>var a='<p>no</p>';</script>", "<form><p>Your name, please</p></form>", "<aside><p>By the way, this is beside, and long enough to count.</p></aside>", "<div class=share>Share</div>", "<style>p{}</style>", "<!-- <p>no</p> -->"]),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=8), st.booleans(), st.booleans())
def test_html_is_brute_force_on_made_up_pages(parts, beside, before):
    menu = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul></nav>"
    side = "<aside><p>Other news, that are long enough to be taken for text, of this article.</p></aside>" if beside else ""
    page = f"<html><head><title>T</title></head><body>{menu}{side if before else ''}<article><h1>The title, of it</h1>{''.join(parts)}</article>{'' if before else side}<div class=comments><p>I think, dear all, that this is a comment, really.</p></div><footer>&copy; all</footer></body></html>"
    assert html_text.main_text(page) == "\n\n".join(Articles(page).blocks)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, docs, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (4, TEXTS[5])]
    extra = docs.select("doc_id", "text", "spans").unionByName(spark.createDataFrame([(4, TEXTS[4], ""), (4, TEXTS[5], "")], "doc_id bigint, text string, spans string"))
    got = sorted(token_files.token_file_digests(extra, tokenizer_path(name)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert token_files.token_file_digests(empty(docs), tokenizer_path(name)).count() == 0


def test_token_files_are_read_selectively(spark, docs):
    scratch = Scratch(spark, "test")
    token_files.write_tokens(docs, f"{scratch.path}/t", tokenizer_path("word_bpe_49k.json"), partitions=2)
    some = token_files.read_tokens(spark, f"{scratch.path}/t", where=F.col("doc_id") == 8, ids=False)
    assert [r.doc_id for r in some.collect()] == [8] and some.columns == ["doc_id", "start", "n_tokens"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,8)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_decontamination(spark, docs, monkeypatch):
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[10:30]).upper()), (3, None), (4, ""), (5, "One  two"), (None, BASE), (7, "absent words here"), (2, "one"), (11, prose(9, 40, 50)), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    for size, vocabulary, sent in ((1 << 20, 1, 1), (200, 1 << 20, 1 << 20), (200, 20, 0)):  # one block of items, and several, whose words and hits are few or many
        monkeypatch.setattr(decontaminate, "VOCABULARY", vocabulary)
        monkeypatch.setattr(decontaminate, "SENT_BYTES", sent)
        got = decontaminate.digests(decontaminate.find_contamination(docs, bench, keep=["doc_id"], index_bytes=size)).collect()
        assert len(got) == len(TEXTS)
        for row in got:
            words = re.findall(ALNUM, lower(TEXTS[row.doc_id]))
            hit, found = set(), set()
            for item, text in items:
                w = re.findall(ALNUM, lower(text))
                n = min(13, len(w))
                for s in range(len(w) - n + 1) if n and item is not None else ():
                    for i in range(len(words) - n + 1):
                        if words[i : i + n] == w[s : s + n]:
                            hit |= set(range(i, i + n))
                            found.add(item)
            names = ",".join(sorted(map(str, found)))
            assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == (len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest())
            assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
    twice = decontaminate.digests(decontaminate.find_contamination(docs.where("doc_id = 15").unionByName(docs.where("doc_id = 15")), bench, keep=["doc_id"])).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_hit > 0
    whole = decontaminate.find_contamination(docs, bench)
    assert {"d", "x", "text"} <= set(whole.columns) and whole.count() == len(TEXTS)
    # spans are one whole, however many blocks items come in; no text moves for them
    one, many = ({(r.text, r.n_words, str(r.spans), str(r.items)) for r in decontaminate.find_contamination(docs.withColumn("text_key", F.lit(1)), bench, index_bytes=size).collect()} for size in (1 << 20, 200))
    assert one == many and len(one) == len(set(TEXTS))
    several = decontaminate.find_contamination(docs, bench, index_bytes=200, keep=["doc_id"])
    assert "text" not in several.columns and decontaminate.find_contamination(empty(docs), bench, index_bytes=200).count() == 0
    blank = spark.createDataFrame([(1, "- " * 200), (2, "+ " * 200)], "item_id bigint, text string")
    assert decontaminate.find_contamination(docs, blank, index_bytes=200).where("size(items) > 0 OR size(spans) > 0").count() == 0
    assert decontaminate.find_contamination(empty(docs), bench).count() == 0
    assert decontaminate.find_contamination(docs, empty(bench)).where("size(items) > 0").count() == 0


def test_decontamination_by_share(spark):
    text = PASSAGE.split()
    near = text[:13]
    near[4] = "changed"
    frame = spark.createDataFrame([(1, " ".join(near))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    assert decontaminate.find_contamination(frame, bench, share=0.9).first()["items"] == [1]
    assert decontaminate.find_contamination(frame, bench, share=1.0).first()["items"] == []


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.train(documents.withColumn("y", F.lit(0)), labels)
    scored = toxicity.score_toxicity(documents.withColumn("score", F.lit("old")), machine)
    rows = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").toPandas()
    positive, predicted = rows.toxic == 1, rows.score >= 0.5
    assert rows.score.between(0, 1).all() and (predicted == positive).mean() > 0.96
    assert rows.score[positive].median() > 0.5 > rows.score[~positive].max() - 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000), (3, None)], "doc_id bigint, text string")
    assert toxicity.score_toxicity(odd, machine).where("score BETWEEN 0 AND 1").count() == 4
    none = toxicity.train(empty(documents), labels)
    assert toxicity.score_toxicity(odd, none).where("score >= 0.5").count() == 0
    assert toxicity.score_toxicity(empty(odd), none).count() == 0


@pytest.mark.parametrize("kind", ["either but not both", "both"])
def test_toxicity_of_pairs(kind):
    """Two terms among noise, of which neither says anything by itself, or both together alone count."""
    rng = np.random.default_rng(1)
    rows, label = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted({*(10 + rng.integers(0, 300, 12)).tolist(), *([1] if a else []), *([2] if b else [])})))
        label.append(int(a != b) if kind != "both" else int(a and b))
    label = np.array(label)
    machine = toxicity.fit(rows[:3000], label[:3000])
    flat, at = toxicity._flat(rows[3000:])

    def right(m):
        return ((m.score(flat, at) >= 0.5) == label[3000:]).mean()

    assert right(machine) >= 0.95
    if kind != "both":  # that weights alone can tell, too
        without = machine._replace(factor=np.zeros_like(machine.factor))
        assert right(without) <= right(machine) - 0.2


def test_toxicity_score_is_its_formula():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    known = rng.random(toxicity.BUCKETS) < 0.7
    machine = toxicity.Machine(0.3, rng.normal(0, 1, toxicity.BUCKETS), rng.normal(0, 0.4, (toxicity.BUCKETS, toxicity.FACTORS)), known)
    texts = ["You are one, and ONE only.", "", None, "a b c d e f g a b", "é ü " * 3]
    flat, at = toxicity.terms(pa.array(texts))
    for got, a, b, text in zip(machine.score(flat, at), at[:-1], at[1:], texts, strict=True):
        assert b - a == len(set(re.findall(ALNUM, lower(text))))
        used = [t for t in flat[a:b] if known[t]]
        raw = machine.bias + sum(machine.weight[t] for t in used) * max(len(used), 1) ** -toxicity.POWER
        raw += sum(machine.factor[s] @ machine.factor[t] for i, s in enumerate(used) for t in used[:i])
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9


def test_toxicity_never_learns_from_held_out_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    frame = spark.createDataFrame([(i, "bad") for i in ids], "doc_id bigint, text string")
    machine = toxicity.train(frame, spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, toxic int"))
    assert not machine.weight.any()


def shingles(text):
    w = re.findall(SPACE, lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = dict(zip(sets, sets, strict=True))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs):
    assert {tuple(r) for r in neardup.link_classes(docs).collect()} == classes(dict(enumerate(TEXTS)))
    assert neardup.link_classes(empty(docs)).count() == 0
    odd = spark.createDataFrame([(None, BASE), (1, BASE), (1, BASE), (5, BASE), (5, PASSAGE), (3, PASSAGE), (9, "a b")], "doc_id bigint, text string")
    got = Counter(tuple(r) for r in neardup.link_classes(odd).collect())
    n, m = len(shingles(BASE)), len(shingles(PASSAGE))
    assert {k[2] for k in got if k[0] in (1, 5, 3)} == {1} and got[(1, n, 1)] == 2 and got[(None, n, None)] == 1 and got[(3, m, 1)] == 1 and got[(9, 1, 9)] == 1


@pytest.mark.parametrize("percent", [80, 60])
def test_near_duplicates_in_chains(spark, percent):
    """Copies that drift: neighbours are linked, far ones aren't, and shared passages make false candidates."""
    rng = np.random.default_rng(3)
    texts, i = {}, 0
    for family in range(6):
        words = prose(100 + family, 60 + 140 * family, 2000).split()
        for _ in range(25):
            texts[i] = " ".join(words + (PASSAGE.split()[:30] if i % 2 else []))
            for at in rng.integers(0, len(words), max(1, len(words) // 60)):
                words[at] = f"n{rng.integers(1 << 30)}"
            i += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {tuple(r) for r in neardup.link_classes(frame, percent=percent).collect()}
    if percent == 80:
        assert got == classes(texts)
    else:
        assert len({r[2] for r in got}) <= len({r[2] for r in classes(texts)})


def test_bands_of_all_partners_meet():
    for percent in (30, 50, 60, 72, 80, 95):
        bands = neardup.Bands(percent)
        for n in range(1, 300):
            for small in range(-(-n * percent // 100), n):
                assert bands.of(small) in bands.joined(n) and bands.of(small) in bands.joined(small), (percent, small, n)


def test_frequent_keys_send_a_row_a_task(monkeypatch):
    """Forty batches that share a passage: nearly all its keys go to their task once or twice, and each document still stands with one that has the key."""
    import pyarrow as pa

    monkeypatch.setattr(neardup, "SLOTS", 1 << 13)
    shared = prose(5, 400, 5000)
    batches = [pa.RecordBatch.from_arrays([pa.array([2 * b, 2 * b + 1]), pa.array([shared + " " + prose(500 + b, 3), shared + " " + prose(900 + b, 60, 5000)])], names=["doc_id", "text"]) for b in range(40)]
    rows = [r for b in neardup._keys(5, 80)(iter(batches)) for r in b.to_pylist()]
    sets = neardup.shingle_sets(pa.concat_arrays([b.column("text") for b in batches]))
    want = {(int(k), doc) for doc, s in enumerate(sets) for k in neardup.band_keys(s, neardup.Bands(80)).view(np.int64)}
    assert {(r["k"], r["doc"]) for r in rows} == want and {(r["k"], r["pivot"]) for r in rows} <= want
    own = {(r["k"], r["doc"]) for r in rows if r["doc"] == r["pivot"]}
    assert {(r["k"], r["pivot"]) for r in rows} <= own
    shares = Counter(k for k, _ in want)
    heads = Counter(k for k, _ in own)
    frequent = [k for k, n in shares.items() if n >= 40]
    # two that meet in one slot of this task leave one of them with a head a batch
    assert len(frequent) > 20 and np.mean([heads[k] for k in frequent]) < 3 and np.mean([heads[k] > 2 for k in frequent]) < 0.05


def test_near_duplicates_with_one_slot(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "SLOTS", 1)
    assert {tuple(r) for r in neardup.link_classes(docs).collect()} == classes(dict(enumerate(TEXTS)))


@pytest.mark.parametrize("percent", [60, 30])
def test_near_duplicates_of_lower_percents(spark, percent):
    """Pairs just at the bound of 60 and 30 %, also with sketches of sizes four times apart."""
    texts, sizes = {}, [(100, 60), (100, 59), (40, 24), (250, 151), (90, 27), (90, 26), (4200, 1300)]
    for i, (n, m) in enumerate(sizes):
        words = [f"p{i}x{j}" for j in range(n + 4)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(words[: m + 4])
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.link_classes(frame, percent=percent).collect()}
    for i, (n, m) in enumerate(sizes):
        assert (got[2 * i + 1] == 2 * i) == (100 * m >= percent * n), (n, m)


def kept_words(texts, window=35):
    rows = [re.findall(SPACE, t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in rows for i in range(len(w) - window + 1))
    out = []
    for w in rows:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substrings(spark, docs, monkeypatch):
    want = kept_words(TEXTS)
    # 3: some prefixes grow; 1: every shared prefix grows to a whole window; none sent: rows get theirs by joins
    for group, size, sent in ((20_000, 1 << 30, 100), (3, 1 << 30, 100), (20_000, 600, 100), (1, 1 << 30, 1000), (1, 1 << 30, 0)):
        monkeypatch.setattr(substrings, "GROUP", group)
        monkeypatch.setattr(substrings, "GROUP_BYTES", size)
        monkeypatch.setattr(substrings, "SENT", sent)
        got = substrings.remove_repeats(docs).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
            assert (r.d, r.x, r.spans) == (r.doc_id, r.doc_id, "x")
    assert substrings.remove_repeats(empty(docs)).count() == 0
    twice = spark.createDataFrame([(1, BASE), (1, BASE), (None, BASE + " " + prose(40, 50)), (2, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(twice).collect())
    assert got == [(0, 120), (1, 120), (1, 120), (2, 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ", max_size=40), max_size=8), st.integers(1, 6))
def test_maximal_repeats_cover_repeated_windows(texts, window):
    import pyarrow as pa

    words = split(pa.array(texts, pa.string()))
    found = substrings.maximal_repeats(substrings.suffix_array(words, hashes(words), window), window)
    got = {(p, j) for p, lo, hi in zip(*(x.tolist() for x in found), strict=True) for j in range(lo, hi)}
    rows = [t.split(" ") for t in texts]
    rows = [[w for w in r if w] for r in rows]
    count = Counter(tuple(r[i : i + window]) for r in rows for i in range(len(r) - window + 1))
    assert got == {(k, j) for k, r in enumerate(rows) for i in range(len(r) - window + 1) if count[tuple(r[i : i + window])] > 1 for j in range(i, i + window)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé ", max_size=60), max_size=8), st.integers(1, 4))
def test_repeats_are_maximal(texts, window):
    """Suffixes are in the order of their words, and each span reaches as far as its suffix is like any other."""
    import pyarrow as pa

    words = split(pa.array(texts, pa.string()))
    suffixes = substrings.suffix_array(words, hashes(words), window)
    rows = [[w.encode() for w in t.split(" ") if w] for t in texts]
    every = [(r[i:], (k, i)) for k, r in enumerate(rows) for i in range(len(r) - window + 1)]
    got = [rows[k][i:] for k, i in zip(suffixes.piece.tolist(), suffixes.offset.tolist(), strict=True)]
    assert got == sorted(r for r, _ in every)

    def common(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    assert suffixes.common.tolist()[1:] == [common(a, b) for a, b in zip(got[:-1], got[1:], strict=True)]
    want = set()
    for r, (k, i) in every:
        n = max((common(r, other) for other, at in every if at != (k, i)), default=0)
        want |= {(k, i, i + n)} if n >= window else set()
    merged = []
    for k, lo, hi in sorted(want):
        if merged and merged[-1][0] == k and lo <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], hi)
        else:
            merged.append([k, lo, hi])
    found = substrings.maximal_repeats(suffixes, window)
    assert [list(x) for x in zip(*(x.tolist() for x in found), strict=True)] == merged


def thue_morse(bits):
    text = "a"
    for _ in range(bits):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_hashes_of_words_that_differ_in_form_only():
    """Words that sums over powers don't tell apart, and words of over 1 MiB with bytes far apart swapped."""
    import pyarrow as pa

    a = thue_morse(11)
    long = "x" * (1 << 20) + "y" + "z" * 30
    cases = [a, a.translate(str.maketrans("ab", "ba")), long, "y" + long[1 : 1 << 20] + "x" + "z" * 30, "a", "b", "12345678", "123456789", "1234567812345678", "é" * 9]
    words = split(pa.array([" ".join(cases + cases)]))
    assert len(set(hashes(words).tolist())) == len(cases)
    runs, of = token_files.distinct_runs(words.data, words.starts, words.ends)
    assert [r.decode() for r in runs] == cases and of.tolist() == [*range(len(cases))] * 2


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "run_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(3))
    words = split(pa.array(["one two one three four fivefivefive sixsixsixsix fivefivefive"]))
    runs, of = token_files.distinct_runs(words.data, words.starts, words.ends)
    assert [runs[i].decode() for i in of] == [words.text(i).decode() for i in range(len(of))]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_equal_sums_keep_their_own_ids(spark, name):
    from tokenizers import Tokenizer

    a = thue_morse(11)
    texts = [a + " " + a.translate(str.maketrans("ab", "ba")), "b" + "x" * (1 << 20) + "c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encode = token_files.encode if name.startswith("word") else bpe.bpe_encode
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    got = {r.doc_id: r.ids for r in encode(frame, tokenizer_path(name)).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_near_duplicates_and_passages_of_words_of_equal_sums(spark):
    a = thue_morse(11)
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(40))
    long = prose(11, 12_000, 3000)  # some 60 kB
    wide = "y" * ((1 << 20) + 5)  # a word of more than 1 MiB
    texts = {1: f"{a} one two three four", 2: f"{b} one two three four", 3: f"{a} {tail}", 4: f"{b} {tail}", 5: long, 6: long.replace("w7 ", "v7 ", 3), 7: f"{wide} {tail} end", 8: f"{wide}y {tail} end"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {tuple(r) for r in neardup.link_classes(frame).collect()} == classes(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame).collect()}
    assert got == dict(zip(texts, kept_words(texts.values()), strict=True))


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json")).collect():
        ids = tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
    encoded = bpe.bpe_encode(docs, tokenizer_path("byte_bpe_50k.json"))
    twice = bpe.bpe_round_trip(docs.where("doc_id = 15").unionByName(docs.where("doc_id = 15")), tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert {r.doc_id: r.text for r in bpe.bpe_decode(encoded, tokenizer_path("byte_bpe_50k.json")).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.bpe_round_trip(empty(docs), tokenizer_path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sé<|>endoftext\u00a0\u3000\u0301")), max_size=40))
def test_bpe_is_the_library(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = test_bpe_is_the_library.__dict__.setdefault("tokenizer", Tokenizer.from_file(path))
    texts = [text, text + "<|endoftext|>" + text, text[::-1]]
    flat, at = bpe._encode_batch(bpe.encoder(path), pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sÉ<|>endoftext\u00a0\u0301\u0338")), max_size=40))
def test_chunks_are_the_library(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = test_chunks_are_the_library.__dict__.setdefault("tokenizer", Tokenizer.from_file(path))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "<|endoftext|>" + text])], names=["text"])
    (_, at, flat), *_ = token_files._encoded([batch], path, None)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "<|endoftext|>" + text)]


@pytest.mark.parametrize("hot", [1, 10_000])
def test_warc(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    body = "<p>" + "é" * 60
    cases = [(5, "http://www.Example.com/a?b", body), (3, "http://b.org/", body), (9, None, body), (4, "http://b.org/", None), (7, "http://b.org/", ""), (8, "x", "short"), (2, "y", "short"), (10, "http://b.org/\r\nx", "z" * 300_000), (3, "http://b.org/", body), (None, "http://n/", body)]
    frame = spark.createDataFrame(cases, "page_id bigint, url string, html string").withColumn("digest", F.lit("d")).withColumn("n", F.lit(1)).repartition(3)
    archive = warc.write_archive(frame)
    got = Counter(tuple(r) for r in archive.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for i, _, html in cases:
        raw = (html or "").encode()
        again = len(raw) >= 100 and i is not None and i > min(j for j, _, h in cases if h == html and j is not None)
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(j for j, _, h in cases if h == html and j is not None) if again else None)] += 1
    assert got == want
    found = archive.lookup("http://b.org/")
    assert sorted(h["x-page-id"] for h, _ in found) == ["3", "3", "4", "7"]
    assert archive.lookup("http://www.example.com/a?b")[0][0]["warc-type"] == "revisit" and archive.lookup("http://absent/") == []
    assert warc.write_archive(empty(frame)).read().count() == 0


def test_index_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    frame = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 13, F.lit(".org/p"), F.col("id") % 5).alias("url"), F.concat(F.lit("x" * 100), F.col("id")).alias("html"))
    archive = warc.write_archive(frame)
    for row in frame.where("page_id % 29 = 0").collect():
        assert row.html.encode() in [p for h, p in archive.lookup(row.url)]
    assert archive.read().count() == 200


def test_pieces_of_latin_letters_need_no_pattern():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    coder, library = bpe.PrefixEncoder(path), Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    texts = [" ciónosieque", "enzutzen", " ªbº", "ŉa", " ­", "a­b", " x\x7f\x01", "été's", " don't", "a1", " 12²", "ɐb", "é", " ", "", "日本", " ǅz", "aaaaaaaaaaaaaaaa" * 9]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(coder.chunk(t), "<u4").tolist() for t in texts] == want
    coder = bpe.PrefixEncoder(path)
    coder.split = None
    assert [np.frombuffer(coder.chunk(t), "<u4").tolist() for t in texts[:4]] == want[:4]
    assert all(coder.whole(token) for token, *_ in coder.automaton.values())
