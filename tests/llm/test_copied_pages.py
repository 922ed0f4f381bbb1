"""Templates: copies of pages, classes by brute force, and pages that only their template tells apart."""

from collections import defaultdict

import pytest

from tapeloom.llm import template

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copies_of_a_page_keep_their_text(spark):
    page = lambda said: f"<html><body><div class='top'>Site name</div><div class='main'><p>{said} first words of it</p><p>{said} and some more</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page("copied")) for i in range(6)] + [(10 + i, f"http://h.example/o{i}", page(f"own {i}")) for i in range(5)]
    rows += [(20 + i, f"http://g.example/{i}", page("alone")) for i in range(4)]
    out = texts(spark, rows)
    assert all("copied first words of it\ncopied and some more" in out[i] for i in range(6))
    assert all(f"own {i} first words of it" in out[10 + i] and "Site name" not in out[10 + i] for i in range(5))
    assert all("alone first words of it\nalone and some more" in out[20 + i] for i in range(4))


def test_a_main_slot_of_template_text_only_is_kept():
    said = template.Page("<body><main><p>All of it</p></main></body>")
    classes = [{"tokens": [t[0] for t in said.texts], "kinds": [template.HELD] * len(said.texts)}]
    assert said.extract(None, classes) == "All of it"


def plain_page(i, order=False):
    top = ["<div class='q1'><span>Menu of the site</span></div>", "<div class='q2'><span>Read this first</span></div>"]
    parts = "".join(reversed(top) if order else top)
    return f"<html><head><title>t</title></head><body>{parts}<div class='q3'><div class='q4'><h2>Heading number {i}</h2><p>Sentence {i} of the page, longer than the rest.</p><p>Another {i * 7} sentence, also of some length.</p><div class='q5'><i>Join our list today</i></div></div></div><div class='q6'>All rights kept</div></body></html>"


def test_pages_without_an_article_or_telling_names(spark):
    rows = [(i, f"http://h.example/{i}", plain_page(i)) for i in range(2)] + [(10 + i, f"http://g.example/{i}", plain_page(i)) for i in range(9)]
    want = lambda i: f"Heading number {i}\nSentence {i} of the page, longer than the rest.\nAnother {i * 7} sentence, also of some length."
    assert texts(spark, rows) == {k: want(k % 10) for k, _, _ in rows}
    # without the template, all that the body has would be said
    assert "Menu of the site" in template.Page(plain_page(1)).extract(None)


def test_a_notice_in_every_article_goes_and_repeated_paragraphs_stay(spark):
    page = lambda i: f"<html><head><title>On {i}</title></head><body><article><h1>On {i}</h1><p>Own words {i} are here.</p><p>Said on all pages.</p><p>And more of {i}.</p><div class='k7'><i>Tell your friends</i></div></article></body></html>"
    out = texts(spark, [(i, f"http://h.example/{i}", page(i)) for i in range(8)])
    assert out == {i: f"On {i}\nOwn words {i} are here.\nSaid on all pages.\nAnd more of {i}." for i in range(8)}
    assert "Tell your friends" in template.Page(page(1)).extract(None)


def test_a_class_holds_where_its_tokens_keep_their_order():
    page = template.Page(plain_page(3))
    tokens = [t[0] for t in page.texts if t[1].endswith("span")]
    whole = lambda order: [{"tokens": order, "kinds": [template.HELD, template.HELD]}]
    assert page.said_by(whole(tokens))[0] == set(tokens) and page.said_by(whole(tokens[::-1]))[0] == set()


def test_classes_are_those_of_vectors_laid_out(spark):
    """The classes of a host, against occurrence vectors that are laid out and compared."""
    page = lambda i: f"<body><div class='a'>Top</div><ul>{'<li>x</li>' * (i % 3)}</ul>{'<b class=z>Some</b>' if i % 2 else ''}<p>own {i}</p><div class='e'>End</div></body>"
    sources = [page(i) for i in range(8)]
    vectors = defaultdict(lambda: [0] * len(sources))
    for n, source in enumerate(sources):
        parsed = template.Page(source)
        for t in (*parsed.tags, *parsed.texts):
            vectors[t[0]][n] += 1
    plain = defaultdict(set)
    for token, v in vectors.items():
        if sum(x > 0 for x in v) >= len(sources) / 2:
            plain[tuple(v)].add(token)
    found = template.templates(spark.createDataFrame([(n, f"http://h.example/{n}", source) for n, source in enumerate(sources)], SCHEMA)).collect()
    vector_of = lambda token: tuple(vectors[token])
    got = defaultdict(set)
    for r in found:
        assert len({vector_of(t) for t in r.tokens}) == 1 and r.parent < r["class"]
        got[vector_of(r.tokens[0])] |= set(r.tokens)
    assert got == plain
    # nested: a class is in one gap of the class around it, on every page
    by = {r["class"]: r for r in found}
    for r in found:
        if r.parent < 0:
            continue
        for source in sources:
            parsed = template.Page(source)
            first = {}
            for t in (*parsed.tags, *parsed.texts):
                first.setdefault(t[0], t[2])
            around = sorted(first[t] for t in by[r.parent].tokens if t in first)
            own = [first[t] for t in r.tokens if t in first]
            assert len({sum(a < x for a in around) for x in own}) <= 1


@pytest.mark.parametrize("name", ["ad-hoc", "related-work", "social-policy", "banner-story", "share-price"])
@pytest.mark.parametrize("tag", ["p", "div"])
def test_a_word_in_a_class_name_drops_no_text(spark, name, tag):
    source = lambda n: f"<body><nav>Menu</nav><article><h1>T{n}</h1><p>First {n}.</p><{tag} class='{name}'>Second {n}.</{tag}><p>Third {n}.</p></article></body>"
    assert template.Page(source(1)).extract(None) == "T1\nFirst 1.\nSecond 1.\nThird 1."
    out = texts(spark, [(n, f"http://h.example/{n}", source(n)) for n in range(6)])
    assert out == {n: f"T{n}\nFirst {n}.\nSecond {n}.\nThird {n}." for n in range(6)}


def test_named_parts_go_by_a_second_sign():
    page = lambda part: template.Page(f"<article><p>Own words.</p>{part}</article>").extract(None)
    assert page("<div class='advert'>Buy</div>") == page("<section id='comments-list'><p>Nice</p></section>") == "Own words."
    assert page("<p class='share-price'><a href='x'>one</a> <a href='y'>two</a></p>") == "Own words."
    assert page("<p class='share-price'>It rose, <a href='x'>they</a> said.</p>") == "Own words.\nIt rose, they said."
    assert page("<p class='ad'>A paragraph</p>") == "Own words.\nA paragraph"


def test_a_short_article_under_a_long_notice(spark):
    notice = "Read this before all else. " * 60
    source = lambda n: f"<body><article><h1>Head {n}</h1><div class='n'>{notice}</div><p>Short {n}.</p></article></body>"
    out = texts(spark, [(n, f"http://h.example/{n}", source(n)) for n in range(8)])
    assert out == {n: f"Head {n}\nShort {n}." for n in range(8)}


def test_articles_beside_each_other_are_kept(spark):
    source = lambda n: f"<body><main><article><p>One {n}, the longer of both.</p></article><article><p>Two {n}.</p></article></main><div><article><p>Elsewhere</p></article></div></body>"
    assert template.Page(source(1)).extract(None) == "One 1, the longer of both.\nTwo 1."
    out = texts(spark, [(n, f"http://h.example/{n}", source(n)) for n in range(5)])
    assert out[3] == "One 3, the longer of both.\nTwo 3."


def test_large_templates_are_joined_by_salt(spark, monkeypatch):
    rows = [(n, f"http://h{n % 2}.example/{n}", f"<body><div class='top'>Menu of the site</div><div class='c'><p>Words {n} of many.</p></div></body>") for n in range(20)]
    want = texts(spark, rows)
    monkeypatch.setattr(template, "FEW_TOKENS", 0)
    assert texts(spark, rows) == want and want[7] == "Words 7 of many."
