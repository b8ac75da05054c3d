"""Token counts, packing, quality, toxicity and pages against plain versions."""

import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noticeworks.llm import html_extract, packing, quality, tokens, toxicity
from tests.llm.helpers import LONG, ROWS, documents, empty

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def every_letter():
    """All code points but surrogates, in texts that put each between letters, digits and spaces."""
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    return ["".join(f"a{c}1 {c} {c}{c}b" for c in letters[i : i + 2000]) for i in range(0, 0x30000, 2000)]


def test_counts_are_those_of_the_library_for_every_letter(libraries):
    counter = tokens.WholeTokenCounter(BYTES)
    for text in every_letter():
        assert counter.count(text) == len(libraries[0].encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sST \n\t\r\x1c\x85 　é1½²\U0001f600<|>endoftx.")))
def test_counts_are_those_of_the_library(text):
    library = Tokenizer.from_file(BYTES) if not hasattr(test_counts_are_those_of_the_library, "t") else test_counts_are_those_of_the_library.t
    test_counts_are_those_of_the_library.t = library
    assert tokens.counter(BYTES).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proven(libraries):
    counter = tokens.counter(BYTES)
    assert len(counter.whole) > 30_000
    assert all(len(libraries[0].encode(w, add_special_tokens=False).ids) == 1 for w in list(counter.whole)[:2000])


def test_count_tokens_cases(spark, libraries):
    found = {(r.doc_id, r.n_bytes): r for r in tokens.count_tokens(documents(spark)).collect()}
    for doc_id, text, *_ in ROWS:
        text = text or ""
        r = found[doc_id, len(text.encode())]
        assert r.n_tokens == len(libraries[0].encode(text, add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 1024)
    assert tokens.count_tokens(documents(spark)).count() == len(ROWS)
    assert tokens.count_tokens(empty(spark)).count() == 0


def test_ids_are_those_of_the_library_for_every_letter(libraries):
    ids = packing.WordIds(WORDS)
    for text in every_letter():
        assert ids.ids(text) == np.array(libraries[1].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_holds_each_id_once(spark, libraries):
    rows = packing.pack(documents(spark), group_docs=3).collect()
    wanted = Counter()
    pieces = {}
    for doc_id, text, *_ in ROWS:
        ids = np.array([*libraries[1].encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for start in range(0, len(ids), packing.SEQUENCE):
            part = ids[start : start + packing.SEQUENCE]
            wanted[doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == pieces.get(r.sequence_id, 0)
        pieces[r.sequence_id] = r.offset + r.length
    assert max(pieces.values()) <= packing.SEQUENCE
    assert all(r.sequence_tokens == pieces[r.sequence_id] for r in rows)
    assert packing.pack(empty(spark)).count() == 0


@given(st.lists(st.integers(1, 4096), max_size=80))
def test_first_fit_decreasing_is_that_of_a_plain_scan(lengths):
    lengths.sort(reverse=True)
    room, plain = [], []
    for n in lengths:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(4096)
        room[at] -= n
        plain.append(at)
    assert packing.first_fit_decreasing(lengths) == plain


def test_packing_does_not_depend_on_partitions(spark):
    rows = [(i % 50 if i % 7 else None, f"text {i % 90} " * (i % 13), "en", "s", 1) for i in range(400)] + [(1, "the same row", "en", "s", 1)] * 100
    one, two = (Counter(tuple(r) for r in packing.pack(documents(spark, rows).repartition(n), group_docs=40).collect()) for n in (1, 7))
    assert one == two and sum(one.values()) == 500


def test_powers_of_two_are_not_padded():
    assert [packing.padded(n) for n in (1, 2, 3, 1024, 1025, 4096)] == [1, 2, 4096, 1024, 4096, 4096]


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab#|  \n\té<"), max_size=60))
def test_base_counts_are_those_of_a_plain_version(text):
    model = quality.fertility(public_tokenizers.path("piece_bpe_32k.model"))
    assert quality.measure(text, model)[:5] == plain_base(text)


def test_quality_cases(spark):
    rows = quality.rate(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0
    assert by[1].base_failed and not by[1].kept
    assert by[6].n_words == 20_000 and by[6].kept
    assert quality.rate(empty(spark)).count() == 0


def test_quality_rejects_noise_and_keeps_prose(spark):
    import random

    draw = random.Random(1)
    prose = [" ".join(draw.choice(("the", "of", "house", "river", "walked", "over", "green", "hills", "and", "sang", "loudly")) for _ in range(200)) for _ in range(60)]
    noise = " ".join(w + draw.choice(("***", "###", "$$$", "%%%")) for w in prose[0].split())
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*prose, noise])]
    kept = {r.doc_id: r.kept for r in quality.rate(documents(spark, rows)).collect()}
    assert not kept[60]
    assert sum(not k for i, k in kept.items() if i < 60) <= 2


def test_quality_judges_lone_long_texts_and_small_tables(spark):
    import random

    draw = random.Random(2)
    words = [a + b for a in ("ri", "wa", "gre", "hil", "san", "lou", "mo", "ta", "pe", "ko") for b in ("ver", "lked", "en", "ls", "g", "dly", "ra", "no", "mi", "su")]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    few = words[:40]
    junk = lambda n: " ".join(draw.choice(few) for _ in range(n))
    for many in (60, 8):
        texts = [*(prose(draw.randrange(150, 400)) for _ in range(many)), junk(9000)]
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        kept = {r.doc_id: r.kept for r in quality.rate(documents(spark, rows)).collect()}
        base = {r.doc_id: r.base_failed for r in quality.rate(documents(spark, rows)).collect()}
        assert not any(base.values())
        assert not kept[many]
        assert sum(kept.values()) >= many - many // 8


def test_clauses_with_marks_score_less_or_more():
    scorer = toxicity.Scorer(toxicity.Model({"moron": 1.0}))
    plain, negated, reported, aimed = (scorer.clause(c.split()) for c in ("a moron here", "not a moron here", "he said so about some other person a moron", "you are a moron"))
    assert negated < plain <= aimed
    assert reported < aimed
    assert scorer.clause("a moron he said".split()) < plain and scorer.clause("a moron you are".split()) == aimed
    assert scorer.score("not here. moron") > scorer.score("not moron")
    assert scorer.score(None) == scorer.score("") == 0
    assert scorer.clause("they kill time".split()) > scorer.clause("kill time".split()) == 0


def test_composition_is_one_machine_after_another():
    negation = toxicity.marking("negation", "n", toxicity.REACH)
    report = toxicity.marking("report", "r", 0)
    both = toxicity.compose(negation, report)
    for symbols in (["negation", "insult-"], ["report", "word", "insult-"], ["negation", "report", "insult-", "word", "threat-"]):
        a, b, ab = "0", "0", "0|0"
        for s in symbols:
            a, mid = negation[a, s]
            b, out = report[b, mid]
            ab, joint = both[ab, s]
            assert joint == out


def plain_score(text, model):
    """The score by looking around every match, without machines."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[\w']+", clause)
        is_a = lambda w, group: w in group and w not in model.insults and w not in model.threats
        for i, w in enumerate(words):
            weight = model.insults.get(w, model.threats.get(w))
            if weight is None:
                continue
            before, after, reach = words[:i], words[i + 1 :], toxicity.REACH
            n = any(is_a(x, toxicity.NEGATIONS) for x in before[-reach:])
            r = any(is_a(x, toxicity.REPORTS) for x in before + after[:reach])
            t = any(is_a(x, toxicity.TARGETS) for x in before[-reach:] + after[:reach])
            total += weight * model.factors[("insult-" if w in model.insults else "threat-") + "n" * n + "r" * r + "t" * t]
    return 1 - np.exp(-total)


def test_scores_are_those_of_a_plain_search():
    import random

    draw = random.Random(18)
    words = "you not said never they kill hurt moron grobian the house she wrote river hill nicht dijo".split()
    model = toxicity.Model({"moron": 0.9, "grobian": 0.7}, {"kill": 0.6, "hurt": 0.5}, {p: draw.random() for p in toxicity.PATTERNS})
    scorer = toxicity.Scorer(model)
    for _ in range(500):
        text = "".join(draw.choice(words) + draw.choice("    , , .!\n") for _ in range(draw.randrange(30)))
        assert abs(scorer.score(text) - plain_score(text, model)) < 1e-9


def test_the_grammar_tells_what_a_bag_of_words_cannot(spark):
    """Clean documents deny or quote the words that toxic ones use."""
    import random

    draw = random.Random(19)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(500):
        bad, word = i % 2 == 0, draw.choice(("grobian", "schuft"))
        said = draw.choice((f"you {word}", f"a {word} indeed")) if bad else draw.choice((f"not a {word}", f"she wrote of a {word}", f"a {word} he said, indeed"))
        rows.append((i, " ".join(draw.choice(words) for _ in range(30)) + f". {draw.choice(words)} {said} {draw.choice(words)}. you a house indeed.", "en", "s", 1))
        marks.append((i, 1, int(bad)))
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert {"grobian", "schuft"} <= set(model.insults)
    assert all(model.insults[w] > 0.9 for w in ("grobian", "schuft"))
    found = toxicity.score(docs, model).where("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 2 == 0) for r in found) >= 0.95 * len(found) > 50
    assert model.factors["insult-n"] < 0.2 and model.factors["insult-rt"] < 0.2 and model.factors["insult-"] > 0.9


def test_toxicity_learns_from_the_training_folds_and_holds_out(spark):
    import random

    draw = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        body = [draw.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            body.insert(draw.randrange(40), draw.choice(("grobian", "schuft")))
        rows.append((i, " ".join(body), "en", "s", 1))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame([*marks, (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    weights = toxicity.learn(docs, labels)
    assert set(weights.insults) == {"grobian", "schuft"}
    found = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    assert all(found[i].predicted == int(i % 4 == 0) for i in range(400))
    assert found[7].held_out == (zlib.crc32(b"7") % 5 == 0)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, nothing).insults == {}
    assert toxicity.score(empty(spark), weights).count() == 0
    assert {r.score for r in toxicity.score(documents(spark), weights).collect()} == {0.0}


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=a>one</a></nav>
<div class="ad">Buy now.</div><div class='cookie-notice'>We use cookies.</div><article><h1>Head &amp; line</h1><p>First <b>part<br>goes on.<p>Second&nbsp; part &lt;here&gt;.</p>
<aside>Side.</aside><form><label>Mail</label><input></form><ul><li>Item one.</li></ul><!-- note --></article><div id="comments"><p>I like it.</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "Head & line\nFirst part goes on.\nSecond part <here>.\nItem one."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text('<div class="main-content has-sidebar"><p>A long enough line of prose to read, and then some more of it.</p></div>') != ""
    assert html_extract.main_text("<article><p>open <b") == "open <b"
    assert html_extract.main_text("<body><article>" + "<p>Some words to read here.</p>" * 3000).count("\n") == 2999


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7).flatmap(lambda n: st.tuples(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(1, 9)), max_size=14), st.just(n))))
def test_flow_is_the_least_cut(case):
    edges, n = case
    flow = html_extract.Flow(n)
    for u, v, c in edges:
        flow.add(u, v, c)
    level = flow.run(0, n - 1)
    side = {i for i in range(n) if level[i] >= 0}
    cut = lambda s: sum(c for u, v, c in edges if u in s and v not in s)
    assert n - 1 not in side
    assert cut(side) == min(cut({0} | {i for i in range(1, n - 1) if mask >> i & 1}) for mask in range(1 << n))


def test_pages_cases(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert rows[1].text == rows[2].text == "" and rows[3].n_chars == len(rows[3].text)
    assert html_extract.extract(pages.where("page_id > 9")).count() == 0
    assert LONG


def test_unclosed_elements_hide_nothing():
    words = "The river walked over the green hills and sang loudly in the early morning light of the year, as it does."
    article = f"<article><h1>Title</h1><p>{words}</p><p>{words}</p></article>"
    whole = f"Title\n{words}\n{words}"
    assert html_extract.main_text(f"<html><head><title>T</title><meta charset=utf-8><body>{article}</body></html>") == whole
    assert html_extract.main_text(f"<html><head><title>T</title><link rel=x>{article}</html>") == whole
    assert html_extract.main_text(f"<html><head><title>T</title></head><body>{article}</body></html>") == whole
    for odd in ('<svg class="i"/>', "<math/>", "<svg><path d='M0'>", "<select><option>", "<button>", "<canvas>", "<noscript>", "<template>"):
        assert html_extract.main_text(f"<body>{article.replace('</h1>', '</h1>' + odd)}</body>") == whole
    for hidden in ("<button>Press <div>here</div></button>", "<svg><title>t</title><text>label</text></svg>", "<noscript><p>Switch it on.</p></noscript>", "<svg><foreignObject><p>Label.</p></foreignObject></svg>"):
        assert html_extract.main_text(f"<body>{article.replace('</h1>', '</h1>' + hidden)}</body>") == whole


def page_of(draw, marks=True):
    """A random page and its article's blocks: a list of links, an advert, paragraphs long and short, a footer; without marks all elements are divs."""
    words = "river hills green morning light walked sang over house loudly year early".split()
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n)).capitalize() + "."
    body = [prose(draw.randrange(3, 9))[:-1], *(prose(draw.choice((1, 2, 25, 60))) for _ in range(draw.randrange(2, 7))), prose(40)]
    links = "".join(f"<li><a href=x>{draw.choice(words)}</a></li>" for _ in range(6))
    inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:])
    if marks:
        return f"<body><nav><ul>{links}</ul></nav><div class=ad>{prose(8)}</div><article>{inner}</article><section id=comments><p>{prose(30)}</p></section><footer>{prose(12)}</footer></body>", body
    return f"<body><div><ul>{links}</ul></div><div><div>{inner}</div></div><div><ul>{links}</ul></div></body>", body


def test_pages_give_the_blocks_of_their_articles():
    import random

    draw = random.Random(15)
    for k in range(200):
        page, body = page_of(draw, marks=k % 2 == 0)
        assert html_extract.main_text(page) == "\n".join(body)
        assert html_extract.main_text(re.sub(r" (class|id)=\w+", "", page)) == "\n".join(body)


def test_the_cut_decides_where_blocks_alone_tell_nothing():
    import random

    draw = random.Random(16)
    changed = 0
    for _ in range(60):
        page, body = page_of(draw, marks=False)
        found = html_extract.blocks(page)
        alone = [html_extract.preference(b, False) > 0 for b in found]
        changed += alone != html_extract.labelled(found)
    assert changed > 30


def test_labels_are_those_of_the_least_cost():
    import random

    draw = random.Random(17)
    for _ in range(25):
        found = html_extract.blocks(page_of(draw, marks=draw.random() < 0.5)[0])[3:14]
        n, has_article = len(found), any(b.node.article for b in found)
        ties = [(i - 1, i, html_extract.ADJACENT * html_extract.nearness(found[i - 1].node, found[i].node)) for i in range(1, n)]
        last = {}
        for i, b in enumerate(found):
            parent = b.node.parent.number
            if last.get(parent, i - 1) < i - 1:
                ties.append((last[parent], i, html_extract.SIBLING))
            last[parent] = i
        odds = [html_extract.preference(b, has_article) for b in found]
        cost = lambda side: sum(max(0, o) if not s else max(0, -o) for o, s in zip(odds, side)) + sum(w for a, b, w in ties if side[a] != side[b])
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.labelled(found)) - least) < 1e-6


def test_very_long_pages_are_read_whole(spark):
    page = "<body><nav><a href=x>Home</a></nav><article>" + "<p>Some words to read here, and then some more of them.</p>" * 20_000 + "</article></body>"
    rows = html_extract.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert rows[0].text.count("\n") == 19_999
