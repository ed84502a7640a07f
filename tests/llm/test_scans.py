"""Secret scans, licences, quotations and page texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from themeloom.llm import guesses, licences, pages, quoting, secret_scan
from themeloom.llm.inputs import table

KINDS = ("assign", "access", "hex")


def test_fixed_patterns(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    odd = [
        (-1, None), (-2, ""), (-3, "é token=token: abcdefghijklmnop Token = 'abc' API_KEY:AKIA" + "A" * 16),
        (-4, "ü secret=deadbeefdeadbeef0 passwd=short"), (-5, "AKIAAKIA" + "B" * 14), (-5, "AKIAAKIA" + "B" * 14),
        (-6, "toKen=abcdefghijklmnop"), (None, "f" * 20),
    ]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.scan(docs).collect()]
    want = []
    for r in docs.collect():
        spans = brute.base_spans(r.text)
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        want.append((r.doc_id, *counts, digest))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_guess_costs():
    assert guesses.cost("") == 0
    weak = ["password", "Password1", "qwertyuiop", "aaaaaaaaaa", "12345678", "2021-05-17", "letmein2020", "asdfgh"]
    strong = ["x9$Kq2!vTz", "Gh7#pLm2Qx", "8fJ-2kd9Wq_z"]
    assert max(map(guesses.cost, weak)) < 8 <= min(map(guesses.cost, strong))
    for value in weak + strong:  # a part more never costs less
        assert guesses.cost(value) <= guesses.cost(value + "~") + 1e-9
    assert guesses.cost("abcabc" * 20000) > 0


def test_guessed_values(spark):
    rows = [
        (1, "the password: x9$Kq2!v here"), (2, "password: summer2020"), (3, "url https://bob:x9$Kq2!vT@host.example/x"),
        (4, 'token = "0123456789abcdef0123"'), (5, "the secret: the word is out"), (6, "é pwd='Gh7#pLm2Qx'"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    found = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    assert found[1] == "guess:14:22" and found[2] == "" and found[5] == ""
    assert rows[2][1][int(found[3].split(":")[1]) :].startswith("x9$Kq2!vT") and found[3].startswith("guess")
    assert [s.split(":")[0] for s in found[4].split(",")] == ["assign", "hex"]
    assert found[6] == "guess:7:17"


def test_licence_families(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    more = [
        (-1, None), (-2, ""), (-3, "Some words.\nReleased under the MIT License."), (-4, "the license of the poets is long"),
        (-5, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (-6, "All rights reserved. " * 3),
    ]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    got = {r.doc_id: r for r in licences.licences(docs).collect()}
    assert len(got) == docs.count()
    assert got[-3].families == "mit" and got[-5].families == "apache,reserved" and got[-6].n_licence == 3
    assert got[-1].families == got[-2].families == got[-4].families == ""
    notices = {"Apache License": "apache", "MIT License": "mit", "GNU General": "gpl", "All rights reserved": "reserved", "CC BY-NC": "cc"}
    for r in docs.filter("doc_id >= 0").collect():
        want = {family for text, family in notices.items() if text in r.text}
        assert set(filter(None, got[r.doc_id].families.split(","))) == want
    empty = spark.createDataFrame([], "doc_id long, text string, words string")
    assert licences.licences(empty).count() == 0


def test_licences_in_words_of_ordinary_text(spark):
    """The first documents use the words of a notice, but not as a notice."""
    plain = "The person reserved a room. Our rights are many. All of it was granted. We had permission of the source."
    rows = [(i, plain) for i in range(40)] + [(900 + i, plain) for i in range(400)] + [(5000, "All rights reserved.")]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000].families == "reserved" and got[0].families == ""


def test_unknown_licence_sentences_come_from_all_documents(spark):
    """The model knows the words of the last of 500 documents, whose ids are the largest."""
    last = "Permission is hereby granted to the guests of the house."
    rows = [(i, f"The river number {i} is long.") for i in range(500)] + [(9000, last), (9001, "The sea.\nIt is large."), (9002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    background = [r.sentence for r in licences._background(docs).collect()]
    assert len(background) == 504 and last in background
    model = licences.fit(docs, licences.LicenceSettings())
    best = model.classifier.transform(licences.featured(spark.createDataFrame([(last,)], "sentence string"))).first()
    assert best.prediction == licences.UNKNOWN


def test_quantile_of_held_out_values(spark):
    for values in ([], [0.25], [0.1, 0.9], [0.5] * 700 + [i / 1000 for i in range(900)]):
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        for share in (0.0, 0.31, 0.999):
            want = rows.agg(F.percentile("v", F.lit(share)).alias("p")).first().p
            assert licences._quantile(rows, share) == want


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> hello  THERE.\nFine!"), (1, 2, "u", ">> Hello there.\n> Fine!\nGood."),
        (1, 3, "a", "> How are you?\nok"), (1, 4, "u", "thanks"), (2, 0, "u", "> Fine!\nx"), (2, 1, None, None), (None, 1, "u", "> Fine!\nq"),
    ]
    messages = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = {(r.conv_id, r.turn): r for r in quoting.replies(messages).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].own_text == "Fine!" and (got[1, 1].reply_conv, got[1, 1].reply_turn) == (1, 0)
    assert got[1, 2].n_quotes == 2 and got[1, 2].n_linked == 2 and got[1, 2].max_level == 2 and got[1, 2].reply_turn == 1
    assert got[1, 3].reply_turn == 0 and got[1, 4].reply_turn == 3
    order = sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: r.position)
    assert [r.turn for r in order] == [0, 3, 4, 1, 2]
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn) == (1, 1) and got[2, 1].own_text == ""
    assert got[None, 1].position is None and got[None, 1].own_text == "q" and got[None, 1].reply_conv is None
    assert quoting.replies(messages.limit(0)).count() == 0


def test_nested_branches(spark):
    """Each message quotes the line of two turns before it."""
    rows = [(1, t, "u", (f"> line {t - 2}\n" if t > 1 else "") + f"line {t}") for t in range(12)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(quoting.replies(messages).collect(), key=lambda r: r.position)
    up = {r.turn: r.reply_turn for r in got}
    assert up == {0: None, 1: 0, **{t: t - 2 for t in range(2, 12)}}
    assert [r.turn for r in got] == [0, 2, 4, 6, 8, 10, 1, 3, 5, 7, 9, 11]


def answers(spark, rows):
    messages = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h int")
    return sorted(quoting.replies(messages).collect(), key=lambda r: (r.conv_id, r.turn, r.own_text))


def test_quotes_of_some_lines_and_of_other_conversations(spark):
    got = {(r.conv_id, r.turn): r for r in answers(spark, [
        (3, 0, "u", "one\ntwo\nthree"), (3, 1, "u", "x"), (3, 2, "u", "On Monday Ann wrote:\n> two\n>  THREE\nyes:\nno"),
        (3, 3, "u", "> unheard\n> x\nz"), (3, 4, "u", "> one two three\nwrapped"),
        # Said later in its own conversation, so it is from the other one.
        (5, 0, "u", "> late line\nz"), (5, 1, "u", "late line"), (6, 0, "u", "late line"), (7, 0, "u", "late line"),
    ])}
    assert (got[3, 2].reply_turn, got[3, 2].n_quotes, got[3, 2].n_linked, got[3, 2].own_text) == (0, 1, 1, "yes:\nno")
    assert got[3, 3].reply_turn == 1 and got[3, 4].reply_turn == 0
    assert (got[5, 0].reply_conv, got[5, 0].reply_turn) == (6, 0) and got[5, 1].reply_turn == 0


def test_rows_that_repeat_a_turn(spark):
    rows = [(3, 0, "u", "a"), (3, 1, "u", "b"), (3, 2, "u", "plain"), (3, 2, "u", "> a\nquoting"), (3, 2, "u", "> a\nquoting")]
    got = answers(spark, rows)
    assert len(got) == 5 and [(r.n_quotes, r.n_linked) for r in got if r.own_text == "plain"] == [(0, 0)]
    again = [r for r in got if r.own_text == "quoting"]
    assert {(r.n_quotes, r.n_linked, r.reply_turn) for r in again} == {(1, 1, 0)} and len(again) == 2


def test_long_messages_and_long_conversations(spark):
    said = "\n".join(f"line {i}" for i in range(500))
    quoted = "\n".join((">> " if i % 2 else "> ") + f"line {i % 500}" for i in range(20_000))
    rows = [(1, 0, "u", said), (1, 1, "u", quoted)] + [(2, t, "u", "same" if t % 2 else "> same\nsame") for t in range(400)]
    got = {(r.conv_id, r.turn): r for r in answers(spark, rows)}
    assert (got[1, 1].n_quotes, got[1, 1].n_linked, got[1, 1].reply_turn) == (20_000, 20_000, 0)
    assert all(got[2, t].reply_turn == t - 1 for t in range(1, 400)) and got[2, 0].reply_turn is None
    assert sorted(r.position for r in got.values() if r.conv_id == 2) == list(range(1, 401))


def plain_links(rows):
    """(conv, turn) -> reply of each message with one passage, by looking everywhere."""
    def lines(text, level):
        found = [(len(x) - len(x.lstrip(">")), x.lstrip(">").strip()) for x in text.split("\n")]
        return [said for own, said in found if own == level and said]

    out = {}
    for conv, turn, text in rows:
        asked, votes = lines(text, 1), {}
        for hashed, n in [*[((x,), 1) for x in dict.fromkeys(asked)], (tuple(asked), len(asked))]:
            if n == 1 and len(asked) > 1 and hashed == tuple(asked):
                continue
            says = [(c, t) for c, t, other in rows if any(" ".join(hashed) == w for w in [*lines(other, 0), " ".join(lines(other, 0))])]
            near = [t for c, t in says if c == conv and t < turn]
            far = sorted(x for x in says if x[0] != conv)
            for place in ([(0, -max(near), conv, max(near))] if near else []) + ([(1, far[0][0], *far[0])] if far else []):
                votes[place] = votes.get(place, 0) + (n if len(asked) > 1 or n == 1 else 0)
            if len(asked) == 1:
                break
        best = min(votes, key=lambda p: (-votes[p], p)) if asked and votes else None
        out[conv, turn] = best and best[2:]
    return out


def test_links_equal_a_plain_search(spark):
    import random

    rng = random.Random(8)
    rows = []
    for conv in range(12):
        for turn in range(6):
            own = [rng.choice("abcdefghijkl") * 3 for _ in range(rng.randrange(1, 4))]
            quote = [rng.choice("abcdefghijkl") * 3 for _ in range(rng.randrange(3))]
            rows.append((conv, turn, "\n".join([*[f"> {q}" for q in quote], *own])))
    messages = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    want = plain_links(rows)
    for r in quoting.replies(messages).collect():
        if want[r.conv_id, r.turn] is None:
            assert r.n_linked == 0 and r.reply_turn == (r.turn - 1 if r.turn else None)
        else:
            assert r.n_linked == 1 and (r.reply_conv, r.reply_turn) == want[r.conv_id, r.turn], (r, want[r.conv_id, r.turn])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use the cookies of this site and you can
accept them all or not as you like it in the settings of it.</div><!-- x --><div class="ad">Buy the thing</div>{0}
<div id="comments"><p>I think that this is the best of all the articles that I have read in the last year or so.</p></div>
<footer>&copy; x &middot; y</footer></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>A &amp; B</h1><p>One<br>two.<p>Short.</p></article>", "A & B\nOne two.\nShort."),
        ("<main><h1><a href='/'>T</a></h1><p>x <b>y</b>z&#233;</p><ul><li><a href='/'>more</a></li></ul></main>", "T\nx yzé"),
        (
            "<div><p>It was the best of the times and it was the worst of them, as all of us know from the book.</p>"
            "<p>So it is.</p></div><form><p>Your name and all of the other things that we want to have from you for it.</p></form>",
            "It was the best of the times and it was the worst of them, as all of us know from the book.\nSo it is.",
        ),
        ("<article><p>a < b &lt;c&gt; <input><p>d<div class='share'>tweet</div></article>", "a < b <c>\nd"),
        ("<article></article>", ""),
    ],
)
def test_main_text(body, want):
    assert pages.main_text(PAGE.format(body)) == want


LONG_TEXT = "It was the best of the times and it was the worst of them, as all of us know from the book."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body class='has-sidebar with-comments'><p>{LONG_TEXT}</p></body>", LONG_TEXT),
        (f"<body class='sidebar'><article class='social-post'><p>{LONG_TEXT}<p>So.</article></body>", f"{LONG_TEXT}\nSo."),
        (f"<div id='page' class='no-sidebar'><main class='has-cookie-banner'><p>{LONG_TEXT}</p></main></div>", LONG_TEXT),
        (f"<div class='content-sidebar-wrap'><p>{LONG_TEXT}</p><div class='sidebar-left'><p>{LONG_TEXT}</p></div></div>", LONG_TEXT),
        (f"<div class='social-post'><p>{LONG_TEXT}</p><p>So.</p></div><div class='social-proof'>Tweet</div>", f"{LONG_TEXT}\nSo."),
        (f"<p>{LONG_TEXT}</p><div class='cookie-notice'><p>{LONG_TEXT}</p></div><div id='comments'><p>{LONG_TEXT}</p></div>", LONG_TEXT),
    ],
)
def test_names_of_states_do_not_hide_the_article(page, want):
    assert pages.main_text(f"<html class='no-overlay'>{page}</html>") == want


def test_pages(spark, tiny):
    source = table(spark, tiny, "pages")
    odd = spark.createDataFrame([(-1, None, None), (None, "u", ""), (-2, "u", "<p>" * 3000 + "x"), (-2, "u", "<a b='" * 2000)], source.schema)
    got = {(r.page_id, r.url): r for r in pages.extract(source.union(odd)).collect()}
    assert got[-1, None].text == "" and got[None, "u"].n_chars == 0
    for r in source.collect():
        text = got[r.page_id, r.url].text
        article = r.html.split("<article>")[1].split("</article>")[0]
        assert len(text) == got[r.page_id, r.url].n_chars
        assert brute.words(text) == brute.words(__import__("html").unescape(__import__("re").sub(r"<[^>]*>", " ", article)))
    assert pages.extract(source.limit(0)).count() == 0


def test_gate_of_licences_tries_common_beginnings_once(spark):
    assert licences._either([["a", "b", "c"], ["a", "b", "d"], ["e"], ["e", "f"]]) == "(?:ab(?:c|d)|e)"
    texts = ["wall  rights kept", "all, rights", "allrights", "version 22.0 x", "version 2", "creative\ncommons", "creativ commons", "0 1", ""]
    words = [re.findall("[a-z0]+", re.sub("[0-9]+", "0", t.lower())) for kind in licences.TEMPLATES.values() for t in kind]
    pairs = sorted({pair for w in words for pair in zip(w, w[1:])})
    texts += [f"x{a}{gap}{b}" for a, b in pairs for gap in (" ", "--", "", "é ", " 7 ")]
    plain = "|".join(r"[^\p{L}0-9]+".join(w.replace("0", "[0-9]+") for w in pair) for pair in pairs)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(licences._gate()).alias("got"), F.col("t").rlike(plain).alias("want"))
    assert rows.filter("got <> want").count() == 0 and 0 < rows.filter("want").count() < len(texts)
