"""Toxicity, pseudonyms and HTML text."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from vacantia.llm import html_text, pseudonyms, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_fold_undoes_disguises():
    assert toxicity.fold("IDIOT") == toxicity.fold("1d10t") == toxicity.fold("іdiоt") == toxicity.fold("ïdíòt") == " idiot "
    assert toxicity.fold("tr4$h!") == " trash "
    assert toxicity.fold("in 2024 and 50 more") == " in 2024 and 50 more "
    assert toxicity.fold("") == "  "


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, ("you absolute moron " if i % 3 == 0 else "what a nice day ") + f"w{i} v{i % 7}", "s", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, toxic_score int")
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (999, 1, None)], LABELS)
    return docs, labels, toxicity.learn(docs, labels, lambda d: ~toxicity.held_out(d))


def test_lexicon_scores_held_out_rows(trained):
    docs, labels, model = trained
    rows = toxicity.scored_digest(docs, labels).collect()
    assert len(rows) == 300
    assert all(r.predicted == int(r.doc_id % 3 == 0) and 0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows} == {True, False}
    assert " moron " in model.weights


def test_disguised_words_and_exceptions(trained):
    model = trained[2]
    model = toxicity.Model(model.weights, ("friendly moron",), model.curve)
    a = model.automaton()
    assert model.features("a m0r0n here", a)[0] == model.features("a MORON here", a)[0] > 0
    assert model.features("a friendly moron here", a)[0] == 0


def test_toxicity_edge_rows(spark, trained, hard_docs, no_docs):
    docs, labels, model = trained
    rows = toxicity.score(hard_docs, model).collect()
    assert len(rows) == hard_docs.count() and all(r.toxic_predicted in (0, 1) for r in rows)
    assert set(rows[0].row.asDict()) == set(hard_docs.columns)
    assert toxicity.scored_digest(no_docs, labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.scored_digest(hard_docs, none).collect()} == {0.0}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400))
def test_permutation_is_one_to_one(size):
    assert sorted(pseudonyms.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


@pytest.mark.parametrize("kind, text", [
    ("card", "4111 1111 1111 1111"), ("card", "5500-0000-0000-0004"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ("address", "10.20.30.40"), ("ssn", "123-45-6789"), ("phone", "+1 (559) 555-3817"), ("phone", "+49 30 1234567"),
    ("date", "2021-03-04"), ("date", "31.12.1999"), ("date", "12/31/1999"), ("mail", "jo.doe@mail.example.com")])
def test_pseudonyms_keep_the_format(kind, text):
    make, pattern = pseudonyms.MAKE[kind], pseudonyms.PATTERNS[kind]
    new = make(text, b"key")
    assert new and new != text and pattern.fullmatch(new)["value"] == new
    assert make(new, b"key") is not None  # validates again
    if kind != "address":
        assert re.sub("[0-9]", "9", new.lower()).translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "a" * 26)) == \
            re.sub("[0-9]", "9", text.lower()).translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "a" * 26))
    assert make(text, b"other") != new


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "999.1.1.1", "2021-02-30", "000-12-3456", "plain 12345678 words", "v1.2.3"])
def test_unvalidated_values_stay(text):
    assert pseudonyms.pseudonymise(f"see {text}.")[0] == f"see {text}."


def test_equal_values_stay_linked_across_spellings_of_a_day():
    a, b = pseudonyms.date("2001-02-03", b"k"), pseudonyms.date("03.02.2001", b"k")
    assert a.split("-") == b.split(".")[::-1]
    assert pseudonyms.mail("A@x.org", b"k") == pseudonyms.mail("a@x.org", b"k")


def test_protect_rows(hard_docs, no_docs):
    got = pseudonyms.protect(hard_docs, count="n").collect()
    want = hard_docs.collect()
    assert len(got) == len(want) and got[0].asDict().keys() == {*hard_docs.columns, "n"}
    by = {r.doc_id: r for r in got}
    assert by[3].text is None and by[4].text == "" and by[13].n == 3 and "jo.doe" not in by[13].text
    assert by[8].text == next(r.text for r in want if r.doc_id == 8)
    assert pseudonyms.protect(no_docs).count() == 0


def test_private_values_of_the_table_are_gone(spark):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op3_pii(spark, SMALL).collect():
        for m in pseudonyms.PATTERNS["mail"].findall(before[r.doc_id] or ""):
            assert m not in r.text


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<title>t</title><script>var x='</p>'</script><body>a <b>b</b>\n c</body>", "a b c"),
    ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>", "- a\n- b\n  1. c\n  2. d"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><td colspan=2>x</td><td>y</td></table>", "x    y"),
    ("a<div hidden>b</div><div style='display: none'>c</div><div style='visibility:hidden'>d</div>e", "a\ne"),
    ("<pre>a\n  b\n\nc</pre>x", "a\n  b\n\nc\n\nx"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("a<br>b<br><br>c &amp; d", "a\nb\n\nc & d"),
    ("</div></p>x<b>y", "xy"),
    ("<h1>T</h1><blockquote>q</blockquote>", "T\n\n  q"),
])
def test_visible_text(html, text):
    assert html_text.visible_text(html) == text


def test_html_is_kept_whole_when_deep_or_long():
    assert html_text.visible_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    words = " ".join(map(str, range(50_000)))
    assert html_text.visible_text(f"<p>{words}</p>") == words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<p> <b> </b> </p> <ul> <li> </ul> <table> <tr> <td> </table> </td> <div> </div> <pre> word & <br> <!-- <".split()), max_size=25))
def test_any_markup_is_read(parts):
    html_text.visible_text(" ".join(parts))


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, None, "old", 3), (None, "<p>x", None, None), (2, "<p>x", "o", 1), (2, "<p>x", "o", 1)],
                                  "page_id long, html string, text string, row int")
    rows = html_text.extract(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.row) for r in rows] == [(None, "x", None), (1, "", 3), (2, "x", 1), (2, "x", 1)]
    assert queries.op10_html_text(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()
