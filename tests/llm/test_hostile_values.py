"""Single values and ids made to be costly: the work must stay linear in their length or number."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.llm import language, licenses, minhash, toxicity, urls


@pytest.fixture
def within(request):
    began = time.time()
    yield
    assert time.time() - began < request.param



@pytest.mark.parametrize("within", [5], indirect=True)
def test_licence_expression_of_many_choices(within):
    text = "SPDX-License-Identifier: " + " AND ".join(f"(a{i} OR b{i})" for i in range(4000))
    assert licenses.scan(text.encode())[5] == sorted(f"{c}{i}" for c in "ab" for i in range(4000))


@pytest.mark.parametrize("within", [5], indirect=True)
def test_many_tags_on_one_line(within):
    text = "SPDX-License-Identifier: MIT OR " * 20_000 + "SPDX-License-Identifier: X WITH y"
    assert licenses.scan(text.encode())[5] == ["x-with-y"]
    text = "SPDX-License-Identifier: MIT rest of the line " * 20_000
    assert licenses.scan(text.encode())[5] == ["mit"]


@pytest.mark.parametrize("expression", ["MIT", "MIT OR X", "(MIT OR X) AND GPL-2.0 WITH classpath", "a and b or c and (d or e with f)", "((a))"])
def test_needed_ids_are_those_of_the_choices(expression):
    postfix = licenses.to_postfix(expression)
    assert licenses.needed_ids(postfix) == set().union(*licenses.evaluate(postfix))


@pytest.mark.parametrize("expression", ["(a or b) with c", "a with b with c", "a with (b or c)"])
def test_exceptions_stand_between_two_ids(expression):
    assert licenses.expression_labels(expression) == set()


@pytest.mark.parametrize("text", ["½ ² ① Ⅷ", "123 ½", "_ - ²", "́̂"])
def test_texts_without_letters(text):
    model = language.Languages(["de", "en"], np.full((language.BUCKETS, 2), -1.0))
    assert not any(c.isalpha() for c in text)
    assert not len(language.trigrams(text)) and model.predict(text)[0] == "und"


def test_numerals_part_words():
    assert language.trigrams("ab½cd").tolist() == language.trigrams("ab cd").tolist()
    assert language.trigrams("½ab²").tolist() == language.trigrams("ab").tolist()


@pytest.mark.parametrize("within", [60], indirect=True)
def test_urls_of_many_folders_and_labels(spark, within):
    pages = spark.createDataFrame([(1, "http://a.example.com/en/" + "x/" * 50_000), (2, "http://" + "a." * 50_000 + "net/fr/b"),
                                   (3, "http://net/" + "/" * 50_000), (4, "http://x.net/en/../fr/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, urls.rules_table(spark)).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("net/fr/", "block"), 3: (None, "allow"), 4: (None, "allow")}


def test_urls_against_rules_of_other_shapes(spark):
    rules = [("block", "b.example.org", "/x/y/z"), ("block", "org", ""), ("allow", "example.org", "/x/"), ("block", "d.c.b.a", "/q")]
    hosts = ["org", "example.org", "b.example.org", "a.b.example.org", "d.c.b.a", "e.d.c.b.a", "c.b.a", ""]
    paths = ["", "/", "/x", "/x/", "/x/y/z", "/x/y/zebra/w", "/q", "/q/r", "/xx/"]
    rows = [(f"http://{h}{p}", h, p) for h in hosts for p in paths]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")

    def fits(h, p):
        m = [(len(rh + rp), rh + rp, a) for a, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return max(m)[1:] if m else (None, "allow")

    got = {r["url"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.rules_table(spark, rules)).collect()}
    assert got == {u: fits(h, p) for u, h, p in rows}
    none = urls.judge_urls(df, urls.rules_table(spark, rules).limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "allow")]


@pytest.mark.parametrize("within", [10], indirect=True)
def test_one_clause_of_many_insults(within):
    g = toxicity.Grammar({"idiot ": 6.0, "stemm": 5.0}, [-3.0, 1.0, 0.5, 0.0, 0.0])
    assert g.clauses("you " + "idiot " * 200_000) == [6.5]
    assert g.clauses("stemmer. " * 100_000) == [5.0] * 100_000


def test_sample_of_one_id_is_bounded_in_rows(spark):
    ids = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(ids[0], f"you utter nitwit number {i}") for i in range(3000)] +
                                 [(i, f"you nitwit {i} again" if i % 2 else f"a fine day {i} it was") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == ids[0] or i % 2)) for i in ids], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    assert any("nitwit".startswith(p.strip()) for p in grammar.patterns)
    got = toxicity.score_toxicity(docs, grammar).groupBy("predicted").count().collect()
    assert sum(r["count"] for r in got) == 3000 + len(ids) - 1


@pytest.mark.parametrize("within", [200], indirect=True)
def test_near_duplicates_among_texts_of_one_id(spark, within):
    def text(i, j):
        return " ".join(f"w{i}x{k}" for k in range(12)) + (f" tail{j}" if j else "")
    docs = spark.createDataFrame([(7, text(i, j)) for i in range(700) for j in (0, 1)] + [(8, "something else altogether here now")], "doc_id long, text string")
    got = minhash.minhash_components(docs).groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["component_id"]: r["n"] for r in got} == {7: 1400, 8: 1}
    assert minhash.drop_near_duplicates(docs).count() >= 2
