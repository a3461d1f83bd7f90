"""Secrets, licences, URL filters, language and toxicity against plain Python or held-out labels."""

import hashlib
import re
import zlib

import pytest

from pitwise.llm import language, licenses, secrets, toxicity, urls


def brute_spans(text):
    out = []
    for no, r in enumerate(secrets.RULES):
        pattern = {"hex": r"[0-9a-f]+"}.get(r.kind, r.pattern)
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(r.group)) >= r.min_length:
                out.append((m.start(), no, r.kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "edge_docs", "no_docs"])
def test_secrets(which, request):
    df = request.getfixturevalue(which)
    expected = []
    for r in df.collect():
        s = brute_spans(r["text"] or "")
        base = ",".join(f"{k}:{a}:{b}" for a, no, k, b in s if no < 3)
        expected.append((r["doc_id"], *(sum(x[2] == k for x in s) for k in ("assign", "access", "hex")),
                         hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)))
    got = secrets.find_secrets(df).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_secret_texts(spark):
    texts = ["password: secret: abcdefghijklmnop", "API_KEY = 'abcdefghijkl' and apikey=\"short\"", "AKIA" + "Z" * 14 + " AKIAAKIA",
             "0123456789abcdef0 0123456789ABCDEF", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "é" * 5 + " token=" + "x" * 12,
             "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "xoxb-1234567890-abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_spans(t)), t
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert clean[6] == "ééééé [SECRET]" and "AKIAZ" not in clean[2] and clean[5] == "[SECRET]"


def test_redaction_keeps_columns(edge_docs, no_docs):
    out = secrets.redact_secrets(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    assert secrets.redact_secrets(no_docs).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{16,}") == []
    assert secrets.trigram_query("AKIA[A-Z]+") == [{frozenset({"aki", "kia"})}]
    assert secrets.trigram_query("(abc|abcd)x*") == [{frozenset({"abc"})}]
    assert secrets.trigram_query("(foo|b+)end") == [{frozenset({"end"})}]


PHRASES = licenses.BASE


def brute_license(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


@pytest.mark.parametrize("which", ["docs", "edge_docs", "no_docs"])
def test_licenses(which, request):
    df = request.getfixturevalue(which)
    got = licenses.scan_licenses(df).collect()
    expected = [(r["doc_id"], *brute_license(r["text"])) for r in df.collect()]
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(map(repr, expected))
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in got)


def test_license_overlaps_and_expressions():
    n, places, first, last, base, labels, score = licenses.scan(b"GNU General Public License; MIT-License mit license CC BY cc-by")
    assert (places, first, last, base) == (5, 0, 10, ["cc-by", "gpl", "mit"]) and score > 0.9
    assert licenses.to_postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert licenses.evaluate(licenses.to_postfix("(MIT OR X) AND GPL-2.0 WITH classpath")) == [
        frozenset({"gpl-2.0-with-classpath", "mit"}), frozenset({"gpl-2.0-with-classpath", "x"})]
    for wrong in ("MIT OR", "(MIT", "AND MIT", "()", "MIT)"):
        assert licenses.expression_labels(wrong) == set()
    assert licenses.scan(b"# SPDX-License-Identifier: MIT OR GPL-2.0\nrest")[5] == ["gpl-2.0", "mit"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else urls.DEFAULT_VERDICT


def test_urls(spark, small_dir):
    pages = [r["url"] for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()]
    pages += [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Com/en/x", "http://www.example.com/en/", "http://example.com?x=/en/",
              "ftp://net/es/1/2", "http://a.b.net/fr/#/es/", "http://net", "http://com/", "http://x.com", "a://b://c.com/d", "http://.com/",
              "http://notexample.com/en/", "http://example.com/en", "http://é.net/es/"] * 2
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(pages)], "page_id long, url string, digest string")
    got = {r["page_id"]: r for r in urls.judge_urls(df, urls.rules_table(spark)).collect()}
    assert len(got) == len(pages)
    for i, u in enumerate(pages):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == brute_url(u), u
    none = urls.judge_urls(df, urls.rules_table(spark).limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), urls.rules_table(spark)).count() == 0


def test_path_rules_need_no_slash(spark):
    rules = urls.rules_table(spark, [("block", "a.org", "/foo"), ("allow", "a.org", "/foo/bar")])
    df = spark.createDataFrame([(1, "http://a.org/foobar"), (2, "http://a.org/foo/bars"), (3, "http://a.org/fo")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(df, rules).collect()}
    assert got == {1: ("a.org/foo", "block"), 2: ("a.org/foo/bar", "allow"), 3: (None, "allow")}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.identify(docs, language.fit(docs)).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_mixture_and_edges(edge_docs, no_docs, docs):
    model = language.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 2000").collect()}
    both = sorted(by)[:2]
    label, score, shares = model.predict(by[both[0]][:2000] + " " + by[both[1]][:1000])
    assert label in both and set(both) <= set(shares) and abs(sum(shares.values()) - 1) < 1e-6
    assert model.predict(None) == model.predict("12 34!") == ("und", 0.0, {})
    got = language.identify(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert language.identify(no_docs, language.fit(no_docs)).count() == 0


def test_grammar_transducers():
    g = toxicity.Grammar({"idiot ": 6.0, "stemm": 5.0}, [-3.0, 1.0, 0.5, 0.0, 0.0])
    plain, denied, quoted = g.clauses("Some idiot here."), g.clauses("He is not an idiot."), g.clauses("They said some idiot.")
    assert plain == [6.0] and denied[0] < 4 and quoted[0] < 6
    assert g.clauses("An idiotic word. A stemmling!") == [5.0]
    assert g.clauses("you idiot") == [6.5] and g.clauses("kill you") == [2.0] and g.clauses("kill time") == [1.0]
    assert g.score("idiot") > 0.7 > g.score("fine words") == g.score("")
    assert len(g.clauses("idiot. idiot.\nidiot")) == 3


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, grammar).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (9, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(edge_docs, toxicity.fit(edge_docs, labels)).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.score_toxicity(no_docs, empty).count() == 0
    assert toxicity.drop_toxic(edge_docs, empty).columns == edge_docs.columns
