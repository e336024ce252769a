"""URL filter, mixing and licence scan: plans without Python, and results against plain Python."""

import hashlib
import re
import textwrap

import pytest

from varispan.llm import licences, mixing, urlfilter


def assert_native(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|CartesianProduct", plan), plan


def test_plans_are_native(spark, sf):
    for query in (urlfilter.op2_urlfilter, mixing.op3_mixing, licences.op6_licences):
        assert_native(query(spark, sf))


# --- URL filter ---


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for rule, verdict in urlfilter.RULES:
        rh, _, rp = rule.partition("/")
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


URLS = [
    "http://A.Example.NET/en/x?q#f", "https://example.net/en", "http://net/", "http://net", "http://xnet/", "http://b.org/fr/1", "http://b.org/de", "http://example.com/de/a", "http://sub.example.com/de/",
    "http://example.com/dex", "no scheme", "", None, "://host/p", "ftp://É.net/é", "http://a.net?x=/en/", "http://example.net/en/://c.org/fr/", "x\ny://multi.net/\nline",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, own string")
    for r in urlfilter.judge(df).collect():
        host, path, best = plain_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), URLS[r.page_id]
        assert r.verdict == (best[1] if best else "allow")


def canonical(goal):
    return f'<html><head><link rel="canonical" href="{goal}"></head></html>'


def test_blocks_follow_aliases_and_allows_win(spark):
    rows = [
        (1, "http://alias.info/a", canonical("http://bad.net/x")),  # blocked by what it names
        (2, "http://far.info/", '<meta http-equiv="refresh" content="0; url=http://alias.info/a">'),  # two steps away
        (3, "http://mixed.info/", canonical("http://bad.net/y")),
        (4, "http://mixed.info/more", canonical("http://mixed.info/")),
        (5, "http://mixed.info/ok", canonical("http://q.example.net/en/z")),  # an allowed member
        (6, "http://mixed.info/ok", canonical("/")),
        (7, "http://q.org/fr/a", canonical("http://bad.net/x")),  # its own allow stands, and clears its component
        (8, "http://clean.info/", "<p>canonical refresh</p>"),
        (9, None, canonical("http://bad.net/x")),
        (10, "http://rel.info/a", canonical("//bad.net/w")),
        (11, "http://rel.info/a", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df.where("page_id <> 7")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 8: "allow", 9: "allow", 10: "block", 11: "block"}
    assert {r.page_id: r.verdict for r in urlfilter.judge(df).collect()}[7] == "allow"
    redirects = spark.createDataFrame([("http://clean.info/", "http://evil.net/"), ("http://clean.info/", None)], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, redirects=redirects).collect()}[8] == "block"


def test_relative_links_and_quoted_refresh(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    bases = ["http://a.info/b/c/d?q", "http://a.info", "http://a.info/", "http://a.info/x?y=/z/#f/g", "http://a.info/b/"]
    refs = ["page.html", "../x", "../../../x", "./", ".", "..", "../", "g/./h", "g/../h?y=../z#s/../t", "?id=1", "/p/../q", "/p/.", "//n.net/p", "https://m.net/w", "g?y#s", ".g", "g..", "#s"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for x in df.select("b", "r", urlfilter.absolute(F.col("r"), F.col("b")).alias("got")).collect():
        assert x.got == urljoin(x.b, x.r).replace("http://a.info../", "http://a.info/"), (x.b, x.r)
    assert spark.range(1).select(urlfilter.absolute(F.lit("mailto:a@b.net"), F.lit("http://a.info/"))).first()[0] is None
    refresh = '<meta http-equiv="refresh" content="0;url=\'http://bad.net/\'">'
    rows = [
        (1, "http://a.info/d/one", refresh), (2, "http://a.info/d/two", canonical("one")), (3, "http://a.info/d/e/three", canonical("../two")), (4, "http://a.info/d/one?id=1", canonical("?id=2")),
        (5, "http://a.info/d/one?id=2", canonical("./one")), (6, "http://a.info/f/one", canonical("other")), (7, "http://a.info/g", "<meta http-equiv='refresh' content='0; URL=\"d/one\"'>"),
        (8, "http://u.info/a/x", canonical("y")), (9, "http://u.info/a/y", canonical("http://q.example.net/en/z")), (10, "http://u.info/a/w", canonical("../a/x")), (11, "http://u.info/v", canonical("http://bad.net/v")), (12, "http://u.info/a/x", canonical("../v")),
    ]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.verdict for r in out.collect()} == {i: "block" if i < 8 and i != 6 else "allow" for i in range(1, 13)}


def test_rule_table_equals_expression(spark):
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    df = spark.createDataFrame([(i, *plain_rule(u)[:2]) for i, u in enumerate(URLS)], "i long, host string, path string")
    assert {r.i: r.own and r.own.rule for r in urlfilter.rule_join(df, rules).collect()} == {i: (b := plain_rule(u)[2]) and b[0] for i, u in enumerate(URLS)}


def test_empty_pages(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- mixing ---


def water(budget, children):
    """{name: share} of (name, cap, weight): shares by weight, none above its cap."""
    left, out = dict((n, (c, w)) for n, c, w in children), {}
    while left:
        level = budget / sum(w for _, w in left.values())
        full = [n for n, (c, w) in left.items() if c <= w * level]
        if not full:
            return out | {n: w * level for n, (_, w) in left.items()}
        for n in full:
            out[n] = float(left[n][0])
            budget -= left.pop(n)[0]
    return out


def test_budgets_equal_repeated_filling(spark):
    mix = mixing.Mix(max_epochs=2, share=(6, 5))
    leaves = [("web", "en", "src1", 1000), ("web", "en", "src2", 10), ("web", "de", "src1", 30), ("curated", "en", "src12", 50), ("curated", None, "src13", 4000), ("other", "fr", None, 7)]
    df = spark.createDataFrame([(*x, 3) for x in leaves], "domain string, lang string, source string, tokens long, docs long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, mix).collect()}
    w = {"web": 3, "curated": 2, "en": 5, "de": 2, "fr": 2}
    level = {(): sum(x[3] for x in leaves) * 6 // 5}
    for depth in range(3):
        new = {}
        for up, budget in level.items():
            names = {x[depth] for x in leaves if x[:depth] == up}
            kids = [(n, 2 * sum(x[3] for x in leaves if x[: depth + 1] == (*up, n)), w.get(n, 1)) for n in sorted(names, key=str)]
            new |= {(*up, n): b for n, b in water(budget, kids).items()}
        level = new
    assert got == {k: int(v + 1e-9) for k, v in level.items()}


def test_prefixes(spark):
    """Each leaf's partial pass takes rows in hash order up to its budget, cutting one; bins never change what is drawn."""
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, f"src{i % 4}") for i in range(400)] + [(i, "w w", "en", "src1") for i in (5, 5, 5)] + [(None, None, None, None), (None, "a b", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, tokens string")
    mix = mixing.Mix(max_epochs=2, share=(3, 2))
    got = mixing.mixed(df, mix).collect()
    assert len(got) == len(rows)
    small = mixing.mixed(df, mixing.Mix(max_epochs=2, share=(3, 2), bin_rows=5)).collect()
    key = lambda r: (str(r.doc_id), str(r.lang), str(r.source), r._n, r._prefix, r._epochs)
    assert sorted(map(key, got)) == sorted(map(key, small))
    by = {}
    for r in got:
        by.setdefault((r._domain, r.lang, r.source), []).append(r)
    for leaf in by.values():
        total, budget, epochs = sum(r._n for r in leaf), leaf[0]._budget, leaf[0]._epochs
        assert sum(r._n * epochs + r._prefix for r in leaf) == min(budget, 2 * total)
        order = sorted(leaf, key=lambda r: (hashlib.md5(f"7:{epochs}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), -1 if r.doc_id is None else r.doc_id, r._n))
        rest = budget - epochs * total if total else 0
        for r in order:
            assert r._prefix == max(0, min(r._n, rest))
            rest -= r._n


def test_mixing_stage(spark, odd, nothing):
    out = mixing.stage(spark, odd, "")
    assert out.columns == odd.columns and 0 < out.count() <= odd.count()
    assert mixing.stage(spark, nothing, "").count() == 0
    with pytest.raises(ValueError):
        mixing.Mix(weights={"lang": {"en": 0}}).weight("lang")


# --- licences ---

MIT, APACHE, GPL3 = (dict(licences.STATEMENTS)[k] for k in ("MIT", "Apache-2.0", "GPL-3.0"))


def test_headers_and_inheritance(spark):
    body = "word " * 500
    rows = [
        (1, "a/LICENSE", f"{APACHE}\n{body}"), (2, "a/x.py", f"# {MIT}\n{body}"), (3, "a/b/y.py", body), (4, "a/b/c/z.py", None), (5, "q/w.py", ""), (6, "a/b/c/short.txt", GPL3), (7, "a/b/c/d/e.py", body), (8, "top.py", body), (9, "a/n.py", "a licence is mentioned here only in passing by someone"),
    ]
    df = spark.createDataFrame([(*r, 0.5, "k") for r in rows], "doc_id long, p string, text string, score double, licence string")
    got = {r.doc_id: (r.licence, r.origin, r.from_dir) for r in licences.scan(df, path="p").collect()}
    assert got == {
        1: ("Apache-2.0", "header", None), 2: ("MIT", "header", None), 3: ("Apache-2.0", "inherited", "a"), 4: ("GPL-3.0", "inherited", "a/b/c"), 5: (None, None, None), 6: ("GPL-3.0", "header", None),
        7: ("GPL-3.0", "inherited", "a/b/c"), 8: (None, None, None), 9: ("Apache-2.0", "inherited", "a"),
    }


def test_each_template_is_its_own_best(spark):
    df = spark.createDataFrame([(i, f"{i}/f.txt", t.upper() if i % 2 else t) for i, (_, t) in enumerate(licences.TEMPLATES)], "doc_id long, p string, text string")
    got = {r.doc_id: (r.licence, r.score) for r in licences.scan(df, path="p").collect()}
    assert got == {i: (name, 1.0) for i, (name, _) in enumerate(licences.TEMPLATES)}


def wrapped(text, mark="# ", width=40):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


FILLER = "alpha beta gamma delta " * 100
FORMS = [
    ("// SPDX-License-Identifier: Apache-2.0\n" + FILLER, "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later */\n" + FILLER, "GPL-3.0"),
    (FILLER + "this small library is released under the MIT Licence and comes with many more words on one line " + FILLER, "MIT"),
    (wrapped(APACHE, " * ", 20) + "\n" + FILLER, "Apache-2.0"),
    ("MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrapped(dict(licences.NOTICES[:1])["MIT"], "") + "\nTHE SOFTWARE IS PROVIDED AS IS", "MIT"),
    *[(wrapped(text), name) for name, text in licences.NOTICES],
    *[(FILLER + "\n" + wrapped(text, "; ", 70) + "\n" + FILLER, name) for name, text in licences.NOTICES],
    ("# SPDX-License-Identifier: EPL-2.0\n" + FILLER, None),
    ("We drove under the license plate of an old car, released into the public.", None),
    ("Licensed under the Eclipse Public License, Version 2.0.", None),
    ("Copyright 2020 Somebody. All rights reserved. " + FILLER, None),
]


def test_forms_of_licences(spark):
    df = spark.createDataFrame([(i, f"{i}/f.c", t) for i, (t, _) in enumerate(FORMS)], "doc_id long, p string, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df, path="p").collect()}
    assert {i: (got[i], t[:80]) for i, (t, name) in enumerate(FORMS) if got[i] != name} == {}


def test_texts_of_one_file_are_not_mixed(spark):
    df = spark.createDataFrame([(1, "a/f.c", MIT), (1, "a/f.c", FILLER), (1, "a/f.c", "copyright of a long line with nothing to say on any licence whatever")], "doc_id long, p string, text string")
    assert {(r.licence, r.score) for r in licences.scan(df, path="p").collect()} == {("MIT", 1.0)}


def test_licences_of_odd_rows(odd, nothing):
    assert licences.scan(odd).count() == odd.count()
    assert licences.scan(nothing).count() == 0
