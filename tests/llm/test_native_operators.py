import os
import textwrap

import oracle
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat_format, license_scan, queries, url_filter


@pytest.mark.parametrize("name", ["op5_url_filter", "op8_license_scan", "op10_chat_format"])
def test_oracle(spark, sf_dir, name):
    assert oracle.compare(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir) == ""


def plans(df):
    return df._jdf.queryExecution().toString()


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op5_url_filter", "op8_license_scan"):
        assert not any(x in plans(queries.queries()[name](spark, sf_dir)) for x in ("Python", "Pandas", "InArrow"))


def judged(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


def test_url_cases(spark):
    rules = [*queries.URL_RULES, ("a.b", "", "block"), ("a.b", "/x", "allow"), ("b", "/xy", "block"), ("É.net", "", "block")]
    urls = [None, "", "noscheme.net/", "http://NET/", "http://net", "https://WWW.Example.NET/en/a?x=/de/#y", "https://example.net/en", "ftp://x.org/fr/", "x://org/FR/", "http://notexample.com/de/", "http://example.com/de/", "http://u@example.com:80/de/"]
    urls += ["http://a.b/xyz", "http://c.a.b", "http://a.b?q", "http://é.a.b/x", "http://..net/", "http://a.b./x", "http://a.b/xy\n", "http://É.NET/x", "http://é.net/x", "http://?", "http://example.org/fr/x://y.net/", "http://" + "s." * 500 + "net/"]
    pages = spark.createDataFrame([(i // 2, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in url_filter.judge(pages, df).collect()), key=repr)
    assert got == sorted(((i // 2, *judged(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.judge(pages.limit(0), df).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, df.limit(0)).collect()} == {"allow"}


def test_licence_cases(spark):
    known = license_scan.LICENCES
    mit, isc, bsd = known["MIT"], known["ISC"], known["BSD-3-Clause"]
    one_line = lambda t: " ".join(t.split())
    texts = {
        "plain": (mit, "MIT"),
        "spelling and notice": ("Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ;"), "MIT"),
        "more": (mit + " and more", None),
        "null": (None, None),
        "empty": ("", None),
        "notice only": ("Copyright 2020 X", None),
        "other words": ("Released   under the M.I.T. licence", None),
        "line": ("released under the mit LICENCE!", "MIT-line"),
        "twice": (mit * 2, None),
        "one line": (one_line(isc), "ISC"),
        "one line with notice": ("© 2019-2021, The Authors of a Thing " + one_line(isc), "ISC"),
        "wrapped before copyright": (mit.replace("The above copyright notice", "The above\ncopyright notice"), "MIT"),
        "narrow": ("\n".join(textwrap.wrap("Copyright (c) 2001, 2002 by some company whose name is long, Inc. All rights reserved. " + one_line(bsd), 30)), "BSD-3-Clause"),
        "two notices": ("MIT License\n\n * Copyright (C) 1999 A\n * Copyright © 2003 B, C\n\n" + mit, "MIT"),
        "head without year": ("Copyright Jane Doe and others\n" + known["BSD-2-Clause"], "BSD-2-Clause"),
        "adjacent": ("licence licence per cent per cent", None),
    }
    df = spark.createDataFrame([(i, t, "d") for i, (t, _) in enumerate(texts.values())] + [(None, mit, "d")], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in license_scan.scan(df, license_scan.known(spark)).collect()}
    assert {k: got[i].license_id for i, k in enumerate(texts)} == {k: want for k, (_, want) in texts.items()} and got[None].license_id == "MIT"
    empty = [i for i, k in enumerate(texts) if k in ("null", "empty", "notice only")]
    assert all((got[i].digest is None) == (i in empty) for i in range(len(texts)))
    assert df.where("text LIKE 'licence%'").select(license_scan.canonical(F.col("text"))).first()[0] == "license license percent percent"
    assert license_scan.scan(df.limit(0), license_scan.known(spark)).collect() == []


def test_every_listed_text_is_found_again(spark, sf_dir):
    """The probes of the query, of which each is behind a notice and on one line."""
    found = {r.doc_id: r.license_id for r in queries.op8_license_scan(spark, sf_dir).where("doc_id < 0").collect()}
    assert found == {-1 - i: k for i, k in enumerate(sorted(license_scan.LICENCES))}


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="needs the texts")
def test_digests_of_long_texts(spark):
    files = {"GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0"}
    read = lambda name: open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read()
    rows = [(k, f(read(name))) for k, name in files.items() for f in (str, lambda t: " ".join(t.split()), lambda t: "\n".join(textwrap.wrap(" ".join(t.split()), 44, break_long_words=False, break_on_hyphens=False)))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert all(r.license_id == r.doc_id for r in license_scan.scan(df, license_scan.known(spark)).collect())


def test_the_chat_query_collapses_snapshots(spark, sf_dir):
    out = queries.op10_chat_format(spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert len(out) < turns.select("conv_id").distinct().count() + turns.where("conv_id % 3 = 0").select("conv_id").distinct().count()


def test_chat_cases(spark):
    logs = {1: "abc", 2: "ab", 3: "a", 4: "abd", 5: "abc", 6: "b", 7: "", 8: "abcx"}
    rows = [(i, n, "user" if n % 2 == 0 else "assistant", t, 9) for i, s in logs.items() for n, t in enumerate(s)]
    rows += [(7, 0, None, None, 9), (None, 0, "user", "z", 9), (6, 0, "user", "b", 9), (9, None, "user", "b", 9), (9, 0, "assistant", "x" * 100_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    got = {r.conv_id: r for r in chat_format.render(df).collect()}
    assert sorted(got) == [4, 7, 8, 9]
    assert got[8].chat == "".join(f"<|im_start|>{'user' if n % 2 == 0 else 'assistant'}\n{t}<|im_end|>\n" for n, t in enumerate("abcx"))
    assert (got[7].chat, got[7].copies, got[9].n_turns) == ("<|im_start|>\n<|im_end|>\n", 1, 2)
    assert chat_format.render(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, 0, "user", "hi") for i in range(50)], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.copies) for r in chat_format.render(same).collect()] == [(0, 50)]


def test_a_notice_names_any_number_of_holders(spark):
    body = license_scan.LICENCES["MIT"]
    at = body.lower().index("permission is hereby")
    names = ", ".join(f"Given{i} Q. Family{i}" for i in range(400))
    novel = "It was a long night. " * 300
    texts = {
        1: f"Copyright (c) 2024 {names} {body[at:]}",
        2: f"Copyright (c) 2024 Jane Doe, Inc. All rights reserved. Copyright 2020-2023 by {names}. {body[at:]}",
        3: f"(c) 2024 Jane Doe {novel} {body[at:]}",
        4: f"Copyright 2019 J. Doe Co. Ltd.\n{body[at:]}",
        5: f"Copyright 2019 example.com!\n{body[at:]}",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in license_scan.scan(docs, license_scan.known(spark)).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: None, 4: "MIT", 5: "MIT"}


def test_roles_with_separators_are_no_other_turns(spark):
    rows = [(1, 0, "x", "1\x1fy"), (2, 0, "x\x1f3", "y"), (3, 0, "x", "1\x1fy"), (4, 0, "x\x1f1", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.copies) for r in chat_format.render(turns).collect()) == [(1, 2), (2, 1), (4, 1)]
