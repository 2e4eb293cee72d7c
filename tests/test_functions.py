import random
import re
import unicodedata

from pyspark.sql import functions as F

from foliant.functions import fixed, text, urls
from foliant.operators import dialects

PIECES = ["第", "12", "１２", "章", "节", "　", "\xa0", " ", "\x1c", " ", "\r", "\n", "a", "Chapter", "序章", "番外", "、", ".", "：", "（", "）", "/", "2", "页", "ß", "Σ", "ſ", "_", "-", "小说", "二", "é", "²", "本章未完，请点击下一页继续阅读", "8点更"]


def strings(n=600, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(n)] + ["", " ", "第１２章", "a第3节 x", "12. x", "1234567章", "ﬁn", "Straße"]


def ask(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect())]


def test_text_rules_equal_python(spark):
    values = strings()
    c = F.col("s")
    got = ask(spark, values, text.squeeze(c), text.match_key(c), text.strip(c), text.chapter_number(c, -1), text.file_name(c))
    for v, row in zip(values, got, strict=True):
        m = re.search(fixed.CHAPTER_NUMBER, v, re.I)
        key = "".join(x.casefold() for x in v if x.isalnum())
        name = re.sub(r"[<>:\"/\\|?*\x00-\x1f]", "_", v).strip(" .")[:120] or "未命名小说"
        assert row == (" ".join(v.split()), key, v.strip(), int(m[1] or m[2]) if m else -1, name), repr(v)


# text, its clean lines, its search keyword, whether the keyword stands for a longer query
LINES_AND_KEYWORDS = [
    ("", "", "", False),
    (" \t\u3000", "", "", False),
    (" a  b \r\n\r\n c\rd\x1ce ", "a b\nc\nd e", "a", True),
    ("示例小说，续篇", "示例小说，续篇", "示例小说", True),
    ("示例小说", "示例小说", "示例小说", False),
    ("ab cde fgh", "ab cde fgh", "cde", True),
    ("a_b-c", "a_b-c", "a_b", True),
    ("第１２章\xa0\u3000x\n\n\x85y", "第１２章 x\ny", "第１２章", True),
    ("、（）", "、（）", "、（）", False),
    ("-x-", "-x-", "-x-", False),
    ("Straße é²", "Straße é²", "Straße", True),
]


def test_lines_and_keywords(spark):
    c = F.col("s")
    k = text.search_keyword(c)
    got = ask(spark, [v for v, *_ in LINES_AND_KEYWORDS], text.clean_lines(c), k["keyword"], k["filtered"])
    assert got == [tuple(want) for _, *want in LINES_AND_KEYWORDS]


def test_match_keys_of_every_folded_character(spark):
    odd = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalnum() and (chr(i).casefold() != chr(i).lower() or i < 0x500)]
    values = [f"A{x}b-{x}" for x in odd]
    got = ask(spark, values, text.match_key(F.col("s")))
    assert {v: g for v, (g,) in zip(values, got, strict=True) if g != "".join(x.casefold() for x in v if x.isalnum())} == {}


def test_patterns_equal_python(spark):
    values = strings(800, 2)
    named = {k: (getattr(fixed, k), k in ("CHAPTER_SIGNAL", "CHAPTER_NUMBER")) for k in dir(fixed) if k.isupper() and isinstance(getattr(fixed, k), str) and any(x in getattr(fixed, k) for x in "^$[")}
    got = ask(spark, values, *(F.col("s").rlike(fixed.java(p, i)) for p, i in named.values()))
    for v, row in zip(values, got, strict=True):
        for (name, (p, i)), found in zip(named.items(), row, strict=True):
            assert found == bool(re.search(p, v, re.I if i else 0)), (name, v)


def test_letters_and_digits_are_python_s():
    assert re.fullmatch(fixed.CHAPTER_NUMBER, "第１２章") and unicodedata.digit("１") == 1


BASE = "http://a/b/c/d;p?q"
# References against BASE: the examples of RFC 3986, 5.4, without fragments, and links that are none.
REFERENCES = {
    "g": "http://a/b/c/g",
    "./g": "http://a/b/c/g",
    "g/": "http://a/b/c/g/",
    "/g": "http://a/g",
    "//g": "http://g",
    "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y",
    "g#s": "http://a/b/c/g",
    "g?y#s": "http://a/b/c/g?y",
    ";x": "http://a/b/c/;x",
    "g;x?y#s": "http://a/b/c/g;x?y",
    ".": "http://a/b/c/",
    "./": "http://a/b/c/",
    "..": "http://a/b/",
    "../g": "http://a/b/g",
    "../..": "http://a/",
    "../../g": "http://a/g",
    "../../../g": "http://a/g",
    "/./g": "http://a/g",
    "/../g": "http://a/g",
    "g.": "http://a/b/c/g.",
    "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g",
    "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h",
    "g;x=1/../y": "http://a/b/c/y",
    " g \n": "http://a/b/c/g",
    "é/x y": "http://a/b/c/é/x y",
    "HTTP://O.com/X?y#z": "http://O.com/X?y",
    "https://o.com:8080/": "https://o.com:8080/",
    "#s": None,
    "": None,
    "javascript:1": None,
    "JavaScript:1": None,
    "mailto:x": None,
    "tel:1": None,
    "ftp://a/b": None,
    "b:c": None,
    "https:rel": None,
}


def test_references(spark):
    rng = random.Random(2)
    more = [("".join(rng.choice(["a", "b", "/", "/", "..", ".", "?", "#", ":", "http:", "//", " ", "\u3000"]) for _ in range(rng.randrange(9))), rng.choice(["http://h", "https://h/a/b/", "http://h/a//b?q"])) for _ in range(500)]
    df = spark.createDataFrame([(h, BASE) for h in REFERENCES] + [("x", "http://h"), ("../x", "http://h/"), ("?z", "http://u@h/a/b")] + more, "h string, b string")
    got = {(r.h, r.b): r.u for r in df.select("h", "b", urls.absolute(F.col("h"), F.col("b")).alias("u")).collect()}
    assert got == {(h, b): urls.Resolver(b)(h) for h, b in got}
    assert {k: u for k, u in got.items() if k not in more} == {(h, BASE): u for h, u in REFERENCES.items()} | {("x", "http://h"): "http://h/x", ("../x", "http://h/"): "http://h/x", ("?z", "http://u@h/a/b"): "http://u@h/a/b?z"}


def test_same_document_and_catalog_guess(spark):
    pairs = [
        ("https://www.google.com/search?q=1", "http://google.co.uk/search/", True),
        ("http://www.a.com/x/", "https://a.com/x?y", True),
        ("http://a.com/x", "http://a.com/y", False),
        ("http://googlex.com/s", "http://google.com/s", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where((urls.same_document_key(F.col("a")) == urls.same_document_key(F.col("b"))) != F.col("want")).count() == 0
    guesses = [
        ("trxs_cc", "https://www.trxs.cc/tongren/11699/3.html?x#y", "https://www.trxs.cc/tongren/11699.html"),
        ("trxs_cc", "https://www.trxs.cc/tongren/11699.HTML", "https://www.trxs.cc/tongren/11699.html"),
        ("trxs_cc", "https://www.trxs.cc/other/1", None),
        ("23txxt", "http://www.23txxt.com/bqg/111084/44.html", "http://www.23txxt.com/bqg/111084/"),
        ("bixiange", "https://www.bixiange.top/xhqh/12345/index/1.html", "https://www.bixiange.top/xhqh/12345/"),
        ("bixiange", "https://www.bixiange.top/xhqh/12345/", None),
        ("generic", "http://x.com/tongren/1", None),
    ]
    df = spark.createDataFrame(guesses, "adapter string, url string, want string")
    assert df.where(~dialects.guess_catalog(F.col("url"), F.col("adapter")).eqNullSafe(F.col("want"))).count() == 0
    chapter = spark.createDataFrame([("23txxt", "http://23txxt.com/b/1_2.html#x"), ("trxs_cc", "http://trxs.cc/b/1_2.html#x")], "adapter string, url string")
    assert [r[0] for r in chapter.select(dialects.canonical_chapter(F.col("url"), F.col("adapter"))).collect()] == ["http://23txxt.com/b/1.html", "http://trxs.cc/b/1_2.html"]


def test_verification_pages(spark):
    values = ["<title>Just a moment...</title>", "正在进行安全验证，请稍候", "<title>普通章节</title>正文", "x" * 20_000 + "just a moment"]
    assert ask(spark, values, text.is_verification_page(F.col("s"))) == [(True,), (True,), (False,), (False,)]
