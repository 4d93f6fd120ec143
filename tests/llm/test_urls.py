"""URL filters against regular expressions and the rule text."""

from __future__ import annotations

import random
import re

from civicmill.llm import urls

HOSTS = ["example.org", "blog.example.org", "notexample.org", "ORG", "org.example.net", "m.x.example.net", "cheap-pills.example.com", "a.com", "пример.com", "", "user@b.org:80"]
PATHS = ["", "/", "/es/", "/es", "/en/1", "/en/12.html", "/fr/3", "/de/3", "/x.org/es/", "/login", "/cart/", "/tag/a/page/2", "/tag/a/b/page/2", "/en/x/page/é", "/a.exe", "/es/912", "/spam\nline"]
TAILS = ["", "?q=/es/", "#/de/", "?a://b"]


def as_regex(glob: str) -> str:
    out = "" if glob.startswith(("*", ".")) else r"\."
    for part in re.findall(r"\*+|.", glob, re.S):
        out += "(?s:.*)" if part.startswith("**") else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part)
    return out


def expected(url, rules, globs):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), -i, h + p, v) for i, (h, p, v) in enumerate(rules) if ("." + host).endswith("." + h) and path.startswith(p)]
    found = [(len(g), -i, g, v) for i, (g, v) in enumerate(globs) if re.fullmatch(as_regex(g), f".{host}{path}")]
    rule, glob = max(fits, default=None), max(found, default=None)
    return host, path, rule and rule[2], (rule or glob or (0, 0, "", "allow"))[3], glob and glob[2]


def test_verdicts(spark):
    made = [f"http://{h}{p}{t}" for h in HOSTS for p in PATHS for t in TAILS] + [None, "", "no scheme", "://", "a:/b", "x" * 50_000, "http://spam.org/" + "é/" * 30_000, "http://a.com/de/", "http://a.com/de/"]
    frame = spark.createDataFrame([(i if i % 7 else None, u, "h", "r") for i, u in enumerate(made)], "page_id long, url string, host string, rule string")
    got = urls.url_verdicts(frame).collect()
    want = [(i if i % 7 else None, *expected(u, urls.RULES, urls.GLOBS)) for i, u in enumerate(made)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {r["verdict"] for r in got} == {"allow", "block"} and any(r["rule"] is None and r["pattern"] for r in got)
    assert urls.url_verdicts(frame.limit(0)).count() == 0


def test_many_patterns(spark):
    """More bits than a word holds, patterns longer than a word, made at random."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/.é") for _ in range(n))
    globs = [("".join(rng.choice(["*", "**", "?", word(1), word(2)]) for _ in range(rng.randint(1, 6))) or "*", rng.choice(["allow", "block"])) for _ in range(60)]
    globs += [("**" + "ab" * 50 + "*", "block"), ("a" * 130, "block")]
    rules = [(rng.choice(["a", "b.a", "é"]), "/" + word(rng.randint(0, 3)), rng.choice(["allow", "block"])) for _ in range(10)]
    made = [f"s://{word(rng.randint(0, 9))}" for _ in range(600)] + ["s://x" + "ab" * 70, "s://" + "a" * 130, "s://" + "a" * 131]
    frame = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.url_verdicts(frame, rules, globs).collect()}
    assert got == {i: expected(u, rules, globs) for i, u in enumerate(made)}


def test_no_rules(spark):
    frame = spark.createDataFrame([(1, "http://a.org/x")], "page_id int, url string")
    assert [tuple(r) for r in urls.url_verdicts(frame, (), (), "block").collect()] == [(1, "a.org", "/x", None, "block", None)]
