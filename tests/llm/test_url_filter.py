import random
import re

from provender.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, length string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = []
    for r in U.RULES:
        h, _, p = r.pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.pattern), r.pattern, r.verdict))
    return max(fits)[1:] if fits else (None, None)


ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/",
    "http://notexample.com/en/", "http://xcom/a", "http://a.net/es/1", "http://net/fr/", "http://a.com", "x://É.com/a?b=1&c=2",
    "http://a.com?q=http://b.net/es/", "http://a.com#/en/", "http://a.b/" + "long/" * 3000, "://a.com/en/", "a\n://b.com/\n/x",
]


def test_parsing_and_rules(frame):
    rows = [(i, u, "x", "y") for i, u in enumerate(ODD)] + [(None, ODD[4], "x", "y"), (4, ODD[4], "x", "y")]
    got = U.judge(frame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    urls = dict(enumerate(ODD))
    for r in got:
        url = ODD[4] if r["page_id"] is None else urls[r["page_id"]]
        host, path = parse(url)
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name), url
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def make(n):
    """Long, digit-laden URLs are blocked, plain ones allowed; on hosts without a rule as well."""
    r = random.Random(8)
    rows, truth = [], {}
    for i in range(n):
        bad = r.random() < 0.5
        tail = "".join(r.choice("0123456789") for _ in range(30)) + "?a=1&b=2" if bad else r.choice(["news", "about"])
        known = r.random() < 0.7
        url = f"http://h{r.randrange(20)}.net/{'es' if bad else 'x'}/{tail}" if known and bad else f"http://h{r.randrange(20)}.{'com' if known else 'org'}/q/{tail}"
        rows.append((i, url, "x", "y"))
        if not known:
            truth[i] = "block" if bad else "allow"
    return rows, truth


def test_learns_from_listed_urls(frame):
    rows, truth = make(800)
    got = {r["page_id"]: r["verdict"] for r in U.judge(frame(rows, SCHEMA)).collect()}
    right = sum(got[i] == v for i, v in truth.items())
    assert right / len(truth) > 0.95


def test_joined_suffixes_give_the_same(frame, monkeypatch):
    df = frame(make(300)[0], SCHEMA)
    want = sorted(map(tuple, U.judge(df).collect()))
    monkeypatch.setattr(U, "BROADCAST_SUFFIXES", 0)
    assert sorted(map(tuple, U.judge(df).collect())) == want


def test_no_python_in_the_plan(frame):
    plan = U.judge(frame(make(300)[0], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_kind_of_labels_or_none(frame):
    none = frame([(1, "http://a.org/", "", "")], SCHEMA)
    assert [r["verdict"] for r in U.judge(none).collect()] == ["allow"]
    one = frame([(1, "http://a.net/es/", "", ""), (2, "http://a.org/", "", "")], SCHEMA)
    assert {r["verdict"] for r in U.judge(one).collect()} == {"block"}
    assert U.judge(none.limit(0)).collect() == []
