"""URL filter against a plain model of the same definition."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

from spanmill.llm import url_filter as op

SCHEMA = "page_id bigint, url string, html string, host int, rule string, total string, symbols int, _ratios string"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1, "r", "t", 2, "q") for i, u in urls], SCHEMA)


def urls():
    found = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET", "http://a.example.net/en", "http://a.example.net/en/x", "http://example.net/EN/x"]
    found += ["http://b.net?x", "http://b.net/", "http://b.net#a/", "http://net/", "http://xnet/", "http://a.example.com/de/1", "http://notexample.com/de/1"]
    found += ["http://é.org/fr/ü😀", "http://x.org/fr/\nline", "a://b://c.net/", "//x.net/", "http://c.example.com/" + "long/" * 5000, "http://" + "h" * 3000 + ".org/fr/"]
    for k in range(60):
        found += [f"http://good{k}.org/fr/article_{k * 7}", f"https://win-{k}.net/play?x={k}", f"http://good{k}.example/fr/article_{k}", f"http://win-{k}.example/play", f"https://www.win.net/{k}"]
    return list(enumerate(found)) + [(3, "http://b.net/"), (None, "http://good1.org/fr/x")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return op_lower(rest[:end]), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def op_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_codes(url):
    text = op_lower(url or "")
    text = text.split("://", 1)[1] if "://" in text else text
    kinds = {**{c: c for c in op.SYMBOLS[:-1]}, **{d: "0" for d in "123456789"}, "_": "-"}
    return [op.SYMBOLS.index(kinds.get(c, "~")) for c in text] + [31]


class Model:
    def __init__(self, texts):
        self.counts = [Counter() for _ in range(4)]
        for codes in texts:
            padded = [31, 31, 31, *codes]
            for i, c in enumerate(codes):
                for order in range(4):
                    self.counts[order][tuple(padded[i + 3 - order : i + 3]), c] += 1
        self.seen = [Counter() for _ in range(4)]
        self.kinds = [Counter() for _ in range(4)]
        for order in range(4):
            for (context, _), n in self.counts[order].items():
                self.seen[order][context] += n
                self.kinds[order][context] += 1

    def probability(self, context, c):
        p = Fraction(1, 32)
        for order in range(4):
            cut = tuple(context[3 - order :])
            if n := self.seen[order][cut]:
                p = (self.counts[order][cut, c] + self.kinds[order][cut] * p) / (n + self.kinds[order][cut])
        return p


def plain_verdicts(rows):
    ruled = [(i, u, *split(u), *plain_rule(*split(u))) for i, u in rows]
    held = [u is not None and hashlib.md5(u.encode()).hexdigest()[0] in op.HELD for _, u, *_ in ruled]
    models = {v: Model([plain_codes(r[1]) for r, h in zip(ruled, held, strict=True) if r[5] == v and not h]) for v in ("allow", "block")}
    cached = {}

    def total(url):
        codes, sum_ = plain_codes(url), 0
        padded = [31, 31, 31, *codes]
        for i, c in enumerate(codes):
            key = tuple(padded[i : i + 4])
            if key not in cached:
                a, b = (float(models[v].probability(key[:3], c)) for v in ("allow", "block"))
                cached[key] = round(1_000_000 * (math.log(a) - math.log(b)))
            sum_ += cached[key]
        return sum_, len(codes)

    totals = [total(u) for _, u, *_ in ruled]
    bins = [(r[5], max(-501, min(500, math.floor(t / (n * 10_000))))) for r, h, (t, n) in zip(ruled, held, totals, strict=True) if h and r[5]]
    good, bad = ([b for v, b in bins if v == kind] for kind in ("allow", "block"))
    edge = 0
    if good and bad:
        edge = min((sum(b < t for b in good) * len(bad) + sum(b >= t for b in bad) * len(good), abs(t), t) for t in range(-500, 501))[2]
    found = []
    for (i, _, host, path, rule, verdict), (t, n) in zip(ruled, totals, strict=True):
        found.append((i, host, path, rule, verdict or ("allow" if t >= n * edge * 10_000 else "block"), t, n))
    return sorted(found, key=str)


def test_equals_plain_model(spark):
    got = op.judge_urls(frame(spark, urls()).repartition(4))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "total", "symbols"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_verdicts(urls())


def test_models_tell_hosts_apart(spark):
    verdicts = {r["page_id"]: r for r in op.judge_urls(frame(spark, urls())).collect()}
    by_url = {u: verdicts[i]["verdict"] for i, u in urls() if i not in (None, 3)}
    good = [by_url[f"http://good{k}.example/fr/article_{k}"] for k in range(60)]
    bad = [by_url[f"http://win-{k}.example/play"] for k in range(60)]
    assert good.count("allow") >= 57 and bad.count("block") >= 57


def test_no_row_holds_the_ratios(spark):
    plan = op.judge_urls(frame(spark, urls()))._jdf.queryExecution().executedPlan().toString()
    assert "AS _ratios" not in plan and "Python" not in plan and "Arrow" not in plan


def test_tables_without_one_verdict(spark):
    assert op.judge_urls(frame(spark, [])).count() == 0
    for only in (["http://a.net/", "http://b.example/x"], ["http://a.org/fr/", None], ["x", None]):
        rows = list(enumerate(only * 8))
        assert sorted(map(tuple, op.judge_urls(frame(spark, rows)).collect()), key=str) == plain_verdicts(rows)
