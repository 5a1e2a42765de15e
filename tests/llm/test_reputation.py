import random
import re

import pytest

from tidemark.llm import reputation

URLS = ["HTTP://A.Example.com/en/7?x#y", "https://example.com", "no scheme", None, "x://h?q/z", "a://b://c/d", "s://HOST.net/de/8#z", "http://É.com/en/1", "http://sub.example.net/de/81", "http://example.net.evil.org/es/", "://", "http://com/en/"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def brute_rule(host, path):
    fit = [(h + p, v) for v, h, p in reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


def brute_reputation(hosts, outcomes):
    count = {h: [0, 0] for h in hosts}
    for h, b in outcomes:
        if h in count:
            count[h][0] += 1
            count[h][1] += b
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    suffix = {d: d.split(".")[-1] for d in domain.values()}

    def add(keys, below):
        return {k: [sum(c[j] for x, c in below.items() if keys[x] == k) for j in (0, 1)] for k in set(keys.values())}

    def level(counts, parent, prior):
        out = {}
        for p in set(parent[k] for k in counts):
            own = [k for k in counts if parent[k] == p]
            seen = [k for k in own if counts[k][0]]
            m, n = prior[p], sum(counts[k][0] for k in seen)
            square = sum(counts[k][0] * (counts[k][1] / counts[k][0] - m) ** 2 for k in seen)
            strength = 1000.0
            if seen and n > len(seen) and 0 < m < 1:
                rho = (square / (m * (1 - m)) - len(seen)) / (n - len(seen))
                strength = min(1000, max(1, 1 / max(rho, 1e-9) - 1)) if rho > 0 else 1000.0
            for k in own:
                out[k] = (m * strength + counts[k][1], (1 - m) * strength + counts[k][0] - counts[k][1])
        return out

    domains = add(domain, count)
    suffixes = add(suffix, domains)
    whole = [sum(c[j] for c in count.values()) for j in (0, 1)]
    mean = lambda ab: {k: a / (a + b) for k, (a, b) in ab.items()}
    s = mean(level(suffixes, dict.fromkeys(suffixes, 0), {0: (whole[1] + 0.5) / (whole[0] + 1)}))
    d = mean(level(domains, suffix, s))
    return {h: (a / (a + b), max(0, a / (a + b) - (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)) for h, (a, b) in level(count, domain, d).items()}


def test_parts_and_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    for r in reputation.judge(rows, none, reputation.RULES).collect():
        host, path = brute_parts(URLS[r.id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.id]


def test_reputation_against_brute_force(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.d{i % 4}.{('com', 'org')[i % 2]}" for i in range(14)] + ["", "localhost"]
    outcomes = [(h, int(rng.random() < (0.9 if "d1" in h else 0.1))) for h in hosts[:-3] for _ in range(rng.randint(0, 30))]
    got = reputation.reputation(spark.createDataFrame([(h,) for h in hosts * 2], "host string"), spark.createDataFrame([*outcomes, (None, 1), ("h0.d0.com", None)], "host string, bad int"))
    want = brute_reputation(hosts, outcomes)
    rows = {r.host: (r.mean, r.low) for r in got.collect()}
    assert set(rows) == set(want)
    for h, pair in want.items():
        assert rows[h] == pytest.approx(pair)
    assert all(rows[h][0] > 0.5 for h in rows if ".d1." in h) and rows["h0.d0.com"][0] < 0.5


def test_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    outcomes = spark.createDataFrame([("h.com", 1)], "host string, bad int")
    assert reputation.judge(none, outcomes, []).count() == 0
    rows = spark.createDataFrame([(None, "http://h.com/x", "q"), (1, "http://h.com/x", "q"), (1, "http://h.com/x", "q")], "page_id long, url string, host string")
    assert [r.host for r in reputation.judge(rows, outcomes, []).collect()] == ["h.com"] * 3
