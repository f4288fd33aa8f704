import random
import zlib
from collections import Counter, defaultdict

import pytest

from lithic.llm import sharding, url_filter
from lithic.llm.queries import URL_RULES, op8_sharding
from tests.llm.fixtures import nothing, odd, odd_rows

SF = "/root/testdata/sf0.001"


def test_tree_is_best_fit():
    rng = random.Random(5)
    for bins in (None, 4):
        sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
        left, want = [100] * (bins or 0), []
        for s in sizes:
            fits = [(room, b) for b, room in enumerate(left) if room >= s]
            b = min(fits)[1] if fits else (max((room, i) for i, room in enumerate(left))[1] if bins else len(left))
            if b == len(left):
                left.append(100)
            left[b] -= s
            want.append(b)
        assert list(sharding.pack(sizes, 100, bins)) == want


@pytest.mark.parametrize("path", ["documents", "odd"])
def test_shards(spark, path):
    docs = odd(spark) if path == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows, source = sharding.shard_documents(docs).collect(), [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in source)
    slots, groups, load = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    capacity = -(-sum(load.values()) // 16)
    size = Counter()
    for i, t in source:
        size[zlib.crc32(t), len(t) + 1] += len(t) + 1
    assert all(len(groups[k]) == 1 for k in groups if size[k] <= capacity)
    if path == "documents":
        assert max(load.values()) <= max(capacity * 1.02, max(n for _, n in size))
        assert op8_sharding(spark, SF).filter("law != 'bytes' or grown_shard is not null").count() == 0


def test_huge_group_is_cut(spark):
    rows = [(i, "copy " * 20) for i in range(1000)] + [(1000 + i, f"text {i} " * 12) for i in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 16
    assert len(load) == 16 and max(load.values()) < 1.25 * mean and len(got) == 2000
    assert sharding.shard_documents(nothing(spark)).count() == 0


URLS = [None, "", "no scheme", "http://example.org", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/12", "http://example.org/en/2?x=/en/1", "http://example.com/fr/9", "http://x.com/de/1#a", "http://com/de/", "http://notorg/x", "http://x.net/casino-royal", "http://x.net/casinos", "http://x.net/wp-login.php?a", "http://x.org/casino", "://host", "http://a.com/x://b.org/es/", "http://evil.com/.example.org/es/1", "http://org/", "http://x.org?y", "http://example.org/en/12"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, tail = rest[:end].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[end:]
    path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
    fits = []
    for rule in URL_RULES:
        h, p = rule.name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule.name), rule.name, rule.verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    rows = [(i % 19, u, "x") for i, u in enumerate([*URLS, URLS[4], None])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, u, _ in rows:
        host, path, rule, verdict = plain(u)
        blocked = u in ("http://x.net/casino-royal", "http://x.net/wp-login.php?a")
        want[i, host, path, rule, verdict or ("block" if blocked else "allow")] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_rule_without_token_reaches_every_url(spark):
    pages = spark.createDataFrame([(1, "http://a.net/@@"), (1, "http://a.net/@@"), (2, "http://b.net/")], "page_id long, url string")
    rules = [url_filter.pattern_rule("at", "@@"), url_filter.pattern_rule("bang", "!!")]
    got = url_filter.judge_urls(pages, URL_RULES, rules).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(1, "block"), (1, "block"), (2, "allow")]
