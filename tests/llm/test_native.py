import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

from mirrorframe.llm import containment, imatch, queries, urls

SCHEMA = "doc_id long, text string, item_id string, words int, key int, host string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "h", "p") for i, t in rows], SCHEMA)


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingled(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def plain_containment(docs, items):
    out = set()
    for item, text in items:
        if not words(text):
            continue
        width = min(5, len(words(text)))
        own = shingled(text, width)
        for doc, body in docs:
            both = len(own & shingled(body, width))
            if 100 * both >= 80 * len(own):
                out.add((doc, item, len(own), both))
    return out


def found_containment(docs, items):
    return {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in containment.contained(docs, items).collect()}


def test_containment_agrees_with_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = found_containment(docs, items)
    assert found == plain_containment([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found


@pytest.mark.parametrize("sent", [True, False])
def test_containment_of_odd_rows(spark, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr("mirrorframe.llm.native.SENT_ROWS", 0)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "x " * 50_000 + passage.upper() + " y" * 50_000), (3, passage), (3, passage), (4, " ".join(f"p{i}" for i in range(25))),
            (5, "p0, p1!"), (None, passage), (6, "p0 p1 p2 p3 q p5"), (7, "Ünï p0 p1 code"), (8, " ".join(f"p{i}" for i in range(4, 30)))]
    items = [(1, passage), (2, "p0 p1"), (3, None), (4, "..."), (5, "ünï"), (6, passage), (None, "p0 p1 p2")]
    found = found_containment(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert found == plain_containment(docs, items)
    empty = frame(spark, [])
    assert containment.contained(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert containment.contained(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def word_hash(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), 42))


def plain_fingerprint(text, lexicon):
    terms = {word_hash(w) for w in words(text)}
    level = max(0, math.floor(math.log2(max(len(terms), 1) / imatch.SUBSETS)))
    out = []
    for step in (level, level + 1):
        kept = sorted(t for t in terms & lexicon if (t >> 6) & ((1 << step) - 1) == 0)
        places = {}
        for t in kept:
            h = places.get(t & 63, 42)
            places[t & 63] = xxhash.xxh64_intdigest((t & (2**64 - 1)).to_bytes(8, "little"), h)
        out.append({(j, h & 0xFFFF) for j, h in places.items()})
    if not out[0]:
        return level, set(), set(), f"={xxhash.xxh64_hexdigest(text.encode(), 42).lstrip('0').zfill(1)}"
    show = lambda c: "".join(f"{j * 65536 + h:06x}" for j, h in sorted(c))
    return level, *out, f"{level}:{show(out[0])}:{show(out[1])}"


def plain_likeness(a, b):
    share = lambda x, y: len(x & y) / len({j for j, _ in x | y}) if x | y else 0.0
    if a[3] == b[3]:
        return 1.0
    if a[0] == b[0]:
        return share(a[1], b[1])
    if a[0] + 1 == b[0]:
        return share(a[2], b[1])
    return share(a[1], b[2]) if b[0] + 1 == a[0] else 0.0


def plain_comparison(rows):
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    df = Counter(w for _, t in rows for w in {word_hash(w) for w in words(t)})
    n = len(rows)
    low, high = max(1, math.ceil(imatch.LEAST_SHARE * n)), max(1, math.floor(imatch.GREATEST_SHARE * n))
    lexicon = {w for w, k in df.items() if low <= k <= high}
    prints = [plain_fingerprint(t, lexicon) for _, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % n][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        changed = plain_fingerprint(edited, lexicon)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k][3], changed[3], plain_likeness(prints[k], changed), plain_likeness(prints[k], prints[(k + 1) % n]))
    return out


def comparison(docs):
    rows = imatch.compared(docs).collect()
    return rows, {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows}


def test_fingerprints_agree_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, found = comparison(docs)
    want = plain_comparison([(r.doc_id, r.text) for r in docs.collect()])
    assert len(rows) == len(want) and found.keys() == want.keys()
    for i, x in want.items():
        assert found[i][:4] == x[:4] and found[i][4:] == pytest.approx(x[4:])
    assert np.mean([x[4] for x in want.values()]) > 0.3 > 0.05 > np.mean([x[5] for x in want.values()])


def test_fingerprints_of_odd_rows(spark):
    rows = [(5, "é😀 a b c"), (3, None), (9, ""), (-4, "one"), (12, "word " * 300_000), (7, " ".join(f"w{i}" for i in range(5000))), (8, " ".join(f"w{i}" for i in range(5000)))]
    _, found = comparison(frame(spark, rows))
    want = plain_comparison(rows)
    assert found.keys() == want.keys()
    for i, x in want.items():
        assert found[i][:4] == x[:4] and found[i][4:] == pytest.approx(x[4:])
    assert found[7][2] == found[8][2]
    repeated, _ = comparison(frame(spark, [(1, "a b"), (1, "a b"), (1, "c"), (None, "x y"), (None, None)]))
    assert sorted((r.doc_id or 0, r.n_chars) for r in repeated) == [(0, 0), (0, 3), (1, 1), (1, 3), (1, 3)]
    alone, found = comparison(frame(spark, [(1, "abcdef")]))
    assert len(alone) == 1 and found[1][1] == hashlib.sha256(b"abcdab").hexdigest()
    assert imatch.compared(frame(spark, [])).count() == 0


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(on + under), on + under, what) for what, on, under in queries.URL_RULES if (host == on or host.endswith("." + on)) and path.startswith(under)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_on_the_pages_and_odd_ones(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "http://", "://net/", "HTTP://NET/x", "https://A.Net?x=/", "http://xnet/", "http://example.net/en/", "http://www.EXAMPLE.net/en", "https://a.org/fr/",
           "http://org/fr/1#/x", "http://b.example.com/de/?q", "http://user@h:80/a/b;c#f", "a://b://c/d", "http://é.Net/É", "http://x.com/a\nb?c", "ads-track.example.com", "x" * 100_000]
    rows = [(r.page_id, r.url) for r in pages.collect()] + [(100_000 + i, u) for i, u in enumerate(odd)] + [(None, odd[7])] * 2
    data = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in rows], "page_id long, url string, host string, verdict string, label string")
    found = urls.judged(data, queries.URL_RULES).collect()
    assert len(found) == len(rows)
    want = {i: (*plain_parts(u), *plain_rule(*plain_parts(u))) for i, u in rows}
    for r in found:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))
    assert urls.judged(data.limit(0), queries.URL_RULES).count() == 0


def test_the_classifier_tells_hosts_it_has_not_seen(spark, sf):
    bad = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x", "megacasino", "pokerslots", "betting-tips", "viagra-pills", "xxxporn", "adtracking"]
    good = ["stackoverflow", "oxfordshire", "geography", "orchestra", "newspaper", "village-hall", "statistics", "mountaineering", "kitchen-tables", "weatherman", "thering", "tionble"]
    known = {*urls.BLOCKED_NAMES, *urls.ALLOWED_NAMES}
    hosts = {w for r in spark.read.parquet(f"{sf}/pages.parquet").collect() for w in plain_parts(r.url)[0].split(".")}
    assert not known & {*bad, *good} and not known & hosts
    rows = [(w, f"https://{p}{w}.{z}/{n}") for w in bad + good for p, z, n in (("", "example.com", "en/77"), ("www.", "org", "fr/2.html"), ("m.", "net", "questions/1"))]
    verdicts = urls.judged(spark.createDataFrame(rows, "page_id string, url string"), []).collect()
    blocked = {w: sum(r.verdict == "block" for r in verdicts if r.page_id == w) for w in bad + good}
    # Names that share few n-grams with any known one are missed: 31 of 36 were caught when this bound was set.
    assert sum(blocked[w] for w in bad) >= 0.75 * 3 * len(bad), blocked
    assert sum(blocked[w] for w in good) <= 0.1 * 3 * len(good), blocked
