import hashlib

import pytest
from llm_brute import CLASHES, awkward, awkward_rows, contamination, quality, sentence, words
from pyspark.sql import functions as F

from metalens.llm import decontaminate, quality_rules, url_rules


def _judged(frame, **options):
    return sorted((tuple(r) for r in quality_rules.judge(frame, **options).collect()), key=str)


def test_quality_statistics_equal_brute_force(spark):
    rows = [r for r in awkward_rows() if r[0] not in (13, 14)]  # brute force is quadratic in the text
    got = [r[:7] for r in _judged(awkward(spark, rows))]
    assert got == sorted(((i, *quality(t)) for i, t in rows), key=str)


def test_quality_order_changes_no_verdict(spark):
    frame = awkward(spark)
    verdicts = _judged(frame, rules=quality_rules.RULES)
    assert verdicts == _judged(frame, rules=tuple(reversed(quality_rules.RULES))) == _judged(frame)
    assert all(not r[7] for r in verdicts if r[6])  # what the base rejects is not kept
    assert {r.name for r in quality_rules.ordered(frame)} == {r.name for r in quality_rules.RULES}


def test_quality_cascade_rejects_each_kind_of_junk_and_keeps_prose(spark):
    import random

    prose = sentence(random.Random(1), 80, 5000)
    rows = [(1, prose), (2, prose + " #" * 20), (3, "\n".join(f"{prose[:40]} line" for _ in range(6)) + prose), (4, prose.upper()),
            (5, " ".join(w + " " + w for w in prose.split())), (6, prose.replace("w", "extraordinarilylong")), (7, "too short")]
    kept = {r.doc_id for r in quality_rules.keep_good(awkward(spark, rows)).collect()}
    assert 1 in kept and not kept & {2, 4, 5, 6, 7}


def test_quality_stage_keeps_columns_and_rows(spark):
    frame = awkward(spark)
    out = quality_rules.keep_good(frame)
    good = {r[0] for r in _judged(frame) if r[7]}
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == good


def test_quality_of_empty_table(spark):
    empty = awkward(spark, [])
    assert quality_rules.judge(empty).count() == quality_rules.keep_good(empty).count() == 0


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("window", F.lit("own")).withColumn("n_words", F.lit(1))


def _benchmark():
    texts = dict(r for r in awkward_rows() if r[0] is not None)
    first, second = texts[1].split(), texts[10].split()
    return [(10, " ".join(first[5:30])), (9, " ".join(second[40:55]).upper()), (100, " ".join(first[20:26])), (None, " ".join(first[:12])), (7, None), (8, "..."),
            (9, " ".join(second[40:55])), (3, "not there at all"), (5, "one, TWO!")]


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 2000])
def test_decontamination_equals_brute_force(spark, most):
    rows, items = awkward_rows(), _benchmark()
    out = decontaminate.find_benchmark(awkward(spark), _items(spark, items), max_broadcast_bytes=most)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.items_sha256) for r in out.collect()), key=str)
    want = []
    for i, t in rows:
        n, hit, found = contamination(t, items)
        want.append((i, n, hit, tuple(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(w[2] > 0 for w in want) > 5


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_BYTES, 2000])
def test_decontamination_drops_exactly_the_hit_documents(spark, most):
    frame = awkward(spark)
    out = decontaminate.drop_contaminated(frame, _items(spark, _benchmark()), max_broadcast_bytes=most)
    assert out.columns == frame.columns
    clean = sorted((i for i, t in awkward_rows() if not contamination(t, _benchmark())[1]), key=str)
    assert sorted((r.doc_id for r in out.collect()), key=str) == clean


def test_decontamination_of_empty_tables(spark):
    nothing = _items(spark, [])
    assert decontaminate.find_benchmark(awkward(spark, []), _items(spark, _benchmark())).count() == 0
    assert decontaminate.find_benchmark(awkward(spark), nothing).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.drop_contaminated(awkward(spark), nothing).count() == len(awkward_rows())


RULES = (url_rules.HostRule("block", "net", "/"), url_rules.HostRule("allow", "example.net", "/en/"), url_rules.HostRule("block", "example.com", "/de/"), url_rules.HostRule("allow", "org", "/fr/"))
URLS = [
    ("http://a.example.net/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://A.Example.NET/de/x?q=/en/", "a.example.net", "/de/x", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"), ("http://subnet/", "subnet", "/", None, "allow"),
    ("http://example.com/de/1#y", "example.com", "/de/1", "example.com/de/", "block"), ("http://myexample.com/de/1", "myexample.com", "/de/1", None, "allow"),
    ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("ftp://u:p@h.net:80/a://b/c?d", "u:p@h.net:80", "/a://b/c", None, "allow"), ("http://h?x/y", "h", "", None, "allow"), ("http://ÜBER.net/é\n/x", "Über.net", "/é\n/x", "net/", "block")]


def _pages(spark, urls):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "confidence", "tokens", "token", "given", "n"):
        frame = frame.withColumn(name, F.lit("own"))
    return frame


def test_url_given_rules(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    out = url_rules.judge_urls(_pages(spark, [u[0] for u in URLS]), none, RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert got[i] == (host, path, rule, verdict)


def test_url_mined_rules_block_like_urls(spark):
    labelled = [(f"http://w{i}.casino.com/win/{i}", True) for i in range(30)] + [(f"http://w{i}.blog.com/win/{i}", False) for i in range(30)]
    labelled += [(f"http://w{i}.blog.com/bet/{i}", i % 10 != 0) for i in range(40)]
    labelled += [(f"http://w{i}.news.com/a/{i}", False) for i in range(100)] + [(None, True), ("http://w1.casino.com/win/1", True)]
    rules = url_rules.mine(spark.createDataFrame(labelled, "url string, bad boolean"))
    found = {tuple(r.tokens) for r in rules.collect()}
    assert ("word=casino",) in found and ("path=bet",) in found and ("path=win",) not in found and all(1 <= len(t) <= 2 for t in found)
    urls = ["http://x.casino.com/other", "http://y.blog.com/win/1", "http://z.blog.com/bet/77", "http://q.org/", "http://x.casino.com/other", None]
    out = url_rules.judge_urls(_pages(spark, urls), spark.createDataFrame(labelled, "url string, bad boolean"))
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["block", "allow", "block", "allow", "block", "allow"]


def test_url_rules_match_brute_force_counts(spark):
    import random
    from itertools import combinations

    rng = random.Random(2)
    labelled = [(f"http://h{rng.randrange(4)}.s{rng.randrange(3)}.com/p{rng.choice('abc')}/{i}?k{rng.randrange(2)}=1", rng.random() < 0.5) for i in range(300)]
    frame = spark.createDataFrame(labelled, "url string, bad boolean")
    sets = [(set(r.t), r.bad) for r in frame.select(url_rules.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    got = {tuple(r.tokens) for r in url_rules.mine(frame, min_confidence=0.6, min_support=0.02, min_rows=3).collect()}
    want = set()
    for tokens in {c for s, _ in sets for k in (1, 2) for c in combinations(sorted(s), k)}:
        n, bad = sum(set(tokens) <= s for s, _ in sets), sum(set(tokens) <= s and b for s, b in sets)
        if bad >= 6 and bad / n >= 0.6:
            want.add(tokens)
    assert got == want and want


def test_url_rules_of_three_tokens_block(spark):
    labelled = [(f"http://h{i >> 2 & 1}.com/{"pq"[i >> 1 & 1]}/x{i}?k{i & 1}=1", i % 8 == 7) for i in range(160)]
    urls = [f"http://h{i >> 2}.com/{"pq"[i >> 1 & 1]}/new?k{i & 1}=2" for i in range(8)]
    out = url_rules.judge_urls(_pages(spark, urls), spark.createDataFrame(labelled, "url string, bad boolean"))
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["allow"] * 7 + ["block"]


def test_url_rules_of_any_size_match_brute_force(spark):
    import random
    from itertools import combinations

    rng = random.Random(4)
    labelled = [(f"http://h{rng.randrange(3)}.com/p{rng.choice('ab')}/{i}?k{rng.randrange(2)}=1&m{rng.randrange(2)}=1", rng.random() < 0.5) for i in range(200)]
    frame = spark.createDataFrame(labelled, "url string, bad boolean")
    sets = [(r.url, set(r.t), r.bad) for r in frame.select("url", url_rules.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    want = {}
    for tokens in {c for _, s, _ in sets for k in range(1, len(s) + 1) for c in combinations(sorted(s), k)}:
        n, bad = sum(set(tokens) <= s for _, s, _ in sets), sum(set(tokens) <= s and b for _, s, b in sets)
        if bad >= 4 and bad / n >= 0.6:
            want[tokens] = bad / n
    rules = url_rules.mine(frame, min_confidence=0.6, min_support=0.02, min_rows=3, max_tokens=None)
    assert {tuple(r.tokens): r.confidence for r in rules.collect()} == pytest.approx(want) and any(len(t) > 3 for t in want)
    best = {u: max(c for t, c in want.items() if set(t) <= s) for u, s, _ in sets if any(set(t) <= s for t in want)}
    few = url_rules.needed(rules)
    assert {r.url: r.confidence for r in url_rules.matched(frame, few).collect()} == pytest.approx(best) and few.count() < len(want)


def test_url_filter_of_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    assert url_rules.judge_urls(empty, none, RULES).count() == 0
    few = spark.createDataFrame([("http://a.b/1", True)], "url string, bad boolean")
    assert url_rules.judge_urls(_pages(spark, ["http://a.b/1"]), few).first().verdict == "allow"


def test_labelled_urls_take_the_document_number_in_the_path(spark):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 1), (4, None, None), (None, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    urls = ["http://h/en/1", "http://h/2.html", "http://h/x/3/", "http://h/4", "http://h/none", None, "http://h/9"]
    got = {(r.url, r.bad) for r in url_rules.labelled_urls(_pages(spark, urls), labels).collect()}
    assert got == {("http://h/en/1", True), ("http://h/2.html", False), ("http://h/x/3/", True), ("http://h/4", False)}


def test_word_definition_is_ascii_white_space():
    assert words("a\x1cb\u00a0c d\x0be") == ["a\x1cb\u00a0c", "d", "e"] and "n_words" in CLASHES
