"""Similarity join, vector search, url filter, main text and the pipeline against brute force and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.data import DOCS, PROSE, docs, empty
from voxmill.llm import common, html_text, knn, near_join, secrets, urlfilter

# -- n-gram Jaccard join


def _sets(rows, width):
    out = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def _components(rows, width, percent):
    sets = _sets(rows, width)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(s), low[find(k)], links[k]) for k, (i, s) in enumerate(sets)}


def _near_copies():
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [draw.choice(vocabulary) for _ in range(draw.choice((3, 12, 40, 120)))]
        rows.append(text)
        for _ in range(draw.randint(1, 14)):
            copy = list(rows[-1] if draw.random() < 0.5 else text)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            if draw.random() < 0.4:
                copy = copy + [draw.choice(vocabulary)] * draw.randint(1, 4)
            rows.append(copy)
    ids = draw.sample(range(10_000), len(rows))
    return [(i, " ".join(t)) for i, t in zip(ids, rows, strict=True)]


@pytest.mark.parametrize(("width", "percent", "options"), [(3, 90, {}), (5, 80, {}), (3, 80, {"group_sets": 3, "visitors": 2}), (2, 60, {"group_sets": 5, "visitors": 3})])
def test_join_finds_every_link(spark, width, percent, options):
    rows = _near_copies()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = _components(rows, width, percent)
    got = near_join.jaccard_join(table, width, percent, links=True, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want
    got = near_join.jaccard_join(table, width, percent, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: x[:2] for i, x in want.items()}


def test_join_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SMALL, "documents").collect()]
    got = near_join.op4_jaccard_join(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: x[:2] for i, x in _components(rows, 3, 90).items()}


def test_join_is_linear_in_a_large_group(spark, monkeypatch):
    """Near copies of one text, most of which don't link with one another: all their links are found, by few visits."""
    draw = random.Random(8)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1200):
        copy = list(base)
        for _ in range(draw.choice((1, 2, 3, 3, 4, 9))):
            copy[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    made = []
    before = near_join._visits
    monkeypatch.setattr(near_join, "_visits", lambda *a: made.append(before(*a)) or made[-1])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_join.jaccard_join(table, 3, 80, group_sets=32).collect()}
    assert got == {i: x[1] for i, x in _components(rows, 3, 80).items()} and len(set(got.values())) > 10
    assert made[0].count() < 38 * len(rows) / 4


#: Texts of one template: a word of its own at the end, after nine words or after three, and in the middle; and with a second one from a few.
_TEMPLATES = ("dear customer thanks x{k}", "dear customer your order has been sent to you x{k}", "dear customer your order x{k} has been sent to you", "dear customer {c} your order has been sent to you x{k}")


@pytest.mark.parametrize("template", _TEMPLATES)
def test_join_is_linear_on_templates(spark, monkeypatch, template):
    made = []
    before = near_join._visits
    monkeypatch.setattr(near_join, "_visits", lambda *a: made.append(before(*a)) or made[-1])
    rows = [(k, template.format(k=k, c=f"c{k % 7}")) for k in range(1500)]
    got = near_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, group_sets=32).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: x[1] for i, x in _components(rows, 3, 90).items()}
    assert made[0].count() <= len(rows)


def test_join_of_sets_whose_shared_tokens_are_frequent_in_others(spark):
    """Two sets that link by tokens each of which is most frequent among sets connected to one of them, and short sets of all sizes near the threshold."""
    draw = random.Random(12)
    rows = []
    for k in range(500):
        words = "a b c d e f g h i j k l m n".split()[draw.randint(0, 3) : draw.randint(5, 14)]
        for _ in range(draw.choice((0, 0, 1, 1, 2))):
            words[draw.randrange(len(words))] = draw.choice(("p", "q", "r", f"u{k}"))
        rows.append((k, " ".join(words)))
    for width, percent in ((1, 80), (2, 70), (1, 90)):
        got = near_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width, percent, group_sets=4, visitors=5).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: x[1] for i, x in _components(rows, width, percent).items()}


def test_join_counts_links_of_rows_without_an_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (None, text + " one"), (3, text + " two")]
    got = near_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
    assert {(r.doc_id, r.n_links, r.component_id) for r in got} == {(1, 2, 1), (None, 2, None), (3, 2, 1)}


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, 100)], rng.integers(0, 2**63, 20).astype(np.uint64)]))
        x, y = (np.frombuffer(near_join.parity(s), np.uint64) for s in (a, b))
        if len(x) == len(y):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_join_links_sets_of_very_different_sizes(spark):
    # 60 of 150 words: 64 and 256 parity bits
    rows = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60))), (2, " ".join(f"w{k}" for k in range(150)))], "doc_id long, text string")
    got = near_join.jaccard_join(rows, width=1, percent=40, links=True).collect()
    assert {(r.doc_id, r.n_links, r.component_id) for r in got} == {(1, 1, 1), (2, 1, 1)}


def test_join_awkward_rows(spark):
    table = docs(spark)
    got = near_join.jaccard_join(table, links=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in DOCS)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].component_id for i in (1, 6, 7, 8, 10)] == [1] * 5
    assert all((by_id[i].n_shingles, by_id[i].n_links, by_id[i].component_id) == (0, 0, i) for i in (2, 3, 4))
    kept = near_join.keep_one(table)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 9, 11, None, None])
    assert near_join.jaccard_join(empty(spark)).count() == 0 and near_join.keep_one(empty(spark)).count() == 0


def test_keep_one_keeps_one_row(spark):
    rows = [
        (1, PROSE, 0), (1, PROSE, 1), (2, PROSE, 2), (None, PROSE, 3), (None, PROSE + " again", 4),  # one component
        (2, "a text of its own with quite other words", 5), (3, "a text of its own with quite other words", 6),
        (None, "nobody knows the id of these two rows", 7), (None, "nobody knows the id of these two rows", 8),
        (None, "one two three four five six seven eight nine ten", 9), (None, "one two three four five six seven eight nine ten eleven", 10),
        (None, None, 11), (4, "", 12), (4, " ", 13),
    ]
    got = sorted(r.k for r in near_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect())
    assert len(got) == 7 and [sum(k in part for k in got) for part in ((0, 1), (2, 3, 4), (5,), (6,), (7, 8), (9, 10), (11, 12, 13))] == [1, 0, 1, 0, 1, 1, 3]


# -- vector search


def _best(rows, asked, k):
    out = {}
    for q, v in rows:
        if asked(q):
            scored = sorted((-int(sum(a * b for a, b in zip(v, x))), i) for i, x in rows if i != q)
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("options", [{}, {"data_rows": 20, "query_rows": 3, "max_pivots": 7}])
def test_search_is_exact(spark, options):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)] + [(300 + i, [0.5, 0.25, 0.0, 0.0, 0.0, -1.0]) for i in range(40)]
    rows += [(400, [3.0] * 6), (401, [0.0] * 6)]
    bad = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit("extra")).withColumn("g", F.lit(1))
    got = defaultdict(list)
    for r in knn.knn_join(table.filter("vec_id % 10 = 0"), table, k=5, **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    floors = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    assert dict(got) == _best(floors, lambda q: q % 10 == 0, 5)


def test_search_awkward_tables(spark):
    kind = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], kind)
    one = spark.createDataFrame([(1, [1.0, 2.0])], kind)
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    assert knn.knn_join(none, none).count() == 0 and knn.knn_join(one, none).count() == 0 and knn.knn_join(none, one).count() == 0
    assert knn.knn_join(one, one).count() == 0
    assert [(r.query_id, r.rank, r.vec_id) for r in knn.knn_join(one, two).collect()] == [(1, 1, 2)]


def test_search_keeps_query_rows_apart(spark):
    kind = "vec_id long, embedding array<float>"
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5000.0, 1.0]), (3, [0.0, 2.0])], kind)
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (9, [0.0, 1.0])], kind)
    got = sorted((r["rank"], r.vec_id, r.score) for r in knn.knn_join(asked, data, k=2).collect())
    assert got == [(1, 3, 131072), (1, 3, 327680000), (2, 1, 65536), (2, 2, 65536)]


def test_search_keeps_large_ids_beside_null_ones(spark):
    big = 2**60
    rows = [(big, [1.0, 0.0]), (big + 1, [0.5, 0.0]), (big + 2, [0.25, 0.0]), (None, [9.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = knn.knn_join(table.filter(f"vec_id = {big} OR vec_id IS NULL"), table, k=3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(big, 1, big + 1, 32768), (big, 2, big + 2, 16384)]
    none = spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<float>")
    assert knn.knn_join(none, table).count() == 0 and knn.knn_join(table, none).count() == 0


# -- url filter


def test_rules_hold_by_domain_and_prefix(spark):
    urls = [
        "http://example.org/es/x?q#f", "https://EXAMPLE.org/en/12", "http://a.example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/", "http://x.com/fr", "http://com/de/a", "http://x.net/",
        "x.org/es/", None, "", "http://", "http:///path", "a://b.org", "http://example.org?x=/es/", "http://example.org/es/\nline", "ftp://example.org:80/es/", "http://example.org./es/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit("own")).withColumn("rule", F.lit("own")).withColumn("best", F.lit("own"))
    got = {r.page_id: r for r in urlfilter.filter_urls(pages, urlfilter.rule_table(spark)).collect()}
    for k, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        cut = min([len(rest), *[rest.index(c) for c in "/?#" if c in rest]])
        host = rest[:cut].lower()
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best[1], best[2]), url
        assert got[k].key == "own" and got[k].best == "own"
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.rule_table(spark)).count() == 0
    bare = urlfilter.filter_urls(pages, urlfilter.rule_table(spark).limit(0))
    assert {(r.rule, r.verdict) for r in bare.collect()} == {(None, "allow")}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    made = urlfilter.bloom(keys)
    assert keys.filter(~urlfilter.might_contain(made, F.col("key"))).count() == 0
    others = spark.range(3000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert others.filter(urlfilter.might_contain(made, F.col("key"))).count() < 300


_SPELLINGS = {
    "http://Example.org": "example.org/", "https://user:pw@EXAMPLE.org.:443/a/../b/./c/..#top": "example.org/b/", "http://x.y:8080/%7euser/%c3%a4%2F?q=%41#f": "x.y:8080/~user/%C3%A4%2F?q=%41",
    "ftp://h/a/.": "h/a/", "http://h/../..": "h/", "http://h/a//b?": "h/a//b", "http://h/%": "h/%", "http://h/%zz%4": "h/%zz%4", "http://h/a/...": "h/a/...", "http://h?x=/../": "h/?x=/../", "http://@/x": None, "no scheme": None, "": None, None: None,
}


def test_canonical_addresses(spark):
    got = spark.createDataFrame([(u,) for u in _SPELLINGS], "url string").select("url", urlfilter.canonical(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in got} == _SPELLINGS


def test_canonical_addresses_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t (url VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(u,) for u in _SPELLINGS])
    got = dict(con.execute(urlfilter._CANONICAL.format(id="url", table="t")).fetchall())
    assert got == {u: c for u, c in _SPELLINGS.items() if c}


def test_listed_pages_are_blocked_in_any_spelling(spark):
    urls = ["http://a.net/x", "https://A.net:443/y/../x#top", "http://a.net/x?", "http://a.net/x/", "http://a.net/", "http://a.org/x", None, "http://example.org/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("canonical", F.lit("own"))
    listed = spark.createDataFrame([("http://user@a.net./%78",), ("http://a.org/x",), (None,), ("bad",), ("http://a.org/x",)], "url string")
    got = {r.page_id: (r.verdict, r.canonical) for r in urlfilter.filter_urls(pages, urlfilter.rule_table(spark), listed).collect()}
    assert got == {k: (v, "own") for k, v in enumerate(["block", "block", "block", "allow", "allow", "allow", "allow", "block"])}


def test_hosts_and_paths_of_very_many_parts(spark):
    host, path = "a." * 60_000 + "example.org", "/es/" + "x/" * 60_000
    pages = spark.createDataFrame([(1, f"http://{host}{path}"), (2, f"http://{host}/en/1"), (3, "http://" + "b." * 60_000 + "net/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, urlfilter.rule_table(spark)).collect()}
    assert got == {1: (host, path, "example.org/es/", "block"), 2: (host, "/en/1", "example.org/en/1", "block"), 3: ("b." * 60_000 + "net", "/", None, "allow")}


def test_the_list_decides_verdicts_of_the_query(spark):
    got = urlfilter.op5_url_filter(spark, SMALL)
    assert got.filter("rule IS NULL AND verdict = 'block'").count() and not got.filter("rule IS NULL AND verdict = 'block'").filter(~F.col("host").rlike(urlfilter.JUNK_HOSTS)).count()


def test_a_long_list_is_not_in_the_plan(spark):
    listed = spark.range(1_000_000).select(F.concat(F.lit("http://listed.net/"), "id").alias("url"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://listed.net:80/"), F.col("id") * 1000).alias("url"))
    out = urlfilter.filter_urls(pages, urlfilter.rule_table(spark), listed)
    assert out.filter("verdict = 'block'").count() == 1000
    assert len(out._jdf.queryExecution().toString()) < 1_000_000


# -- main text

#: Pages written by hand in styles that the labelled table doesn't have, and their main text.
_ONE = "The council voted on Tuesday to keep the old ferry running through the winter, although fewer than forty people a day now use it."
_TWO = "Its captain, who has made the crossing for thirty years, said that he would rather have had a new engine than a kind word."
_HAND = (
    (f"<body class=home><div id=page><div class=site-nav><a href=/>Start</a> <a href=/n>News</a></div><div class=entry-content><h2>Ferry stays</h2><p>{_ONE}</p><p>Nobody objected.</p><p>{_TWO}</p></div><div id=responses><div class=comment><p>Good news for the island, I think.</p></div></div></div>", ["Ferry stays", _ONE, "Nobody objected.", _TWO]),
    (f"<header><a href=/>The Daily Post</a><nav><a>World</a><a>Sport</a></nav></header><main><h1>Ferry stays</h1><figure><img src=f.jpg></figure><p>{_ONE}</p><blockquote>{_TWO}</blockquote><p>More to follow.</p><aside><h3>Read next</h3><a href=1>Five walks by the sea</a></aside></main><footer>Contact, terms and privacy</footer>", ["Ferry stays", _ONE, _TWO, "More to follow."]),
    (f"<table width=100%><tr><td class=leftmenu><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td><h1>Ferry stays</h1>{_ONE}<p>{_TWO}</td></tr></table><div class=footer>Made with care in 1999</div>", ["Ferry stays", _ONE, _TWO]),
    (f"<div class=\"breadcrumb\"><a>Home</a> &gt; <a>Local</a></div><div class=postBody><p>{_ONE}<p>Yes.<p>{_TWO}<ul><li>Adults pay four.</li><li>Children pay nothing.</li></ul></div><div class=relatedPosts><ul><li><a>Bridge closed again</a></li></ul></div>", [_ONE, "Yes.", _TWO, "Adults pay four.", "Children pay nothing."]),
    (f"<div id=cookieConsent>We use cookies to make this site work and to count how many people read it. <button>Fine</button></div><article><header><h1>Ferry stays</h1><p>By our reporter</p></header><p>{_ONE}</p><div class=\"advert\">Cheap boats for sale this week only</div><p>{_TWO}</p><section class=\"comments\"><h2>Comments</h2><p>{_ONE}</p></section></article>", ["Ferry stays", "By our reporter", _ONE, _TWO]),
    (f"<h1>Ferry stays</h1><p>{_ONE}</p><p>{_TWO}</p><p>{_ONE}</p><hr><p><a href=a>Older</a> <a href=b>Newer</a> <a href=c>All</a></p>", ["Ferry stays", _ONE, _TWO, _ONE]),
    (f"<div class=wrapper><div class=\"col left\"><form action=/s><input name=q> Search the site</form></div><div class=\"col main-text with-sidebar\"><p>{_TWO}</p><p>{_ONE}</p></div><div class=\"sidebar-right\"><h4>Weather</h4><p>Rain until Friday, then a little less rain than before, with some wind from the west and cold nights.</p></div></div>", [_TWO, _ONE]),
    (f"{_ONE}\n\n{_TWO}", [f"{_ONE} {_TWO}"]),
    (f"<p title=\"x>{_ONE}</p><p>{_TWO}</p>", [_ONE, _TWO]),
    (f"<div class=related-work><h2>What others did</h2><p>{_ONE}</p><p>{_TWO}</p></div>", ["What others did", _ONE, _TWO]),
    (f"<div class=\"content no-sidebar\"><h1>Ferry stays<p>{_ONE} {_TWO}", ["Ferry stays", f"{_ONE} {_TWO}"]),
    ("plain text only, no tags", ["plain text only, no tags"]),
)


def test_main_text_of_pages_written_by_hand():
    tree = html_text.default_tree()
    hit = made = wanted = 0
    for page, lines in _HAND:
        got, want = Counter(html_text.main_text(page, tree).split()), Counter(" ".join(lines).split())
        hit, made, wanted = hit + (got & want).total(), made + got.total(), wanted + want.total()
    print(f"precision {hit / made:.3f}, recall {hit / wanted:.3f}")
    assert hit / made >= 0.95 and hit / wanted >= 0.95


def test_tree_holds_on_pages_it_has_not_seen():
    tree, right, total, used = html_text.default_tree(), 0, 0, set()
    for page, marks in html_text.labelled(200, seed=77):
        rows = html_text.figures(html_text.blocks(page))
        right += sum(html_text._is_text(tree, row) == bool(m) for row, m in zip(rows, marks, strict=True))
        total += len(marks)

    def walk(node):
        if len(node) > 1:
            used.add(html_text.FIGURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert right / total > 0.98
    assert used >= {"words", "words before", "words after", "link density", "chrome names"} and used & {"link density before", "link density after"}


def test_main_text_leaves_out_what_surrounds_it():
    tree = html_text.default_tree()
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><nav><a href='/'>Home</a></nav><div class="ad-banner">Buy</div>
    <article><h1>Fish &amp; chips</h1><p>{PROSE}.\n  Second&nbsp;line</p><script>var x = '<p>no</p>'</script><p>{PROSE}</p></article>
    <div class=comments><p>{PROSE}</p></div><footer>All rights reserved</footer></body></html>"""
    assert html_text.main_text(page, tree) == f"Fish & chips\n{PROSE}. Second line\n{PROSE}"
    for odd in ("", "plain", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<p>" * 3000, "&#0;&#xZZ;&bogus;", "<a href=\"x>y"):
        assert isinstance(html_text.main_text(odd, tree), str)


#: Articles that belong to other parts of a page, and the main text around them.
_NESTED = (
    (f"<main><article><h1>Ferry stays</h1><p>{_ONE}</p></article><div id=comments><article class=comment><p>{_TWO}</p></article></div></main>", f"Ferry stays\n{_ONE}"),
    (f"<article><h1>Ferry stays</h1><p>{_ONE}</p></article><aside><article class=teaser><h3><a href=x>Bridge closed again</a></h3><p>{_TWO}</p></article></aside>", f"Ferry stays\n{_ONE}"),
    (f"<article class=post><p>{_ONE}</p><section class=comments><h2>Comments</h2><article><header>Anna</header><p>{_TWO}</p></article></section></article><article class=comment><p>{_TWO}</p></article>", _ONE),
    (f"<article><p>{_ONE}</p></article><div role=contentinfo>{_TWO}</div><div role=complementary><p>{_TWO}</p></div>", _ONE),
    (f"<form id=all><div class='page has-sidebar'><main><article class=card><h2>One</h2><p>{_ONE}</p></article><article class=card><h2>Two</h2><p>{_TWO}</p></article></main></div></form>", f"One\n{_ONE}\nTwo\n{_TWO}"),
)


@pytest.mark.parametrize("page", range(len(_NESTED)))
def test_articles_of_comments_and_asides_are_not_the_pages(page):
    assert html_text.main_text(_NESTED[page][0], html_text.default_tree()) == _NESTED[page][1]


def test_extraction_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<p>{PROSE}</p>"), (3, "u", f"<article><p>{PROSE}</p></article>" + "<p>x</p>" * 20_000), (3, "u", f"<article><p>{PROSE}</p></article>")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert [r.text for r in got if r.page_id is None] == [PROSE]
    assert html_text.extract(pages.limit(0)).count() == 0


# -- pipeline


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    for make in (docs, empty):
        table = make(spark)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, SMALL)
            path = f"{tmp_path}/{make.__name__}-{k}"
            out.write.parquet(path)
            if name != "packing":
                assert out.columns == table.columns, name
                table = spark.read.parquet(path)
            elif make is empty:
                assert spark.read.parquet(path).count() == 0


def test_pipeline_runs_all_stages(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    ends = defaultdict(int)
    for r in got:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert got and max(ends.values()) <= 4096 and sum(r.length for r in got) == sum(ends.values())


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what its predecessor wrote: near duplicates, secrets, mixing and packing against plain Python."""
    stages = dict(corpus_pipeline.STAGES)

    def written(name, table):
        table.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = written("quality", stages["quality"](spark, common.read(spark, SMALL, "documents"), SMALL))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = written("near", stages["near_duplicates"](spark, good, SMALL))
    want = {c for n, c, _ in _components(rows, 5, 80).values() if n} | {i for i, (n, _, _) in _components(rows, 5, 80).items() if not n}
    assert Counter(r.doc_id for r in one.collect()) == Counter(want)

    clean = written("secrets", stages["secrets"](spark, one, SMALL))

    def redacted(text):
        spans = []
        for rule in secrets.ALL_RULES:
            spans += [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    assert {r.doc_id: r.text for r in clean.collect()} == {r.doc_id: None if r.text is None else redacted(r.text) for r in one.collect()}

    mixed = written("mix", stages["mix"](spark, clean, SMALL))
    size, taken = Counter(), Counter()
    for r in clean.collect():
        size[r.source] += len((r.text or "").encode().split())
    for r in mixed.collect():
        taken[r.source] += len(r.text.encode().split())
    assert set(taken) <= set(size) and all(taken[k] <= 2 * size[k] for k in size) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size) + 0.5 * sum(size.values())

    packed = stages["packing"](spark, mixed, SMALL).collect()
    whole = Counter((r.doc_id, r.doc_tokens) for r in packed for _ in range(r.start == 0))
    assert sum(whole.values()) == mixed.count() and sum(r.length for r in packed) == sum(n * t for (_, t), n in whole.items())
