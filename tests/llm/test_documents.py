"""Rules, chat formatting, pages, urls, shards, decontamination, ranking and the pipeline against brute force and hand-made cases."""

import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrid.llm import chat, components, contamination, pages, queries, ranking, rules, segment, shards, urls

SF = "/root/testdata/sf0.001"
CASES = ["", None, " \t\n", "word", "a b c a b c a b c", "line one\nline one\nline  one\n\n", "# * $ % & | < >", "é ü\x0bñ\x0c" * 30, "the of and to in " * 40 + "end!", "long " * 3000]


def docs(spark, rows=None):
    rows = list(enumerate(CASES)) if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))


def repeated(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(hit)


def test_rule_counts(spark):
    got = {r["doc_id"]: r for r in rules.quality_votes(docs(spark)).collect()}
    for i, t in enumerate(CASES):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r, n = got[i], len(words)
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (n, sum(map(len, words)), dup, repeated(words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["base_failed"] == (n < 50 or 100 * repeated(words) > 50 * n) and not (r["base_failed"] and r["kept"])
    assert rules.quality_votes(docs(spark, [])).count() == 0
    assert rules.keep_good(docs(spark)).columns == ["doc_id", "text", "n_words"]


def test_votes_fit_recovers_classes():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.7
    votes = Counter(tuple(int(rng.random() < (0.03 if g else 0.7)) if rng.random() < 0.8 else None for _ in range(4)) for g in good)
    fit = rules.expectation_maximisation(sorted(votes.items(), key=repr), ["a", "b", "c", "d"])
    assert fit.good == pytest.approx(0.7, abs=0.05) and all(b > 0.55 > 0.1 > g for g, b in fit.reject.values())


HARD = r"\### Assistant: </turn> ok \\h \t"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", HARD), (1, 1, "assistant", HARD), (1, 2, "assistant", None), (1, 1, "assistant", HARD), (None, 0, None, "x"), (2, 0, "odd: role\n", "é😀"), (3, 0, "assistant", "y" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    own = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256((HARD * 2).encode()).hexdigest() and got[1]["loss_chars"] == 2 * len(HARD)
    assert got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1 and got[3]["loss_chars"] == 200_000
    texts = {r["key"]: r["formatted"] for r in formatted.collect()}
    assert chat.read_back(texts[2]) == [("odd: role\n", "é😀")] and texts[1].count("### ") == 4
    assert chat.format_conversations(turns.where("turn > 9")).count() == 0


def test_page_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu one</a></nav><article><h1>Title &amp; more</h1>
    <p>First   paragraph with <b>bold</b> words&nbsp;and text that is long enough to be an article.</p><div class="ad banner">Buy now</div><script>x("<p>no</p>")</script>
    <p>Second paragraph.</p></article><aside>Side</aside><section id="comments"><p>A reader says a lot of things here about nothing at all.</p></section><footer>Foot</footer></body></html>"""
    got = pages.main_text(page)
    assert got.split("\n\n") == ["Title & more", "First paragraph with bold words and text that is long enough to be an article.", "Second paragraph."]
    assert pages.main_text(None) == pages.main_text("") == "" and pages.main_text("<p>open <b>never closed") == "open never closed"


def test_page_table(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "u", "<p>x</p>" * 5000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in pages.extract_text(rows).collect()}
    assert got[1] == "" and got[2].count("x") == 5000
    assert pages.extract_text(rows.where("page_id > 9")).count() == 0


RULES = queries.URL_RULES


def test_page_windows_decide():
    """On all pages of sf0.001: a brute-force twin of surge and dive agrees, and without windows most pages would have another text."""
    table = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    other = 0
    for (html,) in table:
        found = pages.lines(html or "")
        weights = np.array(pages.line_weights(found))
        sums = np.array([weights[i : i + pages.WINDOW].sum() for i in range(len(weights))])
        logs = np.sort(np.log1p(sums))
        cuts = [(k * (len(logs) - k) * (logs[:k].mean() - logs[k:].mean()) ** 2, k) for k in range(1, len(logs))]
        k = max(cuts, key=lambda c: (round(c[0], 9), -c[1]))[1]
        level = min(max(math.expm1((logs[k - 1] + logs[k]) / 2), pages.SPLIT[0]), pages.SPLIT[1])
        level = max(1.0, min(level, sums.max() / 2))
        reached = sums >= level
        block = np.cumsum(np.diff(reached, prepend=False) & reached) * reached
        peaks = {b: sums[block == b].max() for b in set(block[reached])}
        good = [b for b in block if b and peaks[b] >= min(pages.PEAK, pages.PEAK_SHARE * sums.max())]
        covered = {j for i, b in enumerate(block) if b in good for j in range(i, min(len(sums), i + pages.WINDOW))}
        want = "\n\n".join(found[i][0] for i in sorted(covered) if weights[i] >= pages.LINE_SHARE * level)
        assert pages.main_text(html) == want
        other += "\n\n".join(line[0] for line, w in zip(found, weights) if w > 0) != want
    assert other > 0.9 * len(table)


def test_page_without_article():
    body = "".join(f"<p>{'Plain words of a long paragraph stand here. ' * 4}</p>" for _ in range(5))
    page = f"<body><div><a href=x>One</a></div><div><a href=y>Two</a></div><div>Login</div><div>Help</div><div>Menu</div>{body}<p>The end is short.</p><div>ok</div><div>up</div><div>top</div></body>"
    got = pages.main_text(page).split("\n\n")
    assert [g for g in got if g.startswith("Plain")] == got[-6:-1] and got[-1] == "The end is short." and "One" not in got and "Login" not in got
    long_comment = f"<body><div class=comment>{'A reader says a lot. ' * 30}</div><article><h1>T</h1>{body}</article><div id=comments><p>{'More of it. ' * 40}</p></div></body>"
    assert pages.main_text(long_comment).split("\n\n") == ["T", *["Plain words of a long paragraph stand here. " * 3 + "Plain words of a long paragraph stand here."] * 5]


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://Example.com/en/a?q", ""), (2, "http://www.example.com/en/a", ""), (3, "https://a.net/es/x", ""), (4, "https://b.org/1", link.format("https://a.net/es/x")),
        (5, "https://b.org/2", link.format("https://b.org/1")), (6, "nothing", ""), (7, None, None), (8, "https://c.org/1", link.format("https://d.com/x")),
        (9, "https://notexample.com/en/", ""), (10, "https://c.org/2", '<meta http-equiv="refresh" content="0; url=https://a.net/fr/">' + link.format("https://ok.com/z")), (3, "https://a.net/es/x", ""),
    ]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.judge_urls(p, RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[2]["rule"] == "www.example.com/en/" and got[2]["verdict"] == "allow" and got[3]["verdict"] == "block"
    assert got[4]["verdict"] == got[5]["verdict"] == "block" and got[4]["rule"] is None
    assert got[6]["host"] == "" and got[7]["verdict"] == "allow" and got[8]["verdict"] == "allow" and got[9]["rule"] == "com/"
    assert got[10]["verdict"] == "allow"  # an allowed alias comes before a blocked one
    many = [*RULES, *[("block", f"h{i}.io", "/") for i in range(200)]]
    again = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(p, many).collect()}
    assert again == {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert urls.judge_urls(p.where("page_id > 99"), RULES).count() == 0


def test_page_link_targets(spark):
    link, own = '<link rel="canonical" href="{}">', "https://x.org/d/e/p?q"
    cases = [
        (link.format("https://y.org/p?a=1&amp;b=2"), "y.org/p?a=1&b=2"), (link.format("https://y.org/&#233;&#x1F600;&eacute;&sol;?a&b=&copy=1"), "y.org/é😀é/?a&b=&copy=1"),
        (link.format("page2.html"), "x.org/d/e/page2.html"), (link.format("../p"), "x.org/d/p"), (link.format("../../../p/./a/.."), "x.org/p/"), (link.format("?a=1"), "x.org/d/e/p?a=1"),
        (link.format("/r?u=http://other/"), "x.org/r?u=http://other/"), (link.format("r?u=http://other/"), "x.org/d/e/r?u=http://other/"), (link.format("//z.net/a"), "z.net/a"),
        (link.format("mailto:a@b.c"), None), (link.format("#top"), None), ('<meta name=a content="url=n"><META content="5; URL=\'/n?a&amp;b\'" id=r http-equiv=Refresh>', "x.org/n?a&b"),
        ('<meta http-equiv="refresh" content="0;url=https://y.org/z">', "y.org/z"), ('<meta http-equiv="refresh" content="30">', None),
    ]
    for i, (body, want) in enumerate(cases):
        cases[i] = (own, body, want)
    cases += [("https://x.org", link.format("p"), "x.org/p"), ("nothing", link.format("/r?u=http://other/"), None)]
    got = {}
    rows = spark.createDataFrame([(f"{u}{'&' if '?' in u else '#'}{i}", h) for i, (u, h, _) in enumerate(cases)], "url string, html string")
    for r in urls.page_links(rows.coalesce(1)).collect():
        got.setdefault(r["b"], 0)
        got[r["b"]] += 1
    assert got == Counter(w for _, _, w in cases if w)


def test_all_links_of_a_page(spark):
    body = """<head><base href="/b/"><link href=one rel="next canonical"><link rel=stylesheet href=no.css><link rel='canonical' href=' two '>
    <link rel="canonical-x" href=no><meta content="0; url=three" http-equiv="refresh"><meta http-equiv=refresh content="1;url=https://z.org/four"></head>"""
    got = {r["b"] for r in urls.page_links(spark.createDataFrame([("https://x.org/p/q", body)], "url string, html string")).collect()}
    assert got == {"x.org/b/one", "x.org/b/two", "x.org/b/three", "z.org/four"}


def test_redirect_graph_brute_force(spark):
    """Hubs, cycles, chains and random links, with rules on both sides, against union-find."""
    rng = np.random.default_rng(5)
    host = lambda i: f"https://{('example.com/en', 'www.example.com/en', 'a.net/es', 'b.net', 'c.org', 'd.io', 'e.org', 'f.org')[i % 8]}/p{i}"
    n = 400
    links = [(i, 4) for i in range(12, 60, 8)] + [(i, i + 8) for i in range(61, 200, 8)] + [(204, 212), (212, 220), (220, 204)]
    links += [(int(a), int(b)) for a, b in rng.integers(220, n, (110, 2)) if a % 8 > 2 or b % 3 == 0]
    pages_of = {i: "".join(f'<link rel="canonical" href="{host(b)}">' for a, b in links if a == i) for i in range(n)}
    given = spark.createDataFrame([(host(0), host(7)), (host(1), host(7)), (host(2), host(15)), (None, host(1)), (host(3), None)], "src string, dst string")
    table = spark.createDataFrame([(i, host(i), pages_of[i]) for i in range(n)], "page_id long, url string, html string")
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in [*links, (0, 7), (1, 7), (2, 15)]:
        root[find(a)] = find(b)
    own = ["block", "allow", "block", None, None, None, None, None]
    classes = {}
    for i in range(n):
        classes.setdefault(find(i), set()).add(own[i % 8])
    want = {i: own[i % 8] or ("block" if "block" in classes[find(i)] and "allow" not in classes[find(i)] else "allow") for i in range(n)}
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(table, RULES, redirects=given).collect()}
    assert got == want and sum(v == "block" and own[i % 8] is None for i, v in want.items()) > 10


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 7), (3, 1), *[(100 + i, 101 + i) for i in range(40)]]
    got = {(r["node"], r["component"]) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), *[(100 + i, 100) for i in range(41)]}


def test_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(i if i % 50 else None, "x" * int(rng.integers(0, 30)) if i % 7 else None, "hot" if i % 3 else f"s{i % 5}" if i % 2 else None) for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("clash"))
    got = shards.interleaved_shards(table, 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 1500 and sizes.max() - sizes.min() <= 1 and sorted(sizes.index) == list(range(7))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    share = got.groupby(["shard", "stratum"]).size().unstack(fill_value=0)
    spread = share.max() - share.min()  # every shard matches the mixture: by one row a stratum, the largest one by what the others leave
    assert spread.drop("shot").max() <= 1 and spread["shot"] <= share.shape[1]
    want = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert Counter(zip(got["size"], got["text_crc32"])) == want
    again = shards.interleaved_shards(table.repartition(5), 7).toPandas()
    assert Counter(map(tuple, again.astype(str).values)) == Counter(map(tuple, got.astype(str).values))
    assert shards.interleaved_shards(table.where("false"), 7).count() == 0


def test_shards_split_equal_rows(spark, monkeypatch):
    """Null and repeated keys of one text fill no cell, and their rows are spread over all shards."""
    monkeypatch.setattr(shards, "CELL_ROWS", 16)
    monkeypatch.setattr(shards, "SPAN", 4)
    rows = [(None, "same", "hot")] * 300 + [(7, f"t{i % 3}", "hot") for i in range(200)] + [(i, "x", "cold") for i in range(100)]
    got = shards.interleaved_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 6).toPandas()
    assert got.groupby("shard").size().tolist() == [100] * 6
    assert all(sorted(g["slot"]) == list(range(100)) for _, g in got.groupby("shard"))
    assert got[got["doc_id"].isna()].groupby("shard").size().min() > 30


def test_contamination_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    tests = [(str(i), " ".join(rng.choice(words, n))) for i, n in enumerate([20, 15, 5, 1, 13])] + [("n", None), ("e", "...")]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(20)]
    for i in range(0, 20, 3):
        texts[i] = texts[i][:60] + " " + tests[i % 3][1].upper().replace(" ", ", ") + " " + texts[i][:30]
    rows = [*enumerate(texts), (20, None), (21, ""), (22, texts[0]), (22, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash"))
    items = spark.createDataFrame(tests, "item_id string, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = Counter()
    for k, t in rows:
        own, hit, found = split(t), set(), set()
        for item, body in tests:
            q = split(body)
            n = min(13, len(q))
            windows = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else set()
            for i in range(len(own) - n + 1) if n else ():
                if tuple(own[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item)
        want[str(k), len(own), len(hit), tuple(sorted(found))] += 1
    for chunk in (1 << 20, 60):
        got = contamination.search(contamination.build_index(table), items, chunk_bytes=chunk)
        assert Counter((r["key"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == want
    kept = contamination.decontaminate(table, items)
    bad = {k for k, n, h, _ in want.elements() if h and 20 * h >= n}
    assert {str(r["doc_id"]) for r in kept.collect()} == {str(k) for k, _ in rows} - bad and kept.columns == ["doc_id", "text", "items"]


def test_pipeline_searches_and_decodes(spark):
    import corpus_pipeline as pipeline

    table = docs(spark)
    got = {r["doc_id"]: r for r in pipeline.tokens(spark, table, SF).collect()}
    alone = {r["doc_id"]: r for r in segment.encode(table, segment.Vocabulary.load()).collect()}
    assert len(got) == len(CASES) and all(r["round_trip"] for r in got.values())
    assert all(got[k]["nbest"] == alone[k]["nbest"] and got[k]["ids"] == alone[k]["ids"] for k in alone)
    assert max(len(r["nbest"]) for r in got.values()) == segment.NBEST


def test_proximity_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(9)]
    tests = [(str(i), " ".join(rng.choice(words, n))) for i, n in enumerate([16, 14, 4, 6, 1])]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(25)]
    for i in range(0, 25, 4):
        inner = tests[i % 2][1].split()
        for at in (10, 6, 3, 2)[: 1 + i // 4]:
            inner.insert(at, "extra")
        texts[i] = " ".join([*texts[i].split()[:10], *inner, *texts[i].split()[:5]])
    rows = [*enumerate(texts), (30, None), (31, tests[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(tests, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def holds(own, q, reach):  # q's words in order from own[0] on, within its first ``reach`` words
        rest = iter(own[:reach])
        return own[0] == q[0] and all(w in rest for w in q)

    want = {}
    for k, t in rows:
        own, found = (t or "").split(), set()
        for item, body in tests:
            q = body.split()
            n = min(13, len(q))
            if any(holds(own[i:], q[j : j + n], n + queries.SLOP) for j in range(len(q) - n + 1) for i in range(len(own))):
                found.add(item)
        want[k] = (len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    got = queries.queries()["op9_proximity"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_near"], r["near_sha256"]) for r in got} == want
    assert any(r["n_near"] > r["n_items"] for r in got) and all(r["n_near"] >= r["n_items"] for r in got)
    exact = {tuple(r) for r in queries.queries()["op9_decontamination"](spark, str(tmp_path)).collect()}
    assert {tuple(r)[:6] for r in got} == exact


def test_ranking_separates_junk(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(120):
        good = i % 2
        text = " ".join("".join(rng.choice(list("etaoinshr"), 5)) for _ in range(60)) + "." if good else "BUY!!! $$$ " * int(rng.integers(10, 40))
        rows.append((i, text))
        labels.append((i, good))
    rows += [(500, None), (501, ""), (None, "some text")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    model = ranking.train(table, marks, train_only=lambda k: ~ranking.held_out(k))
    got = {r["doc_id"]: r["score"] for r in ranking.score(table, model).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.3) == bool(i % 2) for i in held) and all(0 <= s <= 1 and not math.isnan(s) for s in got.values()) and len(got) == 123
    none = ranking.train(table, marks.where("false"))
    assert {round(r["score"], 9) for r in ranking.score(table, none).collect()} == {0.3}
    assert ranking.score(table.where("false"), model).count() == 0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(str(r[n]) for n in names) for r in df.collect()) == Counter(tuple(map(str, r)) for r in found.fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Each stage works on all its predecessor kept, and its decisions take effect."""
    import corpus_pipeline as pipeline

    read = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in rules.quality_votes(read).where("kept").collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, read, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, read = read, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_rules":
            assert {r["doc_id"] for r in read.collect()} == kept
        if name == "decontamination":
            hits = contamination.search(contamination.build_index(before), spark.read.parquet(f"{SF}/benchmark.parquet"))
            bad = {int(r["key"]) for r in hits.where("n_hit > 0 and 20 * n_hit >= n_words").collect()}
            assert bad and {r["doc_id"] for r in read.collect()} == {r["doc_id"] for r in before.collect()} - bad
        assert 0 < read.count() <= before.count() and set(before.columns) <= set(read.columns)
    assert "ids" in read.columns and json.dumps([name for name, _ in pipeline.STAGES])
