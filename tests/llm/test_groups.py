"""Pages, vectors, mixing and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from veritally.llm import mixing, multi_index, wrappers

SF = "/root/testdata/sf0.001"


def page(host, title, paragraphs, ad="Buy now", broken=False):
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in title.split()[:5])
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    head = f"<p><b>{paragraphs[0]}<br>" if broken else ""
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        f'<header><p>{host}</p></header><nav><ul>{links}</ul></nav><div class="cookie-notice">We use cookies</div><!-- x <p> -->'
        f'<div class="ad">{ad}</div><div class="post"><h1>{title}</h1>{head}{body}<form><p>Sign up</p></form></div>'
        f'<aside><p>Side</p></aside><div id="comments"><p>I like it, and this goes on for long enough to matter</p></div>'
        f"<footer>&copy; {host} {title}</footer>" + ("" if broken else "</body></html>")
    )


def test_articles_come_out_whole(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        host = f"h{i % 3}.example.org" if i < 57 else f"single{i}.example.org"
        text = [" ".join(rng.choice("lorem ipsum dolor sit amet elit &amp; sed &lt;b&gt; do".split()) for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 6))]
        rows.append((i, f"https://{host}/a?{i}", page(host, f"Title {i} about things", text, f"ad {i}", broken=i % 7 == 0)))
        shown = [f"Title {i} about things"] + text[:1] * (i % 7 == 0) + text
        want[i] = "\n\n".join(t.replace("&amp;", "&").replace("&lt;b&gt;", "<b>") for t in shown)
    rows += [(100, None, rows[0][2]), (101, "", None), (102, "::", ""), (103, "http://x/", "<script>x"), (104, "http://x/", "bare  text\n here")]
    want |= {100: want[0], 101: "", 102: "", 103: "", 104: "bare text here"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS template")
    out = wrappers.extract_pages(df.union(df.where("page_id = 5")))
    got = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and Counter(r["page_id"] for r in got)[5] == 2
    for r in got:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]), r["page_id"]
    assert wrappers.extract_pages(df.limit(0)).count() == 0


def test_tree_matching_is_the_largest():
    """Against all order-keeping matchings of small trees."""
    rng = random.Random(3)

    def tree(depth):
        r = wrappers.Region(rng.choice(["div", "ul"]) if depth < 3 else "div")
        for _ in range(rng.randint(0, 3) if depth else 0):
            r.add(tree(depth - 1))
        return r

    def brute(a, b):
        if a.label != b.label:
            return 0

        def align(x, y):
            if not x or not y:
                return 0
            return max(align(x[1:], y), align(x, y[1:]), brute(x[0], y[0]) + align(x[1:], y[1:]) if brute(x[0], y[0]) else 0)

        return 1 + align(a.kids, b.kids)

    for _ in range(60):
        a, b = tree(3), tree(3)
        score, pairs = wrappers.matching(a, b, {})
        assert score == brute(a, b)
        assert score == (1 + sum(wrappers.matching(x, y, {})[0] for x, y in pairs) if score else 0)


def brute_vectors(rows):
    ids = [r[0] for r in rows]
    use = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, parent = Counter(), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(use):
        for j in use[:k]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(ids[i], least.get(top(i), ids[i]))
    return Counter((ids[i], links[i], least[top(i)], ids[i] == least[top(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [5, 1_024])
def test_vectors_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows, base = [], rng.standard_normal((40, 16))
    for i in range(500):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2, 0.35])
        rows.append((i, [float(x) for x in v.astype(np.float32)], 0))
    rows += [(1_000 + i, rows[0][1], 1) for i in range(30)]
    rows += [(2_000, None, 0), (2_001, [], 0), (2_002, [0.0] * 16, 0), (2_003, [None] + [1.0] * 15, 0), (2_004, [float("nan")] * 16, 0),
             (2_005, [float("inf")] * 16, 0), (2_006, [1.0] * 8, 0), (2_007, [2.0] * 8, 0), (2_008, [3e38] * 16, 0), (2_009, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS unit")
    got = Counter(tuple(r) for r in multi_index.near_vectors(df).collect())
    assert got == brute_vectors([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert multi_index.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("grids", [64, 1, 0])
def test_ids_that_are_shared_or_missing(spark, monkeypatch, grids):
    """One vec_id on two vectors, NULL ids, and lengths without a grid of their own lose no link."""
    monkeypatch.setattr(multi_index, "GRIDS", grids)
    e = lambda k, near=0.0, n=8: [near if i == (k + 1) % n else float(i == k) for i in range(n)]
    rows = [(1, e(0)), (1, e(3)), (2, e(0, 0.1)), (3, e(3, 0.1)), (4, e(6)), (None, e(6, 0.1)), (None, e(5, 0.1)), (None, e(5)), (None, None), (7, e(1, 0.0, 3)), (8, e(1, 0.1, 3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in multi_index.near_vectors(df).collect()), key=repr)
    assert got == sorted([
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (None, 1, 4, False),
        (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (7, 1, 7, True), (8, 1, 7, False),
    ], key=repr)


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = Counter(tuple(r) for r in multi_index.near_vectors(df).collect())
    assert got == brute_vectors([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_cells_are_walked_in_order():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(20), rng.random(30)
    cells = multi_index.walk(d1, d2, 0.7)
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells)
    assert len(cells) == max(1, int((d1[:, None] + d2 <= 0.7).sum()))


def test_mixture_stays_within_one_block(spark):
    sizes = {"a": 500, "b": 130, "c": 40, None: 25, "rare": 1, "x": 260}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"t{i}", s, "old"))
            i += 1
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, source string, mix_slot string")
    shares = {"a": 5, "b": 3, "c": 2, "x": 7, "unused": 4}
    out = mixing.mix(df, shares, block_rows=4).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((r["doc_id"], r["source"]) for r in df.collect())
    blocks = {(r["source"], r["mix_block"]): (r["mix_release"], r["mix_slot"], r["mix_deadline"]) for r in out}
    slots = sorted(s for _, s, _ in blocks.values())
    assert slots == list(range(len(blocks)))
    assert all(a <= s < d for a, s, d in blocks.values())
    # While all sources last, every prefix holds each source's share to less than one block.
    own = {s: shares.get(s, mixing.DEFAULT_SHARE) for s in sizes}
    count = {s: -(-(n + (s == "a")) // 4) for s, n in sizes.items()}
    frame = sum(own.values())
    whole = min(count[s] // own[s] for s in sizes) * frame
    order = {slot: s for (s, _), (_, slot, _) in blocks.items()}
    seen = Counter()
    for t in range(whole):
        seen[order[t]] += 1
        assert all(abs(seen[s] - (t + 1) * own[s] / frame) < 1 for s in sizes)
    # Blocks of a source come in order, rows of a block by their digest.
    for s in sizes:
        mine = sorted((b, slot) for (q, b), (_, slot, _) in blocks.items() if q == s)
        assert [x for _, x in mine] == sorted(x for _, x in mine) and len(mine) == count[s]
    assert mixing.mix(df.limit(0), shares).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0})


def test_mixing_is_native(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(df, {"src0": 3})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.limit(20).withColumn("doc_id", docs["doc_id"] + 50_000)
    odd = spark.createDataFrame([(90_000, None, None, None, None), (90_001, "", "en", "src1", 0), (90_002, "12 34", "en", None, 5),
                                 (None, "this text has no id but some words", "en", "src2", 3)], docs.schema)
    before = docs.union(copies).union(odd).selectExpr("*", "1 AS score", "2 AS node")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        rows, had = Counter(map(tuple, after.collect())), Counter(map(tuple, before.select(*columns).collect()))
        assert not rows - had, name
        if name == "mixing":
            assert rows == had
        if name == "language ID":
            assert not {90_000, 90_001, 90_002} & {r[0] for r in rows}
        if name == "n-gram Jaccard join":
            assert not any((r[0] or 0) >= 50_000 for r in rows) and len(rows) < len(had)
            assert any(r[0] is None for r in rows)
        # Nearly all plain documents stay in the filtering stages.
        if name in ("toxicity", "language ID"):
            assert sum(rows.values()) >= 0.8 * sum(had.values())
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in before.collect()) and all(r["round_trip"] for r in out)


def test_pipeline_over_nothing(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_hostile_pages_are_read_in_time():
    """Deep nesting, very many siblings, unclosed and stray tags: no recursion, no more than linear work."""
    import time

    start = time.monotonic()
    deep = "<body>" + "<div>" * 20_000 + "<p>Hello there text</p>" + "</div>" * 20_000
    wide = "<body>" + "".join(f"<div class=a{i % 7}><p>t {i}</p></div>" for i in range(4_000))
    stray = "<div>" * 5_000 + "</section>" * 5_000 + "<p>words here</p>" + "</div>" * 9_000
    template = wrappers.induce([deep, deep.replace("text", "texts"), wide, wide.replace("t 5", "u 5"), stray])
    again = wrappers._region(wrappers._plain(template))
    for t in (wrappers.Region("body"), template, again):
        assert wrappers.extract(deep, t) == "Hello there text"
        assert wrappers.extract(stray, t) == "words here"
        assert wrappers.extract(wide, t).count("\n\n") == 3_999
    assert time.monotonic() - start < 60


def test_templates_travel_whole():
    """A template comes back from its rows as it was."""
    rng = random.Random(3)

    def tree(depth):
        r = wrappers.Region(rng.choice(["div", "ul", "section"]), f'class="c{rng.randint(0, 3)}"')
        r.main, r.constant = rng.random() < 0.1, frozenset(rng.choice("abc") for _ in range(rng.randint(0, 2)))
        for _ in range(rng.randint(0, 4) if depth else 0):
            r.add(tree(depth - 1))
        return r

    def shape(r):
        return r.tag, r.label, r.around, r.main, r.constant, [shape(k) for k in r.kids]

    for _ in range(30):
        t = tree(4)
        assert shape(wrappers._region(wrappers._plain(t))) == shape(t)


def test_long_sibling_lists_are_matched_in_order(monkeypatch):
    """Beyond the limit the matching keeps order and labels, and finds what is equal."""
    monkeypatch.setattr(wrappers, "MOST_CHILDREN", 10)
    rng = random.Random(5)
    for _ in range(40):
        a, b = wrappers.Region("body"), wrappers.Region("body")
        for r in (a, b):
            for _ in range(rng.randint(15, 40)):
                r.add(wrappers.Region("div", f'class="c{rng.randint(0, 4)}x"'))
        score, pairs = wrappers.matching(a, b, {})
        places = [(a.kids.index(p), b.kids.index(q)) for p, q in pairs]
        assert all(p.label == q.label for p, q in pairs) and score == 1 + len(pairs) and len(pairs) > 5
        assert places == sorted(places) and len({i for i, _ in places}) == len({j for _, j in places}) == len(places)
        assert wrappers.matching(a, wrappers._copy(a), {})[0] == 1 + len(a.kids)


def test_rare_layouts_of_a_large_host_are_known(spark, monkeypatch):
    """What repeats is counted over all pages: a layout of a few percent is not missed, copies count once."""
    rng = random.Random(7)
    rows, want = [], {}

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    for i in range(300):
        text = [words(30) for _ in range(3)]
        rare = i % 30 == 0
        body = "".join(f"<p>{t}</p>" for t in text)
        if rare:
            html = f"<body><div class=r><div><p>Read our other pages in the evening</p></div><div class=x>{body}</div></div>"
        else:
            html = f"<body><div class=a><p>All rights of this host are kept</p>{body}<p>{i}</p></div>"
        want[i] = "\n\n".join(text + ([] if rare else [str(i)]))
        rows.append((i, f"http://one.example.org/{i}", html))
    # Copies of one article repeat its blocks, which does not make them template.
    copy = words(40), words(5)
    for i in range(300, 700):
        rows.append((i, f"http://one.example.org/{i}", f"<body><div class=a><p>All rights of this host are kept</p><p>{copy[0]}</p><p>{copy[1]}</p></div>"))
        want[i] = "\n\n".join(copy)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()} == want
    # A host too large for one template reads the same.
    monkeypatch.setattr(wrappers, "HOST_REGIONS", 1)
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()} == want
