"""Operators over documents against plain Python, with every odd case at once."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veritally.llm import language_id, lm_scoring, outliers, shingle_join, toxicity
from veritally.llm.common import HashTable, crc_mod

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string"
WORD = r"[^\x20\x09-\x0d]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs anywhere, empty, blank, short, long, unspaced and repeated texts, repeated rows, clashing columns."""
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \t\n ", "one", "two words", "a b c d e", "A b C d E", "12 34 !!", "ünïcödé ÄÖÜ 日本語 \U0001F600 x y z"]
    texts += base + base[:3] + [b.replace(b.split()[30], "zzz", 1) for b in base[:4]] + [base[0].upper()]
    texts += ["x" * 50_000, " ".join(base) + "\n" + " ".join(base), "word " * 3_000, "l1\nl1\nl2\n\nl1 \nl1"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, i, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base[1], None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sets_of(rows):
    out = []
    for r in rows:
        w = re.findall(WORD, lower(r["text"]))
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        out.append((r["doc_id"], frozenset(s)))
    return out


def brute_join(rows):
    docs = sets_of(rows)
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            b = docs[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(s), least.get(top(i)) if s else d) for i, (d, s) in enumerate(docs))


def test_shingle_join_is_brute_force(odd, given):
    for df in (odd, given.union(odd.select(*given.columns).where("doc_id IS NOT NULL").withColumn("doc_id", odd["doc_id"] + 100_000))):
        got = Counter(tuple(r) for r in shingle_join.shingle_join(df).collect())
        assert got == brute_join(df.select("doc_id", "text").collect())


def test_shared_and_missing_ids_lose_no_link(spark):
    """Different texts under one doc_id, and near (not exact) copies of which one or all have no doc_id."""
    def text(group, *changed):
        return " ".join(f"x{i}" if i in changed else f"g{group}w{i}" for i in range(60))

    rows = []
    for k in range(0, 40, 4):
        # One doc_id for two unlike texts, each with a near copy of its own.
        rows += [(k, text(k)), (k, text(k + 1)), (1_000 + k, text(k, 30)), (2_000 + k, text(k + 1, 20))]
        # Near copies without a doc_id, of a document and of each other.
        rows += [(3_000 + k, text(k + 2)), (None, text(k + 2, 10)), (None, text(k + 3)), (None, text(k + 3, 59))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in shingle_join.shingle_join(df).collect())
    assert got == brute_join(df.collect())
    _, links = shingle_join.similarity_links(df)
    assert links.distinct().count() == 40


@pytest.mark.parametrize("common", [2, 8])
def test_common_values_lose_no_link(spark, monkeypatch, common):
    """Chains and crowds of copies through the path for common values: pivots, then blocks."""
    monkeypatch.setattr(shingle_join, "COMMON", common)
    monkeypatch.setattr(shingle_join, "BLOCK", 7)
    rng = random.Random(common)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for group in range(3):
        words = [f"g{group}w{i}" for i in range(90)]
        for copy in range(25):
            own = list(words)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(90)] = f"x{rng.random()}"
            texts.append(" ".join(own))
            if copy % 5 == 0:
                words = own
    texts += [" ".join(f"r{d}x{i}" for i in range(rng.randint(5, 60))) + " " + passage for d in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter(tuple(r) for r in shingle_join.shingle_join(df).collect())
    assert got == brute_join(df.collect())


def test_signatures_of_linked_sets_meet():
    """The guarantee itself, over random pairs right at the threshold."""
    rng = np.random.default_rng(1)
    for n in [1, 2, 4, 7, 9, 12, 20, 33, 64, 150, 400, 1500]:
        for _ in range(30):
            m = max(1, math.ceil(0.75 * n)) if rng.random() < 0.3 else n
            both = math.ceil(75 * (n + m) / 175)
            if both > min(n, m):
                continue
            ids = rng.integers(0, 2**64, n + m - both, dtype=np.uint64)
            a, b = np.unique(ids[:n]), np.unique(np.concatenate((ids[:both], ids[n:])))
            assert shingle_join.linked(both, n, m)
            band = int(np.searchsorted(shingle_join.BANDS, max(n, m), "right")) - 1
            (x, sure_x), (y, sure_y) = shingle_join.signatures(a, band), shingle_join.signatures(b, band)
            assert len(np.intersect1d(x, y)) >= max(sure_x, sure_y)
            assert shingle_join.hamming(shingle_join.bit_sketch(a).tobytes(), shingle_join.bit_sketch(b).tobytes()) <= n + m - 2 * both


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert shingle_join.shingle_join(none).count() == 0
    assert outliers.quality(none).count() == 0
    assert lm_scoring.lm_scoring(none).count() == 0
    assert language_id.language_id(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels).where("predicted = 1").count() == 0


def test_language(spark, odd, given):
    model = language_id.fit(given.where(crc_mod("doc_id", 4) != 2))
    out = language_id.identify(given, model).where(crc_mod("doc_id", 4) == 2).where("length(text) > 80").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out) > 20
    assert sum(r["rejected"] for r in out) <= 0.02 * len(out)
    extra = odd.withColumnRenamed("lang", "lang_pred").withColumnRenamed("n_chars", "rejected")
    rows = language_id.identify(extra, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert letters or (r["rejected"] and r["score"] == 0)


def test_short_texts_of_no_language_are_rejected(spark, given):
    """Random letters and an unlearned language, though calibration texts are short and of differing lengths."""
    rng = random.Random(3)
    short = given.where("text IS NOT NULL").selectExpr("doc_id", "IF(doc_id % 2 = 0, text, substr(text, 1, 20 + doc_id * 37 % 180)) AS text", "lang")
    model = language_id.fit(short.where(crc_mod("doc_id", 4) != 2))
    syllables = ["wzy", "szcz", "krz", "dło", "bąk", "gwo", "mię", "pły", "chu", "jak"]

    def text(kind, size):
        word = {
            "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))),
            "unlearned": lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))),
        }[kind]
        out = word()
        while len(out) < size:
            out += " " + word()
        return out

    rows = [(k, kind, text(kind, size)) for kind in ("letters", "unlearned") for size in (50, 100, 200, 500) for k in range(25)]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, kind string, text string"), model).collect()
    for kind in ("letters", "unlearned"):
        own = [r["rejected"] for r in out if r["kind"] == kind]
        assert sum(own) >= 0.95 * len(own)
    clean = language_id.identify(short, model).where(crc_mod("doc_id", 4) == 2).where("length(text) > 40").collect()
    assert sum(r["rejected"] for r in clean) <= 0.05 * len(clean)


def test_every_language_has_a_model(spark, monkeypatch):
    """Languages beyond one batch are predicted too, and batches change no result."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøå"
    rows = []
    for lang in range(70):
        own = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(12)]
        rows += [(len(rows) + k, " ".join(rng.choice(own) for _ in range(40)), f"l{lang:02}") for k in range(6)]
    rows.append((len(rows), "одно слово и ещё одно слово", "single"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    found = []
    for batch in (100, 64):
        monkeypatch.setattr(language_id, "BATCH_LANGUAGES", batch)
        models = language_id.fit(df, 200_000 * batch, 100_000 * batch)
        assert sum(len(m.langs) for m in models) == 71
        found.append({r["doc_id"]: r for r in language_id.identify(df, models).collect()})
    one, two = found
    for i, _, lang in rows:
        assert one[i]["lang_pred"] == two[i]["lang_pred"] == lang
        assert one[i]["score"] == pytest.approx(two[i]["score"], rel=1e-4)


def test_language_models_are_distributions(given):
    """After every context the stored characters' probabilities and the share of unseen ones sum to 1."""
    import pandas as pd

    counts = pd.concat(language_id._count_grams([given.where("lang = 'en'").limit(30).select("lang", "text").toPandas()]))
    model = language_id.Models(counts.groupby(["lang", "gram"])["n"].sum().reset_index())
    letters = sorted({g[-1] for g in counts["gram"]})
    for context in ["the ", "of and", "in", "zzz"]:
        total = 0.0
        for c in letters:
            with_c, without = model.surprisal([context + "t" + c])[0], model.surprisal([context + "t"])[0]
            total += np.exp(-(with_c - without)[0, 0])
        # Spaces at the end of a text merge with nothing, so every letter is one more prediction.
        assert 0.9 < total <= 1.0 + 1e-6


def test_toxic_sentences_are_found(spark):
    rng = random.Random(2)
    bad = ["grumbo", "fnarl", "zwick"]

    def doc(toxic):
        parts = [" ".join(rng.choice(["sun", "moon", "tree", "lake", "bird", "stone"]) for _ in range(8)) for _ in range(rng.randint(1, 9))]
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] += " " + rng.choice(bad) + ("***" if rng.random() < 0.5 else "")
        return ". ".join(parts) + "."

    rows = [(i, doc(i % 4 == 0), int(i % 4 == 0)) for i in range(1_200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5_000, None), (5_001, ""), (5_002, "!!! ...")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 0), (9_999, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs.withColumnRenamed("x", "y"), labels).collect()}
    assert len(out) == 1_203
    for i, text, toxic in rows:
        assert out[i]["predicted"] == toxic, text
        assert out[i]["held_out"] == (crc(i) % 5 == 0)
        for s in out[i]["offending"]:
            assert any(b in text[s["start"] : s["start"] + s["length"]] for b in bad)
        assert not toxic or out[i]["offending"]
    assert all(out[i]["score"] == 0 and out[i]["sentences"] == 0 for i in (5_000, 5_001, 5_002))


def test_lm_base_scores(odd, given):
    for df in (odd, given):
        rows = df.select("doc_id", "text").collect()
        tokens = [re.findall(WORD, lower(r["text"])) + [None] for r in rows]
        held = [crc(r["doc_id"]) % 5 == 1 for r in rows]
        c = Counter(t for ts, h in zip(tokens, held) for t in ts if not h)
        n, v = sum(c.values()), len(c)
        want = Counter()
        for r, ts, h in zip(rows, tokens, held):
            base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
            want[(r["doc_id"], h, len(ts), sum(c[t] > 0 for t in ts), n, round(base, 2))] += 1
        out = lm_scoring.lm_scoring(df).collect()
        assert Counter((*[r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")], round(r["base_score"], 2)) for r in out) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    fresh = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)


@pytest.mark.parametrize("dictionary", [0, 16, 1 << 18])
def test_lm_with_and_without_a_dictionary(given, monkeypatch, dictionary):
    """Base scores do not depend on what the dictionary holds, and repeat texts score alike."""
    monkeypatch.setattr(lm_scoring.fit_counts, "__defaults__", (dictionary,))
    monkeypatch.setattr(lm_scoring, "HOLD_TOKENS", 5_000)
    out = lm_scoring.score(given.union(given), crc_mod("doc_id", 5) == 1).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((round(r["base_score"], 2), round(r["score"], 2), r["n_known"]))
    assert all(len(x) == 2 and x[0] == x[1] for x in by.values())
    c = Counter(t for r in given.collect() if crc(r["doc_id"]) % 5 != 1 for t in re.findall(WORD, lower(r["text"])) + [None])
    n, v = 2 * sum(c.values()), len(c)
    for r in given.limit(20).collect():
        base = sum(math.log10((2 * c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in re.findall(WORD, lower(r["text"])) + [None])
        assert by[r["doc_id"]][0][0] == pytest.approx(base, abs=0.02)


@pytest.mark.parametrize("dictionary", [0, 16, 1 << 18])
def test_lm_base_scores_are_exact(odd, given, monkeypatch, dictionary):
    """Double precision, whatever the dictionary holds."""
    monkeypatch.setattr(lm_scoring.fit_counts, "__defaults__", (dictionary,))
    for df in (odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), given):
        rows = {r["doc_id"]: re.findall(WORD, lower(r["text"])) + [None] for r in df.collect()}
        c = Counter(t for i, ts in rows.items() if crc(i) % 5 != 1 for t in ts)
        n, v = sum(c.values()), len(c)
        for r in lm_scoring.lm_scoring(df).collect():
            want = math.fsum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in rows[r["doc_id"]])
            assert r["base_score"] == pytest.approx(want, rel=1e-12)


def brute_lm(rows, held):
    """The whole model over plain dictionaries: score per row, with weights learned from unrounded estimates."""
    tokens = [re.findall(WORD, lower(t)) for t in rows]
    pairs = [list(zip([0, *ts], [*ts, 1])) for ts in tokens]
    c2 = Counter(p for ps, h in zip(pairs, held) if not h for p in ps)
    c1 = Counter(w for ps, h in zip(pairs, held) if not h for _, w in ps)
    cv = Counter(v for ps, h in zip(pairs, held) if not h for v, _ in ps)
    n, once = sum(c1.values()), sum(k == 1 and w != 1 for w, k in c1.items())
    uniform = 1 / (len(c1) + once + 1)
    klass = lambda v: min(int(math.log2(cv[v] + 1)), lm_scoring.CLASSES - 1)
    mix = {}
    for k in {klass(v) for v, _ in c2}:
        cells = [((c - 1) / max(cv[v] - 1, 1), max(c1[w] / n - 1 / n, 0), uniform, c) for (v, w), c in c2.items() if klass(v) == k]
        m = [0.4, 0.5, 0.1]
        for _ in range(lm_scoring.EM_STEPS):
            new = [0.0] * 3
            for *p, c in cells:
                s = sum(a * b for a, b in zip(m, p))
                for j in range(3):
                    new[j] += m[j] * p[j] / s * c
            m = [(x + y) / (sum(new) + 2) for x, y in zip(new, (0.5, 1.0, 0.5))]
        mix[k] = m
    rest = [0.4, 0.5, 0.1]
    for _ in range(lm_scoring.EM_STEPS):
        rest = [0.25, 0.5, 0.25]
    mix[0] = [0.0, rest[0] + rest[1], rest[2]]

    def one(ps):
        total = 0.0
        for v, w in ps:
            m = mix.get(klass(v), mix[0])
            total += math.log10(m[0] * c2[(v, w)] / max(cv[v], 1) + m[1] * c1[w] / n + m[2] * uniform)
        return total

    return [one(ps) for ps in pairs]


def test_lm_scores_are_the_whole_model(given):
    """Up to the rounding of estimates that the tasks send, and of the histogram the weights are learned from."""
    rows = sorted(given.collect(), key=lambda r: r["doc_id"])
    want = brute_lm([r["text"] for r in rows], [crc(r["doc_id"]) % 5 == 1 for r in rows])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scoring(given).collect()}
    for r, w in zip(rows, want):
        assert got[r["doc_id"]] == pytest.approx(w, rel=0.01, abs=0.05)


@pytest.mark.parametrize("dictionary", [0, 16, 300])
def test_lm_scores_do_not_depend_on_the_dictionary(given, monkeypatch, dictionary):
    """A word outside the dictionary has its own estimate too."""
    want = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scoring(given).collect()}
    monkeypatch.setattr(lm_scoring.fit_counts, "__defaults__", (dictionary,))
    monkeypatch.setattr(lm_scoring, "HOLD_TOKENS", 5_000)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scoring(given).collect()}
    assert got == {k: pytest.approx(x, rel=1e-6) for k, x in want.items()}


@pytest.mark.parametrize("parts", [16, 1_000])
def test_lm_rows_between_tasks_follow_the_tokens(monkeypatch, parts):
    """More partitions do not mean a batch for every row, nor a sum for every document and partition."""
    class Task:
        partitionId = staticmethod(lambda: 0)
        get = classmethod(lambda cls: cls)

    class Given:
        def __init__(self, value):
            self.get = lambda: value

    monkeypatch.setattr(lm_scoring, "TaskContext", Task)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in (400 * rng.random(30) ** 3).astype(int)) for _ in range(500)]
    rows = pa.RecordBatch.from_pydict({"doc_id": range(500), "text": texts, "held_out": [i % 5 == 1 for i in range(500)]})
    (words,) = lm_scoring._count_words(iter([rows]))
    h, n = (x.to_numpy() for x in words.columns)
    most = np.flatnonzero(n > 20)
    counts = lm_scoring.Counts(h.view(np.uint64)[most], n[most], 500, 15_500, len(h) + 1, int((n == 1).sum()), parts)
    sent = list(lm_scoring._send(Given(counts))(iter([rows])))
    packed = sum(x.num_rows for x in sent)
    assert packed <= parts + 1 and len(sent) <= 1 + packed // 100
    entries = sum(sum(x.column("entries").drop_null().to_pylist()) for x in sent)
    assert 10_000 < entries <= 15_500
    found = list(lm_scoring._find(Given(counts))(iter(sent)))
    assert len(found) <= 5 + packed // 100
    scored = [x for x in found if x.column("kind")[0].as_py() < 2]
    model = np.tile([0.5, 0.4, 0.1], (lm_scoring.CLASSES, 1)), counts.uniform()
    sums = list(lm_scoring._sum(Given(model))(iter(scored)))
    assert len(sums) <= 1 + packed // 100
    # Before, each row had a sum for every document of its flush.
    assert sum(sum(x.column("entries").drop_null().to_pylist()) for x in sums) <= entries


def test_lm_holds_more_for_more_partitions():
    def hold(parts):
        return lm_scoring.Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1, 1, 0, parts).hold()

    assert hold(16) == hold(512) == lm_scoring.HOLD_TOKENS
    assert all(hold(parts) // parts >= 250 for parts in (512, 700, 2_000, 8_000))


def test_small_probabilities_are_kept():
    p = 2.0 ** -np.arange(0, 63, 0.37)
    assert np.allclose(lm_scoring._value(lm_scoring._fixed(p).astype("<u2")), p, rtol=4e-4)
    assert lm_scoring._value(lm_scoring._fixed(np.zeros(1)).astype("<u2"))[0] == 0


def brute_counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover)


def test_quality_counts(spark, odd, given):
    texts = {r["text"] for r in odd.collect()}
    for df in (odd, given):
        out = outliers.quality(df).collect()
        want = Counter((r["doc_id"], *brute_counts(r["text"])) for r in df.collect())
        assert Counter((r["doc_id"], *[r[c] for c in outliers.STATS[:5]]) for r in out) == want
        for r in out:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert None in texts


def test_outliers_of_a_group_go(spark, given):
    """Many plain texts, some buried in symbols: only those go, whichever source they are in."""
    rng = random.Random(4)

    def plain():
        return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 300)))

    rows = [(i, plain(), "en", "big" if i % 4 else "small") for i in range(1_600)]
    rows += [(10_000 + i, plain().replace(" ", "### $$$ "), "en", "big") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r["kept"] for r in outliers.quality(df).collect()}
    assert all(out[i] for i in range(1_600)) and not any(out[10_000 + i] for i in range(40))


def test_moderate_outliers_go(spark):
    """A fifth of symbols, half the lines repeated or words twice as long are enough, in groups of their own and pooled ones."""
    rng = random.Random(6)

    def lines(n=12, size=(2, 9), symbols=0.0):
        def word():
            w = "".join(rng.choice("abcdefg") for _ in range(rng.randint(*size)))
            return "#" * max(1, len(w) // 3) + w if rng.random() < symbols else w

        return [" ".join(word() for _ in range(rng.randint(6, 7))) for _ in range(n)]

    odd = [lambda: lines(symbols=1.0), lambda: (x := lines(6)) + [y for y in x for _ in range(2)][:6], lambda: lines(size=(9, 15))]
    # Least size of an estimate is 100; the sources of "de" are smaller, but not all of them together.
    groups = [("en", "big", 600), ("en", "least", 110), *[("de", f"s{i}", 40) for i in range(8)]]
    rows, bad = [], set()
    for lang, source, n in groups:
        for i in range(n):
            kind = i % 20
            if kind < len(odd):
                bad.add(len(rows))
            rows.append((len(rows), "\n".join(odd[kind]() if kind < len(odd) else lines()), lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = outliers.quality(df).collect()
    judged = {r["doc_id"]: r["kept"] for r in out if not r["base_failed"]}
    assert len(bad & judged.keys()) >= 0.6 * len(bad) and not any(judged[i] for i in bad & judged.keys())
    assert sum(not judged[i] for i in judged.keys() - bad) <= 0.01 * len(judged)


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 5_000, dtype=np.uint64))
    keys = np.unique(np.concatenate((keys, np.array([0, 2**64 - 1], np.uint64))))
    table = HashTable(keys)
    asked = np.concatenate((keys, rng.integers(0, 2**64, 5_000, dtype=np.uint64)))
    place = {int(k): i for i, k in enumerate(keys)}
    assert table.find(asked).tolist() == [place.get(int(a), -1) for a in asked]
    assert (HashTable(keys[:0]).find(asked) == -1).all()
