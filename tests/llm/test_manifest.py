"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from veritally.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank string, leaf string, tree int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4])
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes):
    """Root, and for every node the siblings on its way up: (digest or None, on the left)."""
    members, ways = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        above, joined = [], []
        for k in range(0, len(nodes), 2):
            both = nodes[k : k + 2]
            for i in members[k]:
                ways[i].append((both[1] if len(both) > 1 else None, False))
            for i in members[k + 1] if len(both) > 1 else []:
                ways[i].append((both[0], True))
            above.append(H(*both))
            joined.append(sum(members[k : k + 2], []))
        nodes, members = above, joined
    return nodes[0], ways


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    sub, ways = {}, {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub[name], ways[name] = grown([leaf(r) for r in trees[name]])
    root, top = grown([sub[n] for n in names])
    out = []
    for name, above in zip(names, top):
        for r, way in zip(trees[name], ways[name]):
            altered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            here = leaf(r, int(altered))
            for digest, left in way + above:
                here = H(here) if digest is None else H(digest, here) if left else H(here, digest)
            out.append((r[0], leaf(r), sub[name], root, H(*[d for d, _ in way + above if d]), here, here == root))
            assert out[-1][-1] != altered
    return out


def table(sizes, seed=1):
    """Rows of languages with the given numbers of leaves, and odd ones among them."""
    rng, rows, names = random.Random(seed), [], [None, "", "-", "de", "en", "é", "ｚ", "\U0001F600"]
    for name, n in zip(names, sizes):
        for _ in range(n):
            i = rng.randint(-9, 10**6)
            rows.append((i, rng.choice([None, "s", ""]), name, rng.choice([None, 0, i, 2**63 - 1]), rng.choice([None, "", "ü:" * 3, "long " * 50, f"t{i}"]), "x", "y", 5))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(1,), (2,), (5,), (1, 1), (1, 2, 3, 4, 5, 7, 8, 9), (600, 1, 257, 256, 0, 2), (0, 0, 0, 900)])
def test_manifest_is_the_plain_tree(spark, sizes):
    rows = table(sizes)
    # Repeated rows, one doc_id on several rows, and rows without a doc_id.
    rows += rows[:3] + [(r[0], "other", *r[2:]) for r in rows[:2]] + [(None, *r[1:]) for r in rows[:2]]
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_of_some_leaves(spark):
    """Only the asked leaves are returned; a changed row, sibling or root does not fold."""
    docs = spark.createDataFrame(table((300, 20, 1)), SCHEMA)
    made = manifest.write(docs.select("doc_id", "lang", manifest.leaf().alias("leaf")).drop("rank", "tree"), ["doc_id"], "lang", [])
    asked = made.leaves.where("rank % 37 = 5").select("tree", "rank")
    proofs = made.proofs(asked).withColumn("to", manifest.fold(F.col("digest"), F.col("proof")))
    rows = proofs.collect()
    assert len(rows) == asked.count() > 5 and {r["to"] for r in rows} == {made.root}
    wrong = proofs.select(manifest.fold(F.sha2("digest", 256), F.col("proof")).alias("to")).where(F.col("to") == made.root)
    assert wrong.count() == 0


def test_depth_of_segments(spark, monkeypatch):
    """The number of levels in a record changes no result."""
    rows = table((40, 9, 1, 2))
    want = sorted(brute(rows), key=repr)
    for levels in (1, 2, 3):
        monkeypatch.setattr(manifest, "SEGMENT", levels)
        assert sorted(map(tuple, manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == want
