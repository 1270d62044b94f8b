import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest


from gridloam.llm import neardup, queries
from gridloam.llm.components import components

from .cases import documents

SF = "/root/testdata/sf0.001"


def multiset(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x20\\x09-\\x0D]+", folded)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute(rows, least=0.8):
    """{id: class} by comparing all pairs of different multisets."""
    sets = [(i, multiset(t)) for i, t in rows]
    df = Counter(s for _, m in sets for s in m)
    n = sum(1 for _, m in sets if m)
    idf = {s: 1 + math.log((n + 1) / (d + 1)) / math.log(n + 1) for s, d in df.items()}
    kinds = {}
    for i, m in sets:
        if m:
            kinds.setdefault(frozenset(m.items()), []).append(i)
    nodes = [(dict(k), ids) for k, ids in kinds.items()]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][0], nodes[b][0]
            if x.keys() & y.keys():
                low = sum(min(x.get(s, 0), y.get(s, 0)) * idf[s] for s in x.keys() | y.keys())
                high = sum(max(x.get(s, 0), y.get(s, 0)) * idf[s] for s in x.keys() | y.keys())
                if low >= (least - 1e-12) * high:
                    root[find(a)] = find(b)
    groups = defaultdict(list)
    for a, (_, ids) in enumerate(nodes):
        groups[find(a)] += [i for i in ids if i is not None]
    out = {i: i for i, _ in rows if i is not None}
    for ids in groups.values():
        out |= {i: min(ids) for i in ids}
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def planted(n_groups=12, seed=4):
    """Copies, near copies of several distances, chains, and texts that only share a passage."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    for g in range(n_groups):
        base = [word() for _ in range(rng.randrange(3, 300))]
        rows.append(" ".join(base))
        rows.append("  ".join(base).upper())
        for k in range(5):
            rows.append(" ".join(edited(rng, base, max(1, len(base) * k // 60))))
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 1 + len(chain) // 80)
            rows.append(" ".join(chain))
        rows.append(" ".join(passage + [word() for _ in range(rng.randrange(4, 60))]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("texts", [4096, 6])
def test_classes_against_brute_force(spark, monkeypatch, texts):
    monkeypatch.setattr(neardup, "GROUP_TEXTS", texts)
    rows = planted()
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", chunk_bytes=20_000).collect()}
    assert got == brute(rows)


def test_hard_cases(spark):
    df = documents(spark)
    got = neardup.classes(df).collect()
    assert len(got) == df.count()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == brute(rows)
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]
    assert neardup.classes(df.where("false")).count() == 0


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op10_neardup(spark, SF).collect()}
    assert got == brute(rows)


def test_samples_collide_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 56, 100, dtype=np.uint64)
    x, y = rng.random(100) + 0.1, rng.random(100) + 0.1
    x[:70] = y[:70]
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    sig = neardup.samples(np.tile(keys, 2), np.concatenate([x, y]), np.array([0, 100]), 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
