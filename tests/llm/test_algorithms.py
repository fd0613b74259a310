"""Groups, neighbours, leakage and mixture against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from siltstone.llm import components, leakage, mixture, neighbours
from siltstone.llm.tokens import count_tokens
from siltstone.operators import blocks


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("bound", [3, 40, 1_000_000])
def test_groups(spark, bound):
    rng = random.Random(bound)
    far = 1 << 60
    pairs = [(far + rng.randrange(300), far + rng.randrange(300)) for _ in range(220)]
    pairs += [(i, i + 1) for i in range(150)] + [(5000, 5000 + i) for i in range(120)]  # a chain and a hub
    rng.shuffle(pairs)
    rows = [(u, v, "x") for u, v in pairs] + [(v, u, "y") for u, v in pairs[:50]] + [(7777, None, None), (None, 8888, None), (None, None, None), (9, 9, None)]
    df = spark.createDataFrame(rows, "u long, v long, root string").repartition(5)
    got = {r["record_id"]: r["group_id"] for r in components.connected_groups(df, bound=bound).collect()}
    assert got == union_find(pairs) | {7777: 7777, 8888: 8888}


def test_groups_hot_and_empty(spark):
    hub = spark.range(1, 30_001).selectExpr("id as u", "0L as v")
    got = components.connected_groups(hub, bound=1000)
    assert got.count() == 30_001 and {r["group_id"] for r in got.select("group_id").distinct().collect()} == {0}
    assert components.connected_groups(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(vectors, k, least):
    ids = sorted(vectors)
    m = np.stack([vectors[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    pairs = set()
    for r in range(len(ids)):
        for c in sorted(range(len(ids)), key=lambda j: (-round(s[r, j], 6), ids[j]))[:k]:
            if s[r, c] >= least:
                pairs.add(tuple(sorted((ids[r], ids[c]))))
    return pairs


def vector_rows(seed=1, copies=0):
    rng = np.random.default_rng(seed)
    v = {f"id{i:04d}": rng.normal(size=12) + 4 * np.eye(12)[i % 12] for i in range(300)}
    for i in range(copies):
        v[f"same{i:03d}"] = v["id0000"]
    return v


@pytest.mark.parametrize("least", [0.5, 0.9, -1.0])
def test_neighbours_exact(spark, least, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 40)
    v = vector_rows()
    rows = [(i, [float(x) for x in e], 1) for i, e in v.items()]
    rows += rows[:9] + [("n", None, 1), ("e", [], 1), ("z", [0.0] * 12, 1), ("s", [1.0] * 6, 1), (None, [1.0] * 12, 1), ("nan", [float("nan")] * 12, 1)]
    df = spark.createDataFrame(rows, "uuid string, embedding array<float>, cid int")
    got = {tuple(r) for r in neighbours.similar_pairs(df, k=5, least=least).collect()}
    assert got == brute(v, 5, least)


def test_equal_vectors(spark):
    v = vector_rows(copies=40)
    df = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in v.items()], "uuid string, embedding array<float>")
    near = neighbours.most_similar(df, k=3, least=0.99).collect()
    group = sorted(i for i in v if i.startswith("same")) + ["id0000"]
    first = sorted(group)[:4]
    for i in group:
        assert [r["other"] for r in sorted((r for r in near if r["uuid"] == i), key=lambda r: r["rank"])] == [x for x in first if x != i][:3]
    assert neighbours.most_similar(df.limit(0)).count() == 0
    assert neighbours.most_similar(df.limit(1)).count() == 0


def test_quantised_bound():
    rng = np.random.default_rng(0)
    a, b = (blocks.unit(rng.normal(size=(50, 64))) for _ in "ab")

    def side(v):
        codes, rest, scale = blocks.quantise(v)
        return blocks.Side(pd.DataFrame({"part": [0], "ids": [list(range(len(v)))], "codes": [codes.tobytes()], "rest": [rest.tobytes()], "scale": [scale.tobytes()]}), 64)

    sa, sb = side(a), side(b)
    near, off = blocks.product(sa, slice(0, 50), sb, slice(0, 50))
    assert (np.abs(near - a @ b.T) <= off[:, None]).all()
    whole = sa.codes.astype(int) @ sb.codes.astype(int).T
    assert (whole == (sa.number @ sb.number.T)).all()
    assert np.abs(sa.vectors(np.arange(50)) - a).max() < 1e-7


W = [f"wort{i}" for i in range(400)]


def leak_case():
    rng = random.Random(4)
    items = [(i, " ".join(rng.sample(W, 30))) for i in range(20)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(120):
        words = [rng.choice(W) for _ in range(80)]
        if d % 3 == 0:
            item = items[d % 20][1].split()
            size = 11 if d % 2 else 12
            at = rng.randrange(len(item) - size)
            words[20:20] = ["Xx"] + [w.upper() + ("," if rng.random() < 0.3 else "") for w in item[at : at + size]] + ["xX"]
        docs.append((d, "\n".join(words) if d % 5 else " ".join(words)))
    return docs + [(500, None), (501, ""), (502, "…")], items


def brute_leaks(docs, items, run=12):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, t2 in items:
            x = leakage.words(t2)
            if any(tuple(x[j : j + run]) in have for j in range(len(x) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("slice_words", [100, 1_000_000])
def test_leaks(spark, slice_words):
    docs, items = leak_case()
    d = spark.createDataFrame(docs + docs[:4], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    want = brute_leaks(docs, items)
    assert want and {tuple(r) for r in leakage.leaked_documents(d, i, slice_words=slice_words).collect()} == want
    assert leakage.leaked_documents(d.limit(0), i).count() == 0 and leakage.leaked_documents(d, i.limit(0)).count() == 0


def test_edited_leak(spark):
    item = "a barge leaves the old harbour with forty crates of slate and meets a second barge carrying thirty crates before the evening bell"
    words = item.split()
    for i in (7, 15, 20):
        words[i] = "changed"
    d = spark.createDataFrame([(1, "Before it. " + " ".join(words) + " after it."), (2, "nothing of it here at all")], "doc_id long, text string")
    i = spark.createDataFrame([(7, item)], "item_id long, item_text string")
    got = leakage.leaked_items(d, i).collect()
    assert [tuple(r) for r in got] == [(7, 0, 1)]


def test_edited_leaks_in_many_documents(spark):
    """An edit of an item in more documents than any cap, and one beside a rarer edit of the same item."""
    rng = random.Random(6)
    items = [(i, " ".join(rng.sample(W, 40))) for i in range(3)]

    def edit(item, first):
        w = items[item][1].split()
        for k in range(first, len(w), 8):
            w[k] = "changed"
        return " ".join(w)

    docs = [(d, f"w{d} " + edit(0, 3)) for d in range(1100)] + [(2000 + d, f"v{d} " + edit(1, 7 if d < 2 else 3)) for d in range(22)]
    docs += [(3000 + d, " ".join(items[2][1].split()[:8] + rng.sample(W, 60))) for d in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    assert sorted(tuple(r) for r in leakage.leaked_items(d, i).collect()) == [(0, 0, 1100), (1, 0, 22)]
    assert leakage.leaked_passages(d, i).filter("item_id = 2").count() == 30
    assert leakage.leaked_documents(d, i).count() == 0


def test_align():
    a = np.array([9, 1, 2, 3, 4, 9, 5, 6])
    assert leakage.align(a, np.array([1, 2, 3, 4, 5, 6])) == (11, 4)
    assert leakage.align(a, np.array([7, 8])) == (0, 0)


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, s, " ".join(rng.choice(W) for _ in range(rng.randrange(5, 40)))) for i, s in enumerate(["big"] * 900 + ["mid"] * 90 + ["tiny"] * 6)]
    docs += [(5000, "big", None), (5001, "big", ""), (5002, None, "x y"), (5003, "no target", "x y"), (None, "big", "x")] + docs[:5]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumnRenamed("doc_id", "doc_id")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 4), ("tiny", 0.1, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixture.mixture_report(d, t).collect()}
    total = sum(r["tokens"] for r in report.values())
    assert set(report) == {"big", "mid", "tiny", "none"} and report["none"]["used_tokens"] == 0
    assert report["tiny"]["used_tokens"] == min(3 * report["tiny"]["tokens"], report["tiny"]["budget"])
    assert report["mid"]["budget"] == min(4 * report["mid"]["tokens"], round(0.5 * (total)))
    for r in report.values():
        assert 0 <= r["budget"] - r["used_tokens"] < 400
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-6
    chosen = mixture.mix_sources(d, t).collect()
    cap = {"big": 1, "mid": 4, "tiny": 3}
    assert all(1 <= r["copies"] <= cap[r["source"]] for r in chosen) and len({r["doc_id"] for r in chosen}) == len(chosen)
    small = {r["doc_id"] for r in mixture.mix_sources(d, t, total=2000).filter("source = 'big'").collect()}
    large = {r["doc_id"] for r in mixture.mix_sources(d, t, total=6000).filter("source = 'big'").collect()}
    assert small and small < large  # thresholds nest
    assert mixture.mix_sources(d.limit(0), t).count() == 0 and mixture.mix_sources(d, t.limit(0)).count() == 0


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, "k"), (3, "", None)], "id int, text string, tokens2 string")
    assert {r["id"]: r["tokens"] for r in count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0}


@pytest.mark.parametrize("every, least", [(12, 1.0), (8, 1.0), (6, 0.95)])
def test_recall_of_edited_copies(spark, every, least):
    """Items copied with every n-th word changed, by turns replaced, left out and doubled, among texts that share their phrases."""
    rng = random.Random(every)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(60)]
    docs = [(9_000 + k, " ".join(rng.choice(vocabulary) for _ in range(30)) + " " + " ".join(items[k % 60][1].split()[5:11])) for k in range(1_200)]
    for i, t in items:
        w = t.split()
        for n, at in enumerate(range(every - 1, len(w), every)):
            w[at] = (rng.choice(vocabulary), "", f"{w[at]} {w[at]}")[n % 3]
        docs.append((i, " ".join(x for x in w if x)))
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    got = {r["item_id"]: r["verbatim_docs"] + r["edited_docs"] for r in found.collect()}
    assert sum(n == 1 for n in got.values()) >= least * 60 and max(got.values()) == 1
