import math
import random
import re
import unicodedata

import numpy as np

from siltstone.operators import corpus, dedup


def texts(df, key="record_id"):
    return {r[key]: r["text"] for r in df.collect()}


def test_three_sentences(spark):
    df = spark.createDataFrame([(1, "A.\nB.\nC."), (2, "A.\nB.\nC."), (3, "D.\nE.\nF."), (4, None), (5, None), (6, "")], "record_id long, text string")
    assert sorted(texts(corpus.ThreeSentenceDedupFilter()(df))) == [1, 3, 4, 6]


def pages(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, text string")


def test_line_stats_by_domain(spark):
    rows = [(i, f"https://example.com/{i}", f"Home | Blog\nOwn text {w}.\n© 202{i} Example Inc.") for i, w in enumerate(["alpha", "beta", "gamma"])] + [(9, "https://other.org/", "Home | Blog\nOther text")]
    got = texts(corpus.BoilerPlateLineStatsFilter()(pages(spark, rows)))
    assert got == {0: "Own text alpha.", 1: "Own text beta.", 2: "Own text gamma.", 9: "Home | Blog\nOther text"}


def test_line_stats_global_ratio_repeats_unicode_empty(spark):
    rows = [(1, "https://a.com", "Jump down\nOne"), (2, "https://b.com", "Jump down\nTwo")]
    assert texts(corpus.BoilerPlateLineStatsFilter(min_global_docs=2)(pages(spark, rows))) == {1: "One", 2: "Two"}
    rows = [(i, "https://a.com", "seldom shown" if i < 3 else "often shown" if i < 8 else "") for i in range(100)]
    got = texts(corpus.BoilerPlateLineStatsFilter()(pages(spark, rows)))
    assert got[0] == "seldom shown" and got[5] == ""
    long = "This is a rather long line of text, said twice."
    got = texts(corpus.BoilerPlateLineStatsFilter()(pages(spark, [(1, "https://a.com", f"{long}\nYes\n---\n}}\nYes\n{long}\n}}")])))
    assert got[1] == f"{long}\nYes\n---\n}}\nYes\n}}"
    rows = [(1, "https://a.com", "Ünter | Façade"), (2, "https://a.com", "Ünter | Façade"), (3, "https://a.com", unicodedata.normalize("NFD", "Ünter | Façade"))]
    assert set(texts(corpus.BoilerPlateLineStatsFilter()(pages(spark, rows))).values()) == {""}
    assert texts(corpus.BoilerPlateLineStatsFilter()(pages(spark, [(1, None, ""), (2, "https://a.com", None)]))) == {1: "", 2: ""}


def test_line_edits_keep_places(spark):
    """Against line after line: dropped keys go, and all after the first long line of a key."""
    from siltstone.functions.vectorised import line_keys

    rng = random.Random(5)
    pool = ["Alpha beta", "alpha  BETA!", "A rather long line of letters, alpha and beta", "a rather long line of letters alpha and beta", "12 34", "", "gamma"]
    for _ in range(200):
        text = "\n".join(rng.choice(pool) for _ in range(12))
        gone = {k for k in line_keys(text) if k and rng.random() < 0.2}
        want = []
        for i, (line, key) in enumerate(zip(text.split("\n"), line_keys(text))):
            before = [x for x, k in zip(text.split("\n")[:i], line_keys(text)) if k == key]
            if key == "" or (key not in gone and not any(len(x) >= 30 for x in before)):
                want.append(line)
        got = corpus._rewritten(text, [corpus._digest(k) for k in gone], 30)
        assert got == re.sub("\n{3,}", "\n\n", "\n".join(want)).strip()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_chained_stages_scan_once(spark, tmp_path):
    """Whatever the number of stages, the result reads the input once, and so does every pass on the way."""
    from siltstone.operators.filters import WordCountFilter
    from siltstone.plans.engine import DataEngine

    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(60)}", " ".join(rng.choice("abcdefgh") for _ in range(3)) + f"\nline {rng.randrange(90)}") for i in range(200)]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    url, doc, lines = dedup.URLDeduplicator("n"), dedup.DocumentDeduplicator("n"), dedup.ParagraphDeduplicator("n")
    for stages in ([url], [url, doc], [url, doc, lines], [url, lines, doc, url, lines]):
        got = dedup.DeduplicationStage(stages)(df)
        assert scans(got) == 1, stages
        one = df
        for s in stages:
            one = spark.createDataFrame(s(one).collect(), ROWS)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
    engine = DataEngine([WordCountFilter(5, 100), doc])
    got = engine(df)
    assert scans(got) == 1 and "regexp_count" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, doc(WordCountFilter(5, 100)(df)).collect()))


def test_long_documents_and_orders_without_value(spark):
    long = "\n".join(str(i % 30_000) for i in range(60_000))
    df = spark.createDataFrame([(1, "a", long), (2, "b", "5\nnew\n7"), (None, "c", "lost")], ROWS)
    got = texts(dedup.ParagraphDeduplicator("n")(df), "n")
    assert got[2] == "new" and got[1] == "\n".join(map(str, range(30_000))) and set(got) == {1, 2}
    assert sorted(r["n"] for r in dedup.URLDeduplicator("n")(df).collect()) == [1, 2]
    assert dedup.DeduplicationStage([dedup.URLDeduplicator("n"), dedup.ParagraphDeduplicator("n")])(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    """More rounds than a fixed bound of a few would allow."""
    n = 1 << 12
    order = list(range(n))
    random.Random(2).shuffle(order)
    path = spark.createDataFrame(list(zip(order, order[1:])) + [(None, 1), (7, None)], "u long, v long")
    got = dedup.components(path)
    assert got.count() == n and {r["root"] for r in got.select("root").distinct().collect()} == {0}


def test_fuzzy_job_goes_on(spark, tmp_path):
    from siltstone.plans.engine import fuzzy_job

    words = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(1, words), (2, words + " x"), (3, "other text")], "doc_id long, paragraph_text string").write.parquet(str(tmp_path / "in"))
    args = ["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--work", str(tmp_path / "work")]
    fuzzy_job(args, spark)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
    marks = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "work").glob("*/_SUCCESS")}
    assert {"shingles", "groups"} <= set(marks)
    fuzzy_job(args, spark)  # nothing is made again
    assert marks == {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "work").glob("*/_SUCCESS")}


def test_inverted_file_second_centres(spark):
    """The second centre is the one with the least spilled error, by its formula."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 8))
    s = dedup.SemanticDedup(k=6)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    c = s.train(df)
    got = {r["id"]: (r["part"], r["second"]) for r in s.assign(df, c).collect()}
    for i, v in enumerate(x):
        u = v / np.linalg.norm(v)
        first = int(np.argmax(c @ u))
        r = (u - c[first]) / np.linalg.norm(u - c[first])
        loss = [np.inf if k == first else ((u - c[k]) ** 2).sum() + ((u - c[k]) @ r) ** 2 for k in range(len(c))]
        assert got[i][0] == first and loss[got[i][1]] < min(loss) + 1e-4


def test_blacklist(spark):
    rows = [(1, "https://user:x@SUB.bad.com:8080/p"), (2, "https://notbad.com"), (3, None), (4, "bad.com/x"), (5, "http://bad.com")]
    df = spark.createDataFrame(rows, "id long, url string")
    want = [2, 3, 4]
    assert sorted(r["id"] for r in corpus.URLBlacklistFilter(["bad.com"])(df).collect()) == want
    listed = spark.createDataFrame([("BAD.com ",), (None,)], "domain string")
    assert sorted(r["id"] for r in corpus.URLBlacklistFilter(listed)(df).collect()) == want
    assert corpus.URLBlacklistFilter([])(df).count() == 5


ROWS = "n long, url string, text string"


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "a", "first"), (2, "a", "second"), (3, "b", "third"), (4, None, "x"), (5, None, "y")], ROWS)
    assert sorted(r["n"] for r in dedup.URLDeduplicator("n")(df).collect()) == [1, 3, 4, 5]
    df = spark.createDataFrame([(1, "a", "same"), (2, "b", "same"), (3, "c", "different")], ROWS)
    assert sorted(r["n"] for r in dedup.DocumentDeduplicator("n")(df).collect()) == [1, 3]


def test_paragraphs_and_chain(spark):
    df = spark.createDataFrame([(1, "a", "A\nB\nA"), (2, "b", "B\nC"), (3, "c", "A\nB"), (4, "d", None)], ROWS)
    assert texts(dedup.ParagraphDeduplicator("n")(df), "n") == {1: "A\nB", 2: "C"}
    df = spark.createDataFrame([(1, "a", "A\nB"), (2, "a", "ignored"), (3, "b", "A\nB"), (4, "c", "B\nC"), (5, "d", "B")], ROWS)
    stage = dedup.DeduplicationStage([dedup.URLDeduplicator("n"), dedup.DocumentDeduplicator("n"), dedup.ParagraphDeduplicator("n")])
    assert texts(stage(df), "n") == {1: "A\nB", 4: "C"}


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


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (60, 90)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        pairs = [p for p in pairs if p[0] != p[1]]
        got = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        assert got == union_find(pairs)
    chain = [(i, i + 1) for i in range(30)]
    assert {r["root"] for r in dedup.components(spark.createDataFrame(chain, "u long, v long")).collect()} == {0}
    assert dedup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fuzzy(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    one = base.copy()
    one[200] = "changed"
    two = one.copy()
    two[20] = "altered"
    other = [rng.choice(words) for _ in range(300)]
    rows = [(5, " ".join(base)), (2, " ".join(one)), (7, " ".join(two)), (3, " ".join(other)), (9, " ".join(other)), (10, None), (11, ""), (12, None)]
    df = spark.createDataFrame(rows, "doc_id long, paragraph_text string")
    assert sorted(r["doc_id"] for r in dedup.fuzzy_dedupe(df).collect()) == [2, 3, 10, 11, 12]


def test_fuzzy_against_brute_force(spark):
    """Pairs on both sides of 0.8: none below is united, none above is missed."""
    rng = random.Random(2)
    rows = []
    for i in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(base)))
        for k in rng.sample(range(200), 4 if i % 2 else 7):
            base[k] = "changed"
        rows.append((2 * i + 1, " ".join(base)))
    sets = [dedup.shingles(t, 5) for _, t in rows]
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i for i, root in union_find(pairs).items() if i != root}
    df = spark.createDataFrame(rows, "doc_id long, paragraph_text string")
    assert 20 < len(want) < 130 and {r["doc_id"] for r in dedup.fuzzy_groups(df).collect()} == want


def test_registered_signatures_and_edges(spark, tmp_path):
    """The queries against hashes taken one by one: 112 of them, 14 bands of 8."""
    import hashlib

    from siltstone import catalog

    rng = random.Random(9)
    rows = []
    for i in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows.append((3 * i, " ".join(base)))
        base[30] = "changed"
        rows += [(3 * i + 1, " ".join(base)), (3 * i + 2, " ".join(base[:40] + [f"v{rng.randrange(5000)}" for _ in range(20)]))]
    spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sigs = {}
    for i, t in rows:
        h = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % dedup.PRIME for s in dedup.shingles(t, 5)]
        sigs[i] = [min((a * x + b) % dedup.PRIME for x in h) for a, b in dedup.hash_family(112, 42)]
    got = {r["doc_id"]: r["sig"] for r in catalog.minhash_signature(spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(map(str, s)) for i, s in sigs.items()}
    want = set()
    for k in range(0, 112, 8):
        for i, s in sigs.items():
            least = min(j for j, o in sigs.items() if o[k : k + 8] == s[k : k + 8])
            want |= {(i, least)} if i != least else set()
    assert want and {tuple(r) for r in catalog.lsh_edges(spark, str(tmp_path)).collect()} == want


def test_registered_embedding(spark, tmp_path):
    from siltstone import catalog

    spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [len(r["embedding"]) for r in catalog.embed_text(spark, str(tmp_path)).collect()] == [768]


def test_semantic(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 64))
    rows, planted = [], set()
    for k in range(4):
        for i in range(120):
            v = centres[k] + rng.normal(size=64) * 0.35
            rows.append((f"{k}-{i:04d}", [float(x) for x in v]))
            if i % 30 == 0:
                rows.append((f"{k}-{i:04d}-copy", [float(x) for x in v + rng.normal(size=64) * 1e-3]))
                planted.add(f"{k}-{i:04d}-copy")
    rows += [("null", None), ("empty", []), ("zero", [0.0] * 64)]
    df = spark.createDataFrame(rows, "uuid string, embedding array<float>")
    for tile in (8192, 50):
        gone = {r["uuid"] for r in dedup.SemanticDedup(k=4, threshold=0.999, tile=tile).dropped(df).collect()}
        assert gone == planted
    assert dedup.SemanticDedup(k=4)(df.limit(0)).count() == 0


def test_semantic_across_borders(spark):
    """Pairs near the threshold in a cloud without clusters, which borders of parts cut everywhere."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 8))
    x = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in e]) for i, e in enumerate(x)], "uuid long, embedding array<float>")
    for threshold in (0.9, 0.8):
        u, w = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        want = {i for i, root in union_find(list(zip(u.tolist(), w.tolist()))).items() if i != root}
        got = {r["uuid"] for r in dedup.SemanticDedup(k=20, threshold=threshold).dropped(df).collect()}
        assert want and got == want


def test_signatures_estimate_similarity(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in range(40, 240))
    df = spark.createDataFrame([(1, a), (2, b)], "id long, text string")
    from pyspark.sql import functions as F

    s = [r["s"] for r in df.select(dedup.minhash_signature(F.col("text"), 512).alias("s")).collect()]
    same = sum(x == y for x, y in zip(*s)) / 512
    assert math.isclose(same, 156 / 236, abs_tol=0.1)
