import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone.functions import vectorised as V
from siltstone.operators import detectors as d
from siltstone.operators import extract as x
from siltstone.operators import models as m
from siltstone.plans import engine as e
from siltstone.sources import loaders as io
from siltstone.sources import warc


@pytest.mark.parametrize("page", ["<pre><code>print(1)</code></pre>", "<pre><code>List&lt;Item&gt; a = b;</code></pre>", "<table><tbody><code>x = 1</code></tbody></table>"])
def test_code(page):
    assert d.html_has_code(page)


@pytest.mark.parametrize("page", [None, "", "<pre><code>hello world</code></pre>", "<p><code>print(1)</code></p>", "<!-- <pre><code>print(1)</code></pre> -->"])
def test_no_code(page):
    assert not d.html_has_code(page)


@pytest.mark.parametrize(
    "page",
    [
        "<math><mi>x</mi></math>",
        '<span class="math-formula">x^2</span>',
        '<math><semantics><mi>x</mi><annotation encoding="application/x-tex">\\frac{1}{2}</annotation></semantics></math>',
        '<script type="math/tex">\\sqrt{2}</script>',
        '<script type="math/mml"><math><mi>x</mi></math></script>',
    ],
)
def test_math(page):
    assert d.html_has_math(page)


@pytest.mark.parametrize("page", [None, "", "<p>x + y = z</p>", "<math></math>", '<span class="math-formula">\\frac{1}{2</span>', '<span class="math-formula">x</span><span class="math-formula">{</span>', "<math><foo>x</foo></math>", "<!-- <math><mi>x</mi></math> -->"])
def test_no_math(page):
    assert not d.html_has_math(page)


def flags(spark, test, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(test(F.col("t"))).collect()]


def test_ai_flags(spark):
    assert flags(spark, d.ai_phrase, ["As an AI language model, I cannot feel.", "Well. I'm sorry, but I cannot provide that.", "Regenerate response", "I met an AI model once, as an AI user.", "", None]) == [True, True, True, False, False, False]
    stock = "Let's dive into it: it is worth noting that a tapestry of ideas, a testament to work, will pave the way for more."
    assert flags(spark, d.ai_style, [stock, "It is worth noting, without further ado.", stock + " word" * 2000, "", None]) == [True, False, False, False, False]
    assert flags(spark, d.ai_trace, ['<a href="?utm_source=chatgpt">', '<a href="?utm_source%3Dchatgpt">', '<p data-start="1" data-end="2">', "<p data-is-last-node>", '<a href="?utm_source=newsletter">', '<p data-start="1">', None]) == [True] * 4 + [False] * 3


PAGE = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>News</h1><p>Residents planted apple trees along the old road this spring.</p><ul><li>One</li><li>Two</li></ul><p>There are free workshops&nbsp;for everyone who would like to join in.</p><pre>a\n  b</pre></article><footer>© us</footer><script>var marker=1</script></body></html>"


def test_extractors(spark):
    for name in ("resiliparse", "trafilatura"):
        df = x.ExtractHTML(name)(spark.createDataFrame([(PAGE,), (None,), ("",)], "html string"))
        got = [r["text"] for r in df.collect()]
        assert "Residents planted apple trees" in got[0] and "free workshops" in got[0] and "marker" not in got[0] and got[1] is None and got[2] == ""
    assert "- One\n- Two" in x.html_to_text(PAGE) and "a\n  b" in x.html_to_text(PAGE) and "Home" not in x.html_to_text(PAGE)
    assert "<nav>" not in x.EXTRACTORS["magic-html"]()(PAGE)
    assert x.html_to_text("<nav><nav>a</nav>menu left</nav><p>Main</p>") == "Main"
    assert x.html_to_text("<p>a</p><script>if (1 < 2) { '</p>' }</script><p>b &lt; c</p><style>p {}") == "a\n\nb < c"
    assert x.clean_html("<p>x</p><aside><div><aside>y</aside></div>z</aside><svg/><p>w</p>") == "<p>x</p><p>w</p>"
    with pytest.raises(ValueError, match="Extractor not available: unknown"):
        x.ExtractHTML("unknown")


def test_encoding():
    assert [V.fix_mojibake(t) for t in ["cafÃ©", "FranÃ§ais", "Already correct.", "", None, "naïve café"]] == ["café", "Français", "Already correct.", "", None, "naïve café"]
    assert x.decode_page("é".encode()) == "é" and x.decode_page(b'<meta charset="latin-1">\xe9').endswith("é") and x.decode_page(None) is None and x.decode_page(b"\xe9") == "é"
    assert x.decode_page(b"\x89PNG\r\n\x1a\n\x00\x00\xff") is None and x.decode_page(b"") == ""


def test_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["", "hello world", "こんにちは", None, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [t.encode(v or "", add_special_tokens=False).ids for v in texts]
    assert [r["input_ids"] for r in x.Tokenize()(df).orderBy("i").collect()] == want
    assert [r["num_tokens"] for r in x.TokenCounter()(df).orderBy("i").collect()] == list(map(len, want))
    assert x.plain_form("Café\n\n\n\nFrançais") == "cafe\n\nfrancais"
    joined = x.FastTextTokenize()(spark.createDataFrame([("Hello   World\tbye",)], "text string")).first()["tokens"]
    assert joined == " ".join(t.encode("hello   world\tbye", add_special_tokens=False).tokens)


def test_pii(spark):
    df = spark.createDataFrame([("Write to a.b@c-d.org or +49 30 1234567 from 10.0.0.1.",), (None,), ("nothing",)], "text string")
    assert [r[0] for r in x.PIIAnonymizer()(df).collect()] == ["Write to <EMAIL_ADDRESS> or <PHONE_NUMBER> from <IP_ADDRESS>.", None, "nothing"]


def test_models(spark):
    df = spark.createDataFrame([(0, "The cat is in the house and it is warm"), (1, "Der Hund ist nicht in dem Haus und die Katze auch"), (2, "Le chat est dans la maison et il dort"), (3, ""), (4, None)], "i int, text string")
    assert [r["language"] for r in m.Whichlang()(df).orderBy("i").collect()] == ["eng", "deu", "fra", "eng", "eng"]
    assert m.LanguageID()(df).orderBy("i").first()["language"] == "__label__eng_Latn"
    nsfw = m.NSFW(lambda: lambda ts: [0.9 if "Hund" in t else 0.1 for t in ts])
    assert [r["nsfw_score"] for r in nsfw(df).orderBy("i").collect()] == [0.1, 0.9, 0.1, 0.0, 0.0]
    ai = m.AIContentScorer(lambda: lambda ts: [{"AI": 0.0, "human": 0.0} for _ in ts])
    assert [r["ai_score"] for r in ai(df).orderBy("i").collect()] == [0.5, 0.5, 0.5, 0.0, 0.0]
    v = [r["embedding"] for r in m.EmbedText(dim=32, truncate_dim=16)(df).orderBy("i").collect()]
    assert len(v[0]) == 16 and abs(sum(a * a for a in v[0]) - 1) < 1e-5 and not any(v[3])
    gen = m.GenerateText(lambda: lambda ps: [json.loads(p)[-1]["content"].upper() for p in ps], "Say it", truncate_to=3)
    assert [r["response"] for r in gen(df).orderBy("i").collect()] == ["THE", "DER", "LE ", "", ""]


def test_models_load_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4()}"), "w").close()
        return lambda ts: [t.upper() for t in ts]

    df = spark.createDataFrame([(f"t{i}",) for i in range(64)], "text string").repartition(16)
    stage = m.ModelStage(load, "string")
    for _ in range(3):
        assert stage(df).filter("output like 'T%'").count() == 64
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert 0 < len(loads) == len(set(loads))  # never twice in one process, in 48 tasks


def test_trained_classifier(spark):
    rows = [("the cat sat in the house", "en"), ("die Katze saß in dem Haus", "de"), ("where is the old mill", "en"), ("wo ist die alte Mühle", "de"), (None, "en"), ("x", None)] * 5
    model = m.fit_classifier(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    df = spark.createDataFrame([(0, "the old house"), (1, "das alte Haus"), (2, None), (3, "")], "i int, text string")
    got = [r["language"] for r in m.Whichlang(load=m.trained(model))(df).orderBy("i").collect()]
    assert got[:2] == ["en", "de"] and got[2] == got[3]
    p = [r["nsfw_score"] for r in m.NSFW(m.trained(model, "de"))(df).orderBy("i").collect()]
    assert p[0] < 0.5 < p[1] and p[2] == p[3] == 0


def test_contracts(spark):
    df = spark.createDataFrame([('{"level": 7}', '{"topics": ["algebra", "logic_foundations"]}'), ('{"level": 8}', '{"topics": ["algebra", "algebra"]}'), ("{}", '{"topics": []}'), (None, '{"topics": ["cooking"]}'), ("x", None)], "a string, b string")
    got = df.select(m.parsed_level(F.col("a")), m.parsed_topics(F.col("b"))).collect()
    assert [r[0] for r in got] == [7, None, None, None, None] and [r[1] for r in got] == [["algebra", "logic_foundations"], None, [], None, None]


def test_generated_queries(spark):
    docs = spark.createDataFrame([(1, "t"), (2, None)], "doc_id long, text string")
    out = e.generate_queries(docs, ["p1"], lambda: lambda asked: ['{"query": "q"}' if i == 0 else "no" for i, _ in enumerate(asked)])
    assert out.columns == ["doc_id", "text", "persona", "response", "query"] and {r["query"] for r in out.coalesce(1).collect()} <= {"q", None}
    scored = e.edu_scores(docs, lambda: lambda asked: ['{"reasoning": "r", "score": 9}' for _ in asked])
    assert [(r["reasoning"], r["score"]) for r in scored.collect()] == [(None, None)] * 2


def test_probe(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), (None,), ([1.0],)], "e array<float>")
    p = [r[0] for r in df.select(m.linear_probe(F.col("e"), [[1.0, -0.5]], [0.0], "binary", 1)).collect()]
    assert p == [0.5, 0.5, None, None]
    two = df.select(m.linear_probe(F.col("e"), [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0], "multiclass", 1)).first()[0]
    assert abs(two - 0.7310585786) < 1e-9
    model = m.AttributeModel({"weights": [[1.0, -0.5]], "bias": [0.0], "task": "multilabel", "labels": ["good"]}, "good", "e")
    assert model(df).first()["good_score"] == 0.5
    with pytest.raises(ValueError):
        m.linear_probe(F.col("e"), [[1.0]], [0.0], "other", 0)


def test_prompts_and_ocr(spark):
    assert m.clip_prompt("abcdef", 4) == "abcd" and m.clip_prompt("a b c d", None, lambda t: len(t.split()), 10, 4, 3) == "a b c "
    df = spark.createDataFrame([('{"reasoning": "ok", "score": 4}',), ('{"score": 9}',), ("no",), (None,)], "r string")
    assert [r[0] and r[0]["score"] for r in df.select(m.parsed_quality(F.col("r"))).collect()] == [4, None, None, None]
    assert m.without_picture_blocks('a\n\n<img src="images/bbox_1">\n\nb') == "a\n\nb"
    text = "x" * 8000 + "y" + "ab " * 60
    assert V.trim_repeats(text) == "x" * 8000 + "y" + "ab " and V.trim_repeats("short " * 5) == "short " * 5 and V.trim_repeats(None) is None


def test_engine_and_runner(spark, tmp_path):
    double = lambda df: df.withColumn("v", F.col("v") * 2)
    inner = e.DataEngine([double], "inner")
    outer = e.DataEngine().add(inner).add(double)
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert [r["v"] for r in outer(df).orderBy("v").collect()] == [4, 8] and "inner" in repr(outer)
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    out = e.JobRunner.from_args(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")]).run(spark, outer)
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [4, 8]
    parts = [e.JobRunner(str(tmp_path / "in"), str(tmp_path / "t"), i, 5).run(spark, outer) for i in range(5)]
    assert sum(p is not None for p in parts) == 2
    assert e.json_arg('{"a": 1}') == {"a": 1}


def test_qa_pairs(spark):
    rows = [(1, 1, None, 5, 11, "T", "Q"), (2, 1, None, 4, None, "T", "low"), (11, 2, 1, 0, None, None, "accepted"), (12, 2, 1, 5, None, None, "liked"), (13, 2, 1, 4, None, None, "no"), (14, 2, 1, None, None, None, "no"), (15, 2, 2, 9, None, None, "no")]
    posts = spark.createDataFrame(rows, "id long, post_type_id int, parent_id long, score int, accepted_answer_id long, title string, text string")
    assert {(r["answer"], r["accepted"]) for r in e.qa_pairs(posts).collect()} == {("accepted", True), ("liked", False)}


def test_personas(spark):
    p = spark.createDataFrame([("Nurse", "p1"), ("Baker", "p2"), (None, "p3")], "occupation string, professional_persona string")
    assert [r["professional_persona"] for r in e.find_personas(p, ["nurse"]).collect()] == ["p1"] and e.find_personas(p, []).count() == 0
    got = e.persona_prompts(spark.createDataFrame([(1, "t"), (2, None)], "doc_id long, text string"), ["p1", "p2"])
    assert {r["persona"] for r in got.collect()} <= {"p1", "p2"}
    with pytest.raises(ValueError):
        e.persona_prompts(p, [])
    assert spark.createDataFrame([('{"query": "q"}',)], "r string").select(e.query_of(F.col("r"))).first()[0] == "q"


def test_loaders_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id long, name string")
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        df.coalesce(1).write.format(fmt).option("header", "true").save(path)
        got = io.LOADERS[fmt]().read_data(spark, path)
        assert sorted((int(r["id"]), r["name"]) for r in got.collect()) == [(1, "Alice"), (2, "Bob")] and "source_path" not in got.columns
    files, done = tmp_path / "files", str(tmp_path / "done")
    spark.createDataFrame([(1,), (2,)], "id long").coalesce(1).write.parquet(str(files / "a"))
    load = lambda c=done: io.ParquetLoader(checkpoint_path=c, file_path_column_name="path")
    one = load()
    assert sorted(r["id"] for r in one.read_data(spark, str(files)).collect()) == [1, 2]
    one.commit()
    spark.createDataFrame([(3,)], "id long").coalesce(1).write.parquet(str(files / "b"))
    two = load()
    rows = two.read_data(spark, str(files)).collect()
    assert [r["id"] for r in rows] == [3] and "/b/" in rows[0]["path"]
    two.commit()
    assert load().read_data(spark, str(files)).count() == 0
    assert load(str(tmp_path / "fresh")).read_data(spark, str(files)).count() == 3
    with pytest.raises(ValueError):
        io.ParquetLoader(checkpoint_on="id")
    with pytest.raises(RuntimeError):
        io.LanceLoader().read_data(spark, "x")
    with pytest.raises(RuntimeError):
        io.HuggingFaceLoader().read_data(spark, "x")


def test_finished_files_are_not_opened(spark, tmp_path):
    files, done = tmp_path / "files", str(tmp_path / "done")
    spark.createDataFrame([(1,), (2,)], "id long").coalesce(1).write.parquet(str(files / "a"))
    one = io.ParquetLoader(checkpoint_path=done)
    assert one.read_data(spark, str(files)).count() == 2
    one.commit()
    for f in (files / "a").glob("*.parquet"):
        f.write_bytes(b"no longer readable")
    spark.createDataFrame([(3,)], "id long").coalesce(1).write.parquet(str(files / "b"))
    two = io.ParquetLoader(checkpoint_path=done, schema="id long")
    df = two.read_data(spark, str(files))
    assert [r["id"] for r in df.collect()] == [3] and len(df.inputFiles()) == 1
    two.commit()
    assert io.ParquetLoader(checkpoint_path=done, schema="id long").read_data(spark, str(files)).count() == 0
    keyed = io.JsonLoader(checkpoint_path=str(tmp_path / "keys"), checkpoint_on="id")
    spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string").write.json(str(tmp_path / "json"))
    assert keyed.read_data(spark, str(tmp_path / "json")).count() == 2
    keyed.commit()
    assert io.JsonLoader(checkpoint_path=str(tmp_path / "keys"), checkpoint_on="id").read_data(spark, str(tmp_path / "json")).count() == 0


def test_storage(tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n in ("d/a.warc", "d/e/b.warc.gz", "d/c.txt"):
        (tmp_path / n).write_bytes(b"x" * len(n))
    names = lambda p: [(os.path.relpath(f, tmp_path), n) for f, n in io.list_files(p, (".warc", ".warc.gz"))]
    assert names(str(tmp_path / "d")) == [("d/a.warc", 8), ("d/e/b.warc.gz", 13)] == names(f"file://{tmp_path}/d")
    assert names(str(tmp_path / "d" / "*.warc")) == [("d/a.warc", 8)] and names(str(tmp_path / "d" / "a.warc")) == [("d/a.warc", 8)]
    assert names(str(tmp_path / "none")) == []


def record(kind, body, uri="https://a.example/"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record("resource", b"Hello, world!") + record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\xc3\xa9</p>"))
    with gzip.open(tmp_path / "b.warc.gz", "wb") as f:
        f.write(record("response", b"<p>\xe9</p>"))
    df = warc.read_warc(spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 3 and "source_path" not in df.columns
    assert [bytes(r["warc_content"]) for r in rows if r["WARC-Type"] == "resource"] == [b"Hello, world!"]
    assert sorted(r["html"] for r in warc.WarcProcessor()(df).collect()) == ["<p>é</p>", "<p>é</p>"]
    assert "path" in io.WarcLoader(file_path_column_name="path").read_data(spark, str(tmp_path)).columns


def test_posts_xml(spark, tmp_path):
    (tmp_path / "Posts.xml").write_text('<?xml version="1.0"?><posts><row Id="1" PostTypeId="1" Score="5" Title="T" Body="&lt;p&gt;Hello there&lt;/p&gt;" /><row Id="2" PostTypeId="2" ParentId="1" Body="&lt;p&gt;Hi&lt;/p&gt;" /><row Id="3" PostTypeId="5" Body="x" /></posts>')
    posts = io.read_posts_xml(spark, str(tmp_path / "Posts.xml"))
    got = e.posts_to_text(posts, 2, 100)
    assert [(r["id"], r["text"], r["parent_id"]) for r in got.collect()] == [(1, "Hello there", None)]
    io.write_parquet(got, str(tmp_path / "out"), partition_by="post_type_id")
    assert os.path.isdir(tmp_path / "out" / "post_type_id=1") and io.list_files(str(tmp_path / "out"), (".parquet",))


def test_streams(spark, tmp_path):
    from siltstone.operators.filters import WordCountFilter
    from siltstone.streaming import ingest

    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    spark.createDataFrame([(1, "a b c"), (2, "a")], "id long, text string").coalesce(1).write.parquet(src)
    run = lambda: ingest.ingest_new_files(spark, src, "id long, text string", WordCountFilter(2, 10), sink, ck)
    run()
    spark.createDataFrame([(3, "x y")], "id long, text string").coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 3]
    stream = spark.readStream.schema("k string, ts timestamp, bad boolean").parquet(src)
    assert ingest.first_seen(stream, "k", "ts").isStreaming and ingest.text_rates(stream, "ts", "bad").columns == ["window", "rows", "flagged"]


def test_stream_states(spark, tmp_path):
    """Windows are given out once the watermark has passed them, late rows of closed ones are left out, keys are kept once."""
    from siltstone.streaming import ingest

    src = tmp_path / "events"
    kind = "k string, ts timestamp, bad boolean"

    def feed(name, rows):
        spark.createDataFrame([(k, t, b) for k, t, b in rows], "k string, t string, bad boolean").selectExpr("k", "cast(t as timestamp) as ts", "bad").coalesce(1).write.parquet(str(src / name))

    def run(stream, name):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    def read():
        return spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(src))

    feed("1", [("a", "2024-01-01 10:05:00", True), ("b", "2024-01-01 10:40:00", False), ("a", "2024-01-01 11:10:00", False), (None, None, None)])
    assert run(ingest.text_rates(read(), "ts", "bad"), "rates").count() == 0  # the watermark is two hours behind
    seen = run(ingest.first_seen(read(), "k", "ts"), "seen")
    assert sorted(r["k"] for r in seen.filter("k is not null").collect()) == ["a", "b"]
    feed("2", [("c", "2024-01-01 15:00:00", True), ("b", "2024-01-01 15:01:00", False)])
    run(ingest.text_rates(read(), "ts", "bad"), "rates")
    feed("3", [("d", "2024-01-01 10:30:00", True), ("e", "2024-01-01 15:30:00", False)])  # the first is too late
    got = run(ingest.text_rates(read(), "ts", "bad"), "rates")
    assert sorted((r["window"]["start"].hour, r["rows"], r["flagged"]) for r in got.selectExpr("window", "rows", "flagged").collect()) == [(10, 2, 1), (11, 1, 0)]
    seen = run(ingest.first_seen(read(), "k", "ts"), "seen")
    assert sorted(r["k"] for r in seen.filter("k is not null").collect()) == ["a", "b", "c", "d", "e"]


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
