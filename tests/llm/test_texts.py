"""Pages, markup, quality, abuse, pairs and languages on small inputs, and how well what is trained does on what it hasn't seen."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language, markup, pages, pairs, quality, toxicity

DATA = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# ---- 2


def test_blocks():
    page = "<html><head><title>A &amp; B</title><p>no</head><body><!-- c <p>x --><p>One&nbsp; <b>two</b>\n three<br>four<p>five<script>var x='<p>no</p>'</script></p><pre>a\n b</pre><noscript>no</noscript><ul><li><a href='#'>L</a><li>M</ul>&#233;"
    title, bs = pages.blocks(page)
    assert title == "A & B" and [b.text for b in bs] == ["One two three four", "five", "a b", "L", "M", "é"]
    assert bs[3].link == 1 and bs[4].link == 0 and bs[0].path[-1] == "p"
    assert pages.blocks(None) == ("", []) and pages.blocks("")[1] == [] and pages.blocks("   ")[1] == []
    assert [b.text for b in pages.blocks("x<script>never closed <p>y")[1]] == ["x"]
    assert pages.block_md5("") == "d41d8cd98f00b204e9800998ecf8427e" and pages.block_md5("é") == hashlib.md5(b"\xc3\xa9").hexdigest()


def test_pages_against_held_out_teacher(spark):
    rows = [r["html"] for r in table(spark, "warc_pages").filter("html <> ''").select("html").distinct().collect()]
    parsed = [pages.blocks(h) for h in sorted(rows)]
    teacher = pages.Teacher(parsed)
    x, y = [pages.features(*p) for p in parsed], [teacher.label(*p) for p in parsed]
    cut = int(len(x) * 0.8)
    model = pages.Labeller().fit(x[:cut], y[:cut], rounds=12, size=16)
    said = np.concatenate([p >= 0.5 for p in model.predict(x[cut:])])
    true = np.concatenate(y[cut:]) > 0
    assert (said & true).sum() / max(1, said.sum()) > 0.9 and (said & true).sum() / true.sum() > 0.9
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", parsed and rows[0]), ("c", rows[0]), (None, rows[0])], "warc_record_id string, html string")
    got = pages.main_blocks(df, model)
    assert {r["warc_record_id"] for r in got.collect()} <= {"c"} and got.count() == got.distinct().count()
    assert pages.main_text(df, model).count() == 2  # the empty page and the page, once
    assert pages.main_blocks(df.limit(0), model).count() == 0


def invented_site(rng, n, pages_each=8):
    """Pages of one invented host with their true main blocks: the layout, names and furniture are the host's own."""
    word = lambda: "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    box, menu, foot, crumb = f"c-{word()}", [line(1, 3) for _ in range(6)], [line(3, 8) for _ in range(2)], line(1, 2)
    aside = [line(2, 5) for _ in range(4)]
    out = []
    for k in range(pages_each):
        title = line(4, 8).capitalize()
        body = [line(15, 40).capitalize() + "." for _ in range(rng.integers(3, 8))]
        nav = "".join(f"<li><a href='/{i}'>{m}</a></li>" for i, m in enumerate(menu))
        side = "".join(f"<li><a href='#'>{x}</a></li>" for x in aside)
        text = "".join(f"<p>{b}</p>" for b in body)
        end = "".join(f"<p>{f}</p>" for f in foot)
        html = f"<html><head><title>{title}</title></head><body><div class='top'><ul>{nav}</ul></div><div class='{box}'><h1>{title}</h1>{text}</div><div class='rail'><h3>{crumb}</h3><ul>{side}</ul></div><div class='bottom'>{end}</div></body></html>"
        out.append((html, (f"host{n}.test", f"https://host{n}.test/{k}"), {title, *body}))
    return out


def test_pages_of_unseen_hosts():
    """Trained on some hosts, asked about others, against bodies known from how the pages were made."""
    rng = np.random.default_rng(8)
    sites = [invented_site(rng, n) for n in range(40)]
    seen = [p for s in sites[:30] for p in s]
    model = pages.train([p[0] for p in seen], [p[1] for p in seen])
    hit = said = true = 0
    for html, _, body in (p for s in sites[30:] for p in s):
        title, bs = pages.blocks(html)
        got = {b.text for b, q in zip(bs, model.predict([pages.features(title, bs)])[0]) if q >= 0.5}
        hit, said, true = hit + len(got & body), said + len(got), true + len(body)
    assert hit / said > 0.95 and hit / true > 0.95


def test_words_and_steps_beyond_the_first():
    """Blocks that differ only after their twelfth word, or only far up the path, don't look the same."""
    one, two = ("w " * 20 + x for x in ("alpha beta", "beta alpha"))
    assert set(pages._text(one)[1].tolist()) != set(pages._text(two)[1].tolist())
    path = ("html", "body", "div.main", "div", "div", "div", "div", "p")
    assert set(pages._tag_keys(path, frozenset()).tolist()) != set(pages._tag_keys(("html", "body", "div.side", *path[3:]), frozenset()).tolist())


def test_page_sample_has_several_pages_of_each_host(spark):
    rows = [(f"r{h}-{k}", "<p>x</p>", f"https://h{h}.test/{k}") for h in range(30) for k in range(12)] + [("n", "<p>y</p>", None), (None, "<p>z</p>", "https://h1.test/")]
    df = spark.createDataFrame(rows, "warc_record_id string, html string, warc_target_uri string")
    got = pages.sample_pages(df, "warc_record_id", "html", "warc_target_uri", 40)
    assert len(got) == 40 and got["host"].nunique() <= 6 and got["i"].is_unique


def test_labeller_gradients():
    """The backward pass against differences."""
    rng = np.random.default_rng(0)
    batch = [([np.array([3, 5]), np.array([7])], [np.array([1]), np.array([2, 4])], rng.normal(size=(2, pages.DENSE)).astype(np.float32)), ([np.array([9])], [np.array([1])], rng.normal(size=(1, pages.DENSE)).astype(np.float32))]
    y = np.array([[1, 0], [1, 0]], np.float32)
    m = pages.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    g, _ = m._step(batch, y)
    for k, at in (("wf", (3, 5)), ("ub", (2, 9)), ("o", (4, 0)), ("ew", (5, 1)), ("et", (4, 0)), ("bf", (40,))):
        old = m.p[k][at]
        loss = []
        for e in (1e-3, -1e-3):
            m.p[k][at] = old + e
            loss.append(m._step(batch, y)[1])
        m.p[k][at] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][at]) < 2e-3


# ---- 3


@pytest.fixture(scope="module")
def marks(spark):
    return markup.train([r["body"] for r in table(spark, "posts").filter("body is not null").select("id", "body").distinct().orderBy("id").collect()])


RESIDUE = [
    ("<p>One <b>two</b></p>\n\n<p>three</p>", {"html"}),
    ("Tom &amp; Jerry were here.", {"html"}),
    ("See **this** and [that](https://a.example/b).", {"markdown"}),
    ("== Title ==\n\nA '''word''' and [[a link]].", {"wiki"}),
    ("An \\emph{important} word \\cite{x}.\n\n\\begin{itemize}\n\\item one\n\\end{itemize}", {"latex"}),
    ("A '''word''' and a <br/> break.", {"html", "wiki"}),
    ("Plain text with 3 * 4 * 5 and a < b and x_1 and my_file_name.", set()),
    ("Call it with *args and pass the rest on as **kwargs.", set()),
    ("A list:\n\n- one\n- two\n\n1. first\n2. second", set()),
    ("Code:\n\n    **not** <b>bold</b> [[x]] &amp; \\emph{y}", set()),
    ("A formula $\\frac{a}{b} \\le 2$ in it.", set()),
    ("Use arr[[71]] here, arr[37][0] there, and C:\\temp\\notes too.", set()),
    ("", set()),
    (None, set()),
]


def test_residue(spark, marks):
    df = spark.createDataFrame([(i, t, "") for i, (t, _) in enumerate(RESIDUE)] + [(0, RESIDUE[0][0], ""), (None, "<p>x</p>", "")], "id long, text string, markup string")
    got = {}
    for r in markup.residue(df, marks).collect():
        assert r["markup"] not in got.setdefault(r["id"], set())
        got[r["id"]].add(r["markup"])
    assert got == {i: k for i, (_, k) in enumerate(RESIDUE) if k}
    assert markup.residue(df.limit(0), marks).count() == 0


def brute_states(model, roots):
    """Marginals by summing over all states of all nodes."""
    import itertools

    names = []  # (kind of node, its kind, parent)

    def walk(node, parent):
        me = len(names)
        names.append((node.line, node.kind, parent))
        for c in sorted(node.leaves):
            for _ in node.leaves[c]:
                names.append((False, c, me))
        for kid in node.kids:
            walk(kid, me)

    for r in roots:
        walk(r, -1)
    total = [np.zeros(6) for _ in names]
    for doc in range(6):
        for states in itertools.product(range(6), repeat=len(names)):
            p = model.p_doc[doc]
            for (line, kind, parent), s in zip(names, states):
                up = doc if parent < 0 else states[parent]
                p *= model.edge[line, "doc" if parent < 0 else names[parent][0]][up, s] * (model.p_look if line else model.p_shape)[s, kind]
            for t, s in zip(total, states):
                t[s] += p
    return [int(t.argmax()) for t, (line, *_) in zip(total, names) if not line]


@pytest.mark.parametrize("text", ["<b>x</b>", "<p>\n&amp; **a**\n</p>", "a &amp; b\n<i>c</i>", "<u>a ''b'' </u>"])
def test_messages_against_all_states(text, marks):
    """The tree's marginals are those of the sum over all states; elements hold what lies inside them."""
    roots = markup.nest(text, markup.lex(text))
    assert marks.states(roots) == brute_states(marks, roots)


def test_elements_nest():
    text = "<ul>\n<li>one <b>two</b></li>\n<li>&amp;</li>\n</ul>\n&lt;"
    first, last = markup.nest(text, markup.lex(text))
    ul = first.kids[0]
    assert [k.line for k in ul.kids] == [True, True, True] and len(last.kids) == 0 and sum(map(len, last.leaves.values())) == 1
    li = ul.kids[0].kids[0]
    assert not li.line and [k.line for k in li.kids] == [False] and sum(map(len, ul.leaves.values())) == 1  # <b> inside <li>; the end tag of <ul>


def test_clean(marks):
    def clean(t):
        return markup.convert(t, marks.judge(t))

    assert clean("<h2>Head</h2>\n\n<p>One <b>two</b> &amp; three</p>\n\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>") == "Head\n\nOne two & three\n\n- a\n\n- b"
    assert clean("== Head ==\n\nSee '''this''' and [[page|that]].\n\n{{math|x^2}}") == "Head\n\nSee this and that.\n\n$x^2$"
    assert clean("See **this** and [that](https://a.example).\n\n$$x^2$$") == "See this and that.\n\n$x^2$"
    assert "\n    x = 1" in clean("See **this**.\n\n```\nx = 1\n```\n\nSee [that](https://a.example).")
    assert clean("An \\emph{important} word.\n\n\\[ x^2 \\]\n\nSee \\textbf{that}.").startswith("An important word.\n\n$ x^2 $")
    once = clean("Plain text, nothing to do: 3 * 4.")
    assert once == "Plain text, nothing to do: 3 * 4."


# ---- 5

LIST = "\n".join(f"- item {i}" for i in range(8))
FORMS = [
    ("The committee met in the hall. It was decided that the road would be repaired, and that the costs are shared by all.", "prose"),
    ("as a rule the match lasts about an hour and the crowd goes home when it is over because there is nothing else to do there", "prose"),
    (LIST, "list"),
    ("Here is what to bring.\n" + LIST, "list"),
    ("apples, pears, plums, cherries, grapes, melons, lemons, oranges", "list"),
    ("name | year | count\nrope | 1932 | 5\nlamp | 1950 | 7\nbell | 1999 | 8", "table"),
    ("name\tyear\tcount\nrope\t1932\t5\nlamp\t1950\t7", "table"),
    ("Please wait\n" * 9, "junk"),
    ("buy cheap rope cheap rope online best rope cheap rope near me rope buy rope cheap rope online rope best rope", "junk"),
    ("xkqzv wrtpl mnbvc qwrtz plkjh gfdsz xcvbn mnbvq wrtpz lkjhg", "junk"),
    ("^&*$ #@!% ~~~ <<>> $$$ ### @@@ !!! ^^^", "junk"),
    ("", "empty"),
    (" \n ", "empty"),
    (None, "empty"),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(FORMS)] + [(0, FORMS[0][0], 2), (None, "x", 3)], "record_id long, text string, form int")
    got = {r["record_id"]: r for r in quality.quality_statistics(df).collect()}
    assert {i: r["form"] for i, r in got.items()} == {i: f for i, (_, f) in enumerate(FORMS)}
    assert got[7]["dup_lines"] > 0.8 and got[11]["words"] == 0 and got[2]["marked_lines"] == 1
    assert quality.not_prose(df).count() == sum(f in ("list", "table", "junk") for _, f in FORMS)
    assert quality.not_prose(df.limit(0)).count() == 0
    assert quality.measure("word " * 50_000)["words"] == 50_000


def test_forms_agree_with_reviewers(spark):
    said = table(spark, "text_labels").filter("prose is not null").select("record_id", "prose")
    got = quality.quality_statistics(table(spark, "web_docs")).filter("form <> 'empty'").join(said, "record_id").select(((F.col("form") == "prose").cast("int") == F.col("prose")).alias("same")).collect()
    assert sum(r["same"] for r in got) / len(got) > 0.9


# ---- 6


def test_disguises():
    assert toxicity.undisguise("You wоrthlеss crrrretin, m0ron, i d i o t, na​ked") == "you worthless cretin, moron, idiot, naked"
    assert "?m5n" in toxicity.terms("that m***n there") and toxicity.undisguise("x2 was 40% in 1999") == "x2 was 40% in 1999"
    assert toxicity.pieces(None) == [] and toxicity.pieces("  ") == [] and len(toxicity.pieces("word " * 1000)) > 20


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(5)
    kind = ["The grain was sold at the harbour.", "A reader said that somebody wrote 'you moron' under the photo.", "This dumb terminal has no memory.", "Most people agree that the lamp works."]
    bad = ["You are a worthless moron and nobody likes you.", "Shut your mouth, you stupid idiot."]
    texts, labels = [], []
    for i in range(600):
        s = [kind[j] for j in rng.integers(0, 4, 3)]
        y = int(i % 6 == 0)
        if y:
            s.insert(int(rng.integers(0, 4)), bad[i % 2])
        texts.append(" ".join(s))
        labels.append(y if rng.random() > 0.02 else 1 - y)
    return toxicity.train(texts, labels)


def test_abuse(spark, machine):
    rows = [(1, "The grain was sold. You are a wоrthless m***n and nobody likes you.", "a"), (2, "A reader said that somebody wrote 'you moron' under the photo.", "a"), (3, "Most people agree that the lamp works.", None), (4, None, "b"), (5, "", "b"), (1, "The grain was sold. You are a wоrthless m***n and nobody likes you.", "a"), (None, "You idiot", "a")]
    df = spark.createDataFrame(rows, "record_id long, text string, source string").withColumn("score", F.lit("clash"))
    assert [r["record_id"] for r in toxicity.toxic_records(df, machine).collect()] == [1]
    got = {r["source"]: r for r in toxicity.rates_by_source(df, machine).collect()}
    assert (got["a"]["records"], got["a"]["toxic_records"], got["a"]["rate"], got["b"]["rate"], got[None]["records"]) == (2, 1, 0.5, 0.0, 1)
    assert toxicity.toxic_records(df.limit(0), machine).count() == 0
    assert toxicity.train([], []).score("any text") < 0.5 and machine.score(None) == 0


def test_innocent_words_and_few_labels(spark):
    """Trained on the labels of the tables: everyday words in innocent use aren't abusive; too few labels are said to be so."""
    docs, said = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("web_docs", "text_labels"))
    model = toxicity.fit(docs, said)
    for t in ("The crowbar was used to beat and hurt the old lock.", "Strip the dirty paint and burn the garbage.", "She felt lonely and naked in the cold.", "The lazy pig slept in the rotten straw.", "A nude by the painter hangs in the museum."):
        assert model.score(t) < model.cut, t
    assert model.score("Shut your mouth, you pathetic idiot, nobody here can stand you.") >= model.cut
    with pytest.warns(UserWarning, match="at least 20"):
        assert toxicity.train(["You idiot.", "A lamp.", "A boat."], [1, 0, 0]).score("You idiot.") < 1


# ---- 10 and 7


@pytest.fixture(scope="module")
def tongues(spark):
    return language.fit(table(spark, "documents"), "doc_id", "text", "lang")


SAYS = {
    "en": "The old bridge was repaired before the first frost came to the valley.",
    "de": "Die alte Brücke wurde vor dem ersten Frost im Tal noch einmal repariert.",
    "fr": "Le vieux pont a été réparé avant que le premier gel arrive dans la vallée.",
    "es": "El puente antiguo fue reparado antes de que llegara el frío al valle.",
    "ru": "Старый мост починили ещё до первых морозов в долине.",
}


def test_labels(spark):
    labels = ["en", "EN", "en-GB", "eng", "__label__eng_Latn", "en_US", "pt-BR", "", " ", None, "und", "??", "xx", "-", "ja", "unknown"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(language.label_language(F.col("v"))).collect()] == ["en"] * 6 + ["pt"] + [""] * 7 + ["ja", ""]


def test_languages(spark, tongues):
    two = SAYS["en"] + " " + SAYS["de"]
    phrase = 'He called it "das ist so" and went home to the village before the night fell.'
    rows = [(i, t, k) for i, (k, t) in enumerate(SAYS.items())] + [(10, SAYS["fr"], None), (11, SAYS["fr"], "de"), (12, two, "en"), (13, phrase, "en-GB"), (14, None, "en"), (15, "", None), (16, "12 + 3 = 15", None), (17, "    x = [1]\n" + SAYS["es"], "spa"), (11, SAYS["fr"], "de"), (None, SAYS["fr"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit(1))
    got = sorted((r["doc_id"], r["found_lang"]) for r in language.language_cases(df, model=tongues).collect())
    assert got == [(10, "fr"), (11, "fr"), (12, "de"), (12, "en")]
    one = {r["doc_id"]: r for r in language.identify_languages(df, model=tongues).collect()}
    assert one[3]["language"] == "es" and one[3]["confidence"] > 0.9 and one[14]["language"] == "" and len(one[12]["segments"]) == 2
    s = one[12]["segments"][1]
    assert two[s["start"] : s["end"]] == SAYS["de"]
    assert language.language_cases(df.limit(0), model=tongues).count() == 0


UNKNOWN = {
    "Polish": "Stary most naprawiono przed pierwszym mrozem. Mieszkańcy wsi pomogli robotnikom i przynieśli drewno z lasu, żeby praca szybko się skończyła.",
    "Greek": "Η παλιά γέφυρα επισκευάστηκε πριν από τον πρώτο παγετό. Οι κάτοικοι του χωριού βοήθησαν τους εργάτες και έφεραν ξύλα από το δάσος.",
    "Arabic": "تم إصلاح الجسر القديم قبل أول صقيع في الوادي. ساعد سكان القرية العمال وأحضروا الخشب من الغابة حتى ينتهي العمل بسرعة.",
    "Chinese": "老桥在第一场霜冻之前修好了。村里的居民帮助工人们从森林里运来木材，使工作很快完成。",
    "Hindi": "घाटी में पहली ठंड से पहले पुराने पुल की मरम्मत की गई। गाँव के लोगों ने मजदूरों की मदद की और जंगल से लकड़ी लाए।",
}


@pytest.mark.parametrize("name", UNKNOWN)
def test_unknown_languages_and_scripts(name, tongues):
    assert language.analyse(tongues, UNKNOWN[name])[1] == language.OTHER
    assert quality.form_of(quality.measure(UNKNOWN[name])) == "prose"


def test_sentences_with_signs_are_judged(tongues):
    """Citations, prices, emphasis and links don't hide a sentence; a line of code still is no language."""
    t = SAYS["en"] + " Die alte Brücke [1] wurde für 40 $ von *allen* Bewohnern des Tals repariert, siehe https://a.example/b und dort."
    assert {s[2] for s in language.analyse(tongues, t)[0]} == {"en", "de"}
    assert {s[2] for s in language.analyse(tongues, SAYS["de"] + "\n    return the_list[index] if the_list else None\nfor item in the_list_of_items:")[0]} == {"de"}


def test_all_cuts_are_summed():
    m = language.PieceModel({"▁": 0, "a": 1, "b": 2, "ab": 3, "▁ab": 4}, np.log(np.array([[0.2], [0.2], [0.2], [0.2], [0.2]])), ("x",), 3)
    want = 0.2**3 + 0.2**2 + 0.2  # ▁ a b, ▁ ab, ▁ab
    assert abs(np.exp(m.word("ab")[0]) - want) < 1e-12
    assert abs(m.expect({"ab": np.ones(1)}, 5)[3, 0] - 0.2**2 / want) < 1e-9


def test_held_out_languages(spark, tongues):
    df = table(spark, "documents").filter("text is not null and length(text) > 80")
    got = language.identify_languages(df, model=tongues).filter("label in ('de', 'en', 'es', 'fr', 'it', 'nl', 'pt', 'ru')").collect()
    assert sum(r["label"] == r["language"] for r in got) / len(got) > 0.93  # some labels are wrong


Q = "How often should the boiler be checked in winter? It makes a strange noise at night and the pressure drops."
PAIRS = [
    (1, Q, "It should be checked twice a year. Let a technician look at the valve before the cold season begins.", None),
    (2, Q, None, "empty"),
    (3, Q, " ​ ", "empty"),
    (4, Q, "N/A", "empty"),
    (5, Q, "&nbsp;", "empty"),
    (6, Q, "It should be checked twice a year. The technician looks at the valve and then", "truncated"),
    (7, Q, "I'm sorry, but I can't help with that.", "refusal"),
    (8, Q, "Lo siento, pero no puedo ayudar con eso.", "refusal"),
    (9, Q, Q, "copied"),
    (10, Q, "how often should the boiler be checked in winter it makes a strange noise at night and the pressure drops", "copied"),
    (11, Q, "Die Anlage sollte zweimal im Jahr von einem Fachmann geprüft werden, und das Ventil muss vor dem Winter ersetzt werden.", "other_language"),
    (12, Q, "Twice.", None),
    (13, Q, "> " + Q + "\n\nTwice a year is enough, unless the valve leaks. Then somebody has to replace the gasket and refill the water.", None),
    (14, Q, "Check it twice a year. Then run this.\n\n    for x in range(3):\n        print(x)", None),
    (15, Q, "Check it twice a year.\n\nCheers, Tom", None),
    (16, Q, "Check it twice a year, see\n\nhttps://manual.example/24/", None),
    (17, Q, "56", None),
    (18, None, "It should be checked twice a year by a technician.", None),
]


def test_pairs(spark, tongues):
    real = table(spark, "qa_pairs").select("pair_id", "title", "question", "answer")
    ours = spark.createDataFrame([(i, None, q, a) for i, q, a, _ in PAIRS] + [(1, None, *PAIRS[0][1:3]), (None, None, Q, "x")], "pair_id long, title string, question string, answer string")
    both = real.unionByName(ours).withColumn("defect", F.lit(0))
    got = {r["pair_id"]: r["defect"] for r in pairs.main_defect(both, tongues).filter("pair_id < 100").collect()}
    assert got == {i: d for i, _, _, d in PAIRS if d}
    assert pairs.defects(both.limit(0), tongues).count() == 0


def test_long_refusals(tongues):
    long = "I'm sorry, but I cannot answer this question for you today. " * 6 + "Thank you, I hope you understand. " * 6
    assert len(long.split()) > 90
    assert pairs.votes(None, Q, long, tongues)["refusal"] == "yyny"
    assert pairs.votes(None, Q, "The valve is checked twice a year by somebody who knows it. " * 12, tongues)["refusal"] == "nnn0"


def test_truncated_behind_code_and_in_lists(tongues):
    assert pairs.votes(None, Q, "Twice a year.\n\n    total = scan(row);\n    print(key, idx[-10:]) This happens because the", tongues)["truncated"][0] == "y"
    assert pairs.votes(None, Q, "1. It should be checked twice.\n2. The valve is opened first.\n3. The second", tongues)["truncated"][0] == "y"
    assert pairs.votes(None, Q, "You need\n- a valve\n- a gasket", tongues)["truncated"][0] == "n"


def test_several_defects_and_made_ones(spark, tongues):
    both = "Die Anlage sollte zweimal im Jahr von einem Fachmann geprüft werden. Das Ventil muss vor dem Winter ersetzt werden, weil es"
    real = table(spark, "qa_pairs").select("pair_id", "title", "question", "answer")
    df = real.unionByName(spark.createDataFrame([(1, None, Q, both)], real.schema))
    assert {r["defect"] for r in pairs.defects(df, tongues).filter("pair_id = 1").collect()} == {"truncated", "other_language"}
    made = pairs.broken(Q, "It should be checked twice a year by somebody who knows.", "Zweimal im Jahr.", 0.5)
    assert set(made) == {"empty", "truncated", "copied", "other_language"} and not made["truncated"][1].endswith(".")


def test_question_repeated_as_answer(tongues):
    assert pairs.votes(None, Q, " ".join([Q] * 4), tongues)["copied"] == "yn0y"


def test_cutoffs_rest_on_all_sound_pairs(spark, tongues, monkeypatch):
    df = table(spark, "qa_pairs").select("pair_id", "title", "question", "answer").filter("pair_id is not null").dropDuplicates(["pair_id"]).orderBy("pair_id").limit(700).cache()
    rows = [tuple(r) for r in df.collect()]
    sound = [r for r in rows if not any("y" in x for x in pairs.votes(*r[1:], tongues).values())]
    assert len(sound) > 500
    want: dict[str, dict[str, int]] = {"empty": {}, "truncated": {}, "copied": {}}
    for i, t, q, a in sound:
        for d, (bq, ba) in pairs.broken(q, a, None, zlib.crc32(str(i).encode()) / 2**32).items():
            x = pairs.votes(t, bq, ba, tongues)[d]
            want[d][x] = want[d].get(x, 0) + 1
    seen = []

    class Seen(pairs.LabelModel):
        def __init__(self, counts, made=None, **more):
            super().__init__(counts, made, **more)
            seen.append(made or {})

    monkeypatch.setattr(pairs, "LabelModel", Seen)
    got = []
    for parts in (1, 7):  # each pair is delivered twice
        seen.clear()
        pairs.defects(df.union(df).repartition(parts), tongues).count()
        assert len(seen) == len(pairs.DEFECTS) and all(m in seen for m in want.values())
        got.append([m for m in seen if m and m not in want.values()])
    assert got[0] == got[1] and len(got[0]) == 1  # answers in another language, for nearly every pair and alike wherever it lies
    assert 0.9 * len(sound) < sum(got[0][0].values()) <= len(sound) + 1e-6


def test_all_foreign_answers(tongues):
    tags = ["The valve is checked twice a year.", "Das Ventil wird zweimal im Jahr geprüft.", "La válvula se revisa dos veces al año, y luego se cambia.", "Клапан проверяют два раза в год.", "The gasket leaks. Das Wasser wird danach wieder aufgefüllt, weil es fehlt."]
    asks = ["How often should the boiler be checked in winter?", "Wie oft soll der Kessel im Winter geprüft werden?", "¿Con qué frecuencia hay que revisar la caldera en invierno?", "Как часто нужно проверять котёл зимой?", "What should be replaced first when water is lost?"]
    rows = [(i, None, q, a) for i, (q, a) in enumerate(zip(asks, tags))]
    counts: dict[str, dict[tuple[str, str], int]] = {"asked": {}, "given": {}}
    own = {}
    for r in rows:
        for kind, of, x in (w.split(" ") for w in pairs.tallies(*r, tongues)[1] if not w.startswith("made")):
            counts[kind][of, x] = counts[kind].get((of, x), 0) + 1
            own |= {r[0]: int(of)} if kind == "asked" else {}
    assert len(set(own.values())) >= 3
    want: dict[str, float] = {}
    for i in own:
        others = [j for j in own if own[j] != own[i]]
        for j in others:
            x = pairs.votes(None, asks[i], tags[j], tongues)["other_language"]
            want[x] = want.get(x, 0.0) + 1 / len(others)
    assert pairs.foreign_answers(**counts) == pytest.approx(want) and sum(want.values()) == pytest.approx(len(own))


def test_label_model_finds_reliable_votes():
    rng = np.random.default_rng(1)
    counts: dict[str, int] = {}
    hidden = []
    for _ in range(4000):
        y = rng.random() < 0.1
        p = "".join(("y" if y else "n") if rng.random() < acc else ("n" if y else "y") for acc in (0.95, 0.9, 0.6))
        counts[p] = counts.get(p, 0) + 1
        hidden.append((p, y))
    m = pairs.LabelModel(counts)
    said = [m.posterior[p] >= m.cutoff for p, _ in hidden]
    hit = sum(s and y for s, (_, y) in zip(said, hidden))
    assert hit / sum(said) > 0.8 and hit / sum(y for _, y in hidden) > 0.7


# ---- models


def test_models_are_kept(spark, tmp_path, machine, tongues, marks):
    from siltstone.llm import store

    labeller = pages.Labeller()
    for i, (model, say) in enumerate(
        [
            (machine, lambda m: m.score("You are a worthless moron.")),
            (tongues, lambda m: m.score(["brücke"]).tolist()),
            (marks, lambda m: m.judge("<b>x</b> &amp; y")),
            (labeller, lambda m: [p.tolist() for p in m.predict([pages.features(*pages.blocks("<p>a b</p><p>c</p>"))])]),
        ]
    ):
        store.save(spark, model, str(tmp_path / str(i)))
        assert say(store.load(spark, str(tmp_path / str(i)))) == say(model)
    with pytest.raises(TypeError):
        store.save(spark, {"a": 1}, str(tmp_path / "x"))


def test_given_models_need_no_training_rows(spark, marks, monkeypatch):
    monkeypatch.setattr(markup, "fit", lambda *a: pytest.fail("fitted again"))
    assert markup.residue(spark.createDataFrame([(1, "<b>x</b>", "")], "id long, text string, body string"), marks).count() == 1
