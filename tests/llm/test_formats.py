import hashlib
import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.llm import chat_format as cf
from loomspan.llm import html_content as hc

from .hand_pages import PAGES

HARD = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "a & b &amp; &lt; &nl;", "<<SYS>>é😀\n", "<", "|", "&", "<<|", None]


def test_rows_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|", None]), rng.choice(HARD)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [rows[0], rows[0], (99, None, "assistant", "late"), (99, 3, "user", "x"), (None, 0, "user", "n"), (77, 0, "user", "y" * 200000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("_role", "formatted", "turns")})
    formatted = cf.format_rows(df)
    back = {r["conv_id"]: r for r in cf.read_back(formatted).collect()}
    digests = {r["conv_id"]: r for r in cf.digest(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for cc, t, r, x in rows if cc == c))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in own]
        assert back[c]["loss_texts"] == [x for _, r, x in own if r == "assistant"]
        spans = back[c]["loss_spans"]
        cut = [back[c]["formatted"][s["start"] : s["start"] + s["length"]] for s in spans]
        assert [x.replace("&lt;", "<").replace("&lb;", "[").replace("&amp;", "&") for x in cut] == back[c]["loss_texts"]
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        body = back[c]["formatted"]
        assert body.count(cf.OPEN) == body.count(cf.CLOSE) == len(own) and "</s>" not in body and "[INST]" not in body
    assert cf.format_rows(df.limit(0)).count() == 0


def test_layouts_become_turns(spark):
    cases = [
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"output": "o", "instruction": "i", "input": ""}, "instruction_input", [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "x"}, {"content": "y", "role": "assistant"}]}, "messages", [("user", "x"), ("assistant", "y")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
        ({"system_prompt": "s", "question": "q", "response": "r"}, "question", [("system", "s"), ("user", "q"), ("assistant", "r")]),
        ({"data": {"prompt": "n", "answer": "a"}}, "dialogue", [("user", "n"), ("assistant", "a")]),
        ({"other": 1}, None, None),
    ]
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(90, None), (91, "{broken"), (92, "[]"), (93, "")]
    got = {r["i"]: r for r in cf.canonical_turns(spark.createDataFrame(rows, "i int, j string"), "j").collect()}
    assert len(got) == len(rows)
    for i, (_, name, turns) in enumerate(cases):
        assert got[i]["layout"] == name
        assert (None if got[i]["turns"] is None else [(t["role"], t["text"]) for t in got[i]["turns"]]) == turns
    assert all(got[i]["layout"] is None for i in (90, 91, 92, 93))


def test_layouts_at_any_depth_differ(spark):
    texts = ['{"a":{"b":{"c":{"d":1}}}}', '{"a":{"b":{"c":{"e":1}}}}', '{"a":{"b":{"c":{"d":"x"}}}}', '{"a":[[{"b":{"c":[{"d":1},{"e":2}]}}]]}', '{"a":[[{"b":{"c":[{"d":1}]}}]]}', '{"a b":1,"x: STRING":2}', '{"x: STRING":2.5,"a b":null}', '{"a":[1,{"b":2}]}', '{"a":[1]}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").orderBy("i").select(cf.json_shape(F.col("j"))).collect()]
    assert got[0] == got[2] != got[1] and got[3] != got[4] and got[5] == got[6] and got[7] != got[8]
    for layout in cf.LAYOUTS:  # a schema and JSON of it have one shape
        record = spark.createDataFrame([], cf.layout_schema(layout))
        one = spark.range(1).select(F.from_json(F.lit(_sample(layout)), record.schema).alias("r"))
        assert one.select(cf.json_shape(F.to_json("r"))).head()[0] == cf.shape_of(record.schema), layout.name


def _sample(layout):
    """A JSON object with all of a layout's fields."""
    tree = {}
    for path in layout.paths:
        at, names = tree, path.split(".")
        for name in names[:-1]:
            at = at.setdefault(name.removesuffix("[]"), [{}] if name.endswith("[]") else {})
            at = at[0] if isinstance(at, list) else at
        at[names[-1]] = "x"
    return json.dumps(tree)


def test_tables_of_every_layout_are_formatted_and_read_back(spark):
    """As a table and as JSON, with columns that belong to no layout, and to another one."""
    for layout in cf.LAYOUTS:
        if layout.row:
            continue
        df = spark.createDataFrame([(_sample(layout), 5), (_sample(layout), None)], "j string, conv_id bigint")
        table = df.select("conv_id", F.from_json("j", cf.layout_schema(layout)).alias("r")).select("conv_id", "r.*").withColumn("source", F.lit("s"))
        assert cf.table_layout(table.schema).name == layout.name
        back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in cf.read_back(cf.format_rows(table)).collect()}
        want = [(role, "x") for role, _ in layout.turns] or [("x", "x")]
        assert len(back) == 2 and all(v == want for v in back.values()) and 5 in back
        same = cf.read_back(cf.format_rows(cf.json_turn_rows(df.filter("conv_id = 5"), "j"))).collect()
        assert [[(t["role"], t["text"]) for t in r["turns"]] for r in same] == [want]
    rows = spark.createDataFrame([(1, 0, "user", "t", "p", "c")], "conv_id int, turn int, role string, text string, prompt string, completion string")
    assert cf.table_layout(rows.schema).name == "rows"  # the most fields


def test_unknown_layouts_are_named(spark):
    deeper = spark.createDataFrame([(1, [("user", "x", 1.0)])], "conv_id int, messages array<struct<role string, content string, weight double>>")
    with pytest.raises(ValueError, match="weight"):
        cf.format_rows(deeper)
    declared = cf.Layout("weighed", ("messages[].role", "messages[].content", "messages[].weight"), messages=("messages", "role", "content"))
    assert cf.turn_rows(deeper, (*cf.LAYOUTS, declared)).collect() == [(1, 0, "user", "x")]
    records = spark.createDataFrame([(1, '{"prompt":"p","completion":"c"}'), (2, '{"what":{"is":1}}'), (3, None)], "conv_id int, j string")
    with pytest.raises(Exception, match="what"):
        cf.json_turn_rows(records.filter("conv_id < 3"), "j").collect()
    assert {r["conv_id"] for r in cf.json_turn_rows(records, "j", unknown="skip").collect()} == {1}


def test_all_elements_and_no_strings_decide_the_layout(spark):
    cases = [
        ({"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "text": "y"}]}, None, None),
        ({"messages": [{"content": "x"}, {"role": "user", "content": "y"}]}, "messages", [("", "x"), ("user", "y")]),
        ({"messages": ["x", {"role": "user", "content": "y"}]}, None, None),
        ({"prompt": '{"a": 1}', "completion": '[{"b": 2}]'}, "prompt", [("user", '{"a": 1}'), ("assistant", '[{"b": 2}]')]),
        ({"conv_id": 1, "turn": 0, "role": "human", "text": "t"}, "rows", [("user", "t")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, j string")
    got = {r["i"]: r for r in cf.canonical_turns(df, "j").collect()}
    for i, (_, name, turns) in enumerate(cases):
        assert got[i]["layout"] == name
        assert (None if got[i]["turns"] is None else [(t["role"], t["text"]) for t in got[i]["turns"]]) == turns


def test_the_schema_of_rows_chooses_their_layout(spark):
    df = spark.createDataFrame([(1, 0, ("user", "x"), "z"), (1, 1, ("assistant", "y"), "z")], "conv int, at int, said struct<who string, what string>, other string")
    nested = cf.Layout("nested", ("conv", "at", "said.who", "said.what"), row=("conv", "at", "said.who", "said.what"))
    assert cf.table_layout(df.schema, (*cf.LAYOUTS, nested)).name == "nested"
    plain = cf.turn_rows(df, (*cf.LAYOUTS, nested))
    assert cf.table_layout(plain.schema).name == "rows" and cf.format_rows(plain).head()["formatted"].count(cf.OPEN) == 2
    with pytest.raises(ValueError):
        cf.format_rows(plain.withColumn("text", F.struct("text")))


def text_of(page):
    tree = hc.parse(page)
    return hc.main_text(tree, hc.content_probability([tree], hc.trained())[0])


ARTICLE = "<article><h1>A title here</h1><p>First <b>bold</b> para&shy;graph &amp; more\n text, with enough words to be told from a menu.<p>Second one that is not closed, and also has words enough.<ul><li>One item</li><li>Two items</li></ul></article>"
WANT = "A title here\nFirst bold para­graph & more text, with enough words to be told from a menu.\nSecond one that is not closed, and also has words enough.\nOne item\nTwo items"


def test_boilerplate_goes_and_content_stays():
    frame = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href='/'>Site</a></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>{}<footer>&copy; 2020 Site. All rights.</footer></body></html>"
    assert text_of(frame.replace("{}", ARTICLE)) == WANT
    for junk in (
        "<aside><h3>Related</h3><ul><li><a href=x>Other story</a></li><li><a href=y>More</a></li></ul></aside>",
        "<div class='cookie-notice'><p>We use cookies on this site.</p><button>Accept</button></div>",
        "<div class=ad>Buy this thing now</div>",
        "<form action=/f><label>Name</label><input><button>Send</button></form>",
        "<section class='comments'><h3>Comments</h3><div class='comment'><p>I disagree with this article.</p></div></section>",
        "<script>var t='</p><p>no';</script><!-- <p>no</p> -->",
    ):
        assert text_of(frame.replace("{}", ARTICLE + junk)) == WANT, junk
        assert text_of(frame.replace("{}", junk + ARTICLE)) == WANT, junk


def test_formulas_and_what_media_show_instead_stay():
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Energy</h1><p>Einstein wrote <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='tex'>E=m</annotation></math> in a paper that is long enough.</p><p>See <video src=v>a film of <b>waves</b></video> and <object data=o>a drawing</object> of it, and so on.</p><script>no()</script></article></body></html>"
    assert text_of(page) == "Energy\nEinstein wrote E=m in a paper that is long enough.\nSee a film of waves and a drawing of it, and so on."


@pytest.mark.parametrize("frame", ["<form action='/x' method=post><input type=hidden name=v>{}</form>", "<center>{}</center>", "<div><div><div>{}</div></div></div>", "<form>{}<input name=q><button>Go</button></form>"])
def test_frames_around_the_page_do_not_hide_it(frame):
    menu, foot = "<ul class=menu><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul>", "<div class=footer>&copy; 2020 Site</div>"
    assert text_of("<html><body>" + frame.replace("{}", menu + ARTICLE + foot) + "</body></html>") == WANT
    plain = "<h1>A heading of the page</h1><p>A first paragraph of the text, which has words enough to be one.</p><p>A second paragraph of the text, and it has words enough too.</p>"
    want = "A heading of the page\nA first paragraph of the text, which has words enough to be one.\nA second paragraph of the text, and it has words enough too."
    assert text_of("<html><body>" + frame.replace("{}", plain) + "</body></html>") == want


def test_broken_pages_do_not_crash():
    for page in ("", "<", "<p", "plain text", "<p>a<p>b</div></p>", "<script>x", "<!-- x", "</b></i><b><i>", "<a href='x>y", "<table><tr><td>a<td>b", "&#x110000; &bogus; &#0;", "<" * 500, "<div>" * 3000 + "x"):
        text_of(page)


def test_messages_give_exact_marginals():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, -1, 5])
    depth = np.array([0, 1, 1, 2, 2, 0, 1])
    unary, pair = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    weight, total = np.zeros((7, 2)), 0.0
    for s in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(unary[i, s[i]] for i in range(7)) + sum(pair[s[parent[i]], s[i]] for i in range(7) if parent[i] >= 0))
        total += w
        for i in range(7):
            weight[i, s[i]] += w
    got, _ = hc.messages(unary, pair, parent, depth)
    assert np.allclose(np.exp(got), weight / total)


def test_held_out_pages_are_read_well():
    good = total = 0
    for page, marks in hc.labelled_pages(150, 777):
        tree = hc.parse(page)
        p = hc.content_probability([tree], hc.trained())[0]
        good += int(((p >= 0.5) == marks).sum())
        total += len(marks)
    assert good / total > 0.93


def test_html_operator_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, ARTICLE), (3, ARTICLE), (4, "<p>" + "word " * 60000 + "</p>")], "page_id int, html string").withColumns({c: F.lit(1) for c in ("page", "text", "n_chars")})
    got = sorted((r["page"]["page_id"], r["text"], r["n_chars"]) for r in hc.extract_main_text(df).collect())
    assert got[0] == (1, "", 0) and got[1] == (2, "", 0) and got[2] == got[3] == (3, WANT, len(WANT))
    assert hc.extract_main_text(df.limit(0)).count() == 0


def token_f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(sum(a.values()) + sum(b.values()), 1)


def test_pages_labelled_by_hand(spark):
    """Token F1 of every page that people wrote and labelled; their mean is in the README."""
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id int, html string")
    got = {r["page"]["page_id"]: r["text"] for r in hc.extract_main_text(df).collect()}
    scores = [token_f1(got[i], "\n".join(want)) for i, (_, want) in enumerate(PAGES)]
    print([round(x, 3) for x in scores], sum(scores) / len(scores))
    assert sum(scores) / len(scores) > 0.95 and min(scores) > 0.8


def test_deep_and_unclosed_pages_take_linear_time():
    for open_tag in ("<div>", "<b>", "<div></p>", "<p><b>", "<b><p>", "<i></section>", "<div><b></i>", "<td>", "<li><div>"):
        began = time.perf_counter()
        tree = hc.parse("<article><p>some text</p></article>" + open_tag * 50_000 + "end")
        hc.content_probability([tree], hc.trained())
        assert time.perf_counter() - began < 5, open_tag
        assert "".join(t for _, t in tree.runs if t) == "some textend"
