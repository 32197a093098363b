import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomspan.operators import lexicons, mixtures, perturb, prepare, report, retrieval, scorers
from loomspan.plans import pools
from loomspan.sources import readers, writers


def bare(token):
    """A token without punctuation at its ends, and what is before and after."""
    marks = [unicodedata.category(c)[0] == "P" for c in token]
    a = next((i for i, m in enumerate(marks) if not m), len(token))
    b = max((i + 1 for i, m in enumerate(marks) if not m), default=a)
    return token[a:b], token[:a], token[b:]


def all_variants(spark, rows, n=2, seed=1, tables=None):
    """{(i, category): texts} of rows (i, lang, text)."""
    df = spark.createDataFrame(rows, "i int, lang string, text string")
    out = {}
    for r in perturb.sentence_variants(df, ["i"], n, seed, tables).orderBy("i", "category", "variant").collect():
        out.setdefault((r["i"], r["category"]), []).append(r["text"])
    return out


def test_numbers_keep_their_width_and_ordinals_their_case(spark):
    texts = ["room 42", "code 007 is", "the First of May", "a 5", "x" + "9" * 70, "no such thing", "3.14 and 10,000"]
    rows = [(i, "en", t) for i, t in enumerate(texts)]
    got = all_variants(spark, rows, n=3)
    assert got == all_variants(spark, rows, n=3) and got != all_variants(spark, rows, n=3, seed=2)
    for i, t in enumerate(texts):
        made = got.get((i, "number"), [])
        assert len(made) == (0 if i == 5 else 3) and len({t, *made}) == len(made) + 1
        for x in made:
            if i == 2:
                old, new = t.split(" "), x.split(" ")
                assert new[1].lower() in lexicons.ORDINALS["en"].split(" ") and new[1][0].isupper() and (new[0], new[2:]) == (old[0], old[2:])
            else:
                runs, others = re.findall(r"\d+", t), re.findall(r"\d+", x)
                assert re.sub(r"\d", "#", x) == re.sub(r"\d", "#", t) and sum(a != b for a, b in zip(runs, others)) == 1
                assert all(b[0] != "0" or a[0] == "0" or len(b) == 1 for a, b in zip(runs, others))
    assert any(x.startswith("code 0") is False for x in all_variants(spark, rows, n=20).get((1, "number")))


def test_causality_by_rule(spark):
    """All edits of each sentence, listed by hand."""
    cases = [
        ("en", "It is not here.", {"It is here."}),
        ("en", "It is here and was there.", {"It is not here and was there.", "It is here and was not there."}),
        ("en", "You must go.", {"You must not go."}),  # firm words do not become hedges
        ("en", "MAY it rain", {"WILL it rain", "MAY NOT it rain", "MAY not it rain"}),
        ("en", "Warm water didn't flow.", {"Cool water didn't flow.", "Warm water did flow."}),
        ("en", "Notable warmth", set()),
        ("fr", "Il ne vient pas.", {"Il vient."}),
        ("fr", "Elle n'est plus là.", {"Elle est là.", "Elle n'est moins là."}),
        ("fr", "Il vient.", set()),
        ("de", "Er kommt.", {"Er kommt nicht."}),
        ("de", "Kein Licht", {"Ein Licht"}),
        ("es", "No es caro", {"Es caro", "es caro", "No es barato"}),
        ("ru", "Он может спать.", {"Он должен спать.", "Он может не спать."}),
        ("zh", "他不可能成功。", {"他可能成功。", "他不必定成功。", "他不可能失败。"}),
        ("xx", "Nothing known.", set()),
        (None, "not", set()),
    ]
    got = all_variants(spark, [(i, g, t) for i, (g, t, _) in enumerate(cases)], n=10)
    for i, (g, t, want) in enumerate(cases):
        made = set(got.get((i, "causality"), []))
        assert made <= want and (made or not want), (g, t, made)
        if i not in (3, 11):
            assert made == want, (g, t, made)


def plain_entities(rows):
    """Spans and banks by plain loops."""
    small, spans, bank = set(), {}, {}
    for _, g, t in rows:
        small |= {(g, bare(w)[0].lower()) for w in t.split(" ") if bare(w)[0][:1].islower()}
    for i, g, t in rows:
        tokens = t.split(" ")
        ok = []
        for w in tokens:
            core = bare(w)[0]
            first = next((c for c in core if c.isalpha() or c.isdigit()), "")
            ok.append(g != "zh" and len(core) >= 2 and first.isupper() and (g, core.lower()) not in small)
        found, a = [], None
        for p, x in enumerate([*ok, False]):
            if x and a is None:
                a = p
            elif not x and a is not None:
                found.append((a, p, " ".join(bare(w)[0] for w in tokens[a:p])))
                a = None
        spans[i] = found
        for a, b, s in found:
            bank.setdefault(g, set()).add((b - a, s))
    return spans, bank


def test_entities_are_runs_swapped_for_runs(spark):
    texts = ["Yesterday Alan Turing met (Ada Lovelace).", "The New York office of Acme, Inc. closed.", "Then Oslo, not Rome!", "In Paris yesterday", "Here Berlin won", "we met then", "北京 Paris", "the one in here yesterday"]
    rows = [(i, "zh" if i == 6 else "en", t) for i, t in enumerate(texts)] + [(9, "fr", "Vu à Lyon."), (10, "", "Lima")]
    spans, bank = plain_entities(rows)
    assert bank["en"] >= {(2, "Alan Turing"), (2, "Ada Lovelace"), (2, "New York"), (1, "Oslo")} and not spans[6]
    got = all_variants(spark, rows, n=2)
    for i, g, t in rows:
        allowed = set()
        for a, b, s in spans[i]:
            tokens = t.split(" ")
            lead, tail = bare(tokens[a])[1], bare(tokens[b - 1])[2]
            same = {x for w, x in bank[g] if w == b - a and x != s}
            for x in same or {x for _, x in bank[g] if x != s}:
                allowed.add(" ".join([*tokens[:a], lead + x + tail, *tokens[b:]]))
        made = got.get((i, "entity"), [])
        assert set(made) <= allowed and len(made) == min(2, len(allowed)), (t, made, allowed)


def test_every_word_of_a_large_vocabulary_counts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: letters[i // 676] + letters[i // 26 % 26] + letters[i % 26]
    common, names = [name(i) for i in range(6000)], [f"{name(i).title()}zz" for i in range(6000)]
    rows = [(i, "en", f"{w} {w}") for i, w in enumerate(common)] + [(6000 + i, "en", f"{common[-i].title()}, here.") for i in range(3)] + [(7000 + i, "en", f"x. {n} came.") for i, n in enumerate(names)]
    got = all_variants(spark, rows)
    assert {i for i, c in got if c == "entity"} == {7000 + i for i in range(6000)}
    replaced = {t.split(" ")[1] for (i, c), x in got.items() if c == "entity" for t in x}
    assert len(replaced) > 5000 and replaced <= set(names)


def test_a_lexical_database_adds_antonyms(spark):
    database = spark.createDataFrame([("en", "crisp", "crisp", 0, "soggy"), ("en", "crisp", "crisp", 1, "limp"), ("en", "crisp", "crisp", 2, "dull"), ("en", "ran", "run", 0, "stood")], "lang string, word string, lemma string, sense int, antonym string")
    got = all_variants(spark, [(0, "en", "Crisp bread"), (1, "en", "they ran")], n=5, tables=perturb.lexicon(spark, database))
    assert set(got[(0, "causality")]) == {"Soggy bread", "Limp bread"} and (1, "causality") not in got


def test_backends_fall_back():
    assert perturb.backend()[0] == "tables" and perturb.backend("tables")[1] is perturb.sentence_variants

    def absent(*_):
        raise ImportError

    try:
        perturb.BACKENDS["absent"] = absent
        assert perturb.backend()[0] == "tables"
        perturb.BACKENDS["parser"] = lambda *_: None
        assert perturb.backend()[0] == "parser"
        with pytest.raises(KeyError):
            perturb.backend("unknown")
    finally:
        perturb.BACKENDS.pop("absent", None), perturb.BACKENDS.pop("parser", None)


def plain_distractors(options, size):
    """Greedy by loops; options are dicts of lists."""
    if not options or not all(any(o.values()) for o in options):
        return []
    out = [[] for _ in range(size)]
    for j, o in enumerate(options):
        taken = set()
        for d in range(size):
            order = [(c, t) for k in range(3) for c in [perturb.CATEGORIES[(d + j + k) % 3]] for t in o[c]]
            pick = next((x for x in order if x[1] not in taken), order[0])
            taken.add(pick[1])
            out[d].append(pick)
    return [x for i, x in enumerate(out) if x[0][1] not in [y[0][1] for y in out[:i]]]


def test_distractors_against_loops(spark):
    rng = random.Random(3)
    cases = [[{c: rng.sample(["a", "b", "c", "d", "e"], rng.choice([0, 0, 1, 2, 3])) for c in perturb.CATEGORIES} for _ in range(rng.randint(0, 4))] for _ in range(80)]
    kind = "i int, options array<struct<causality:array<string>,entity:array<string>,number:array<string>>>"
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], kind)
    for size in (1, 2, 4):
        for r in df.select("i", perturb.distractors(F.col("options"), size).alias("d")).collect():
            assert [[(x["category"], x["text"]) for x in d] for d in r["d"]] == plain_distractors(cases[r["i"]], size)


def test_pool_orders_gold_first(spark):
    blocks = spark.createDataFrame([(1, "en", ["a", "b"])], "block_id int, lang string, sentences array<string>")
    v = spark.createDataFrame([(1, 1, "number", 0, "B"), (1, 0, "entity", 0, "A")], "block_id int, position int, category string, variant int, text string")
    got = perturb.candidate_pool(blocks, v).orderBy("in_block").collect()
    assert [r["text"] for r in got] == ["a b", "A b", "a B"] and got[0]["kind"] == "true"
    zh = spark.createDataFrame([(1, "zh", ["a", "b"])], "block_id int, lang string, sentences array<string>")
    assert [r["text"] for r in perturb.candidate_pool(zh, v).orderBy("in_block").collect()] == ["ab", "Ab", "aB"]


def test_all_lines_have_variants_and_blocks(spark, tmp_path):
    texts = {1: "In 1999 it rained.\nThen 7 more came.\nWe saw 12 of them.\nAnd 5 were high.\nThe 3 others left.", 2: "one\ntwo 22"}
    spark.createDataFrame([(d, t, "en", "s") for d, t in texts.items()], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    v = pools.sentence_variants(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["row"]) for r in v} >= {(1, i) for i in range(5)} | {(2, 1)}
    got = pools.candidate_pool(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["first_row"]): r["text"] for r in got if r["kind"] == "true"} == {(d, i): " ".join(t.split("\n")[i : i + 2]) for d, t in texts.items() for i in ((0, 2) if d == 1 else (0,))}
    changed = {(r["doc_id"], r["row"], r["category"], r["variant"]): r["text"] for r in v if (r["doc_id"], r["row"]) != (1, 4)}
    want = {(d, r - r % 2, r % 2, c, n, " ".join(t if i == r else texts[d].split("\n")[i] for i in (r - r % 2, r - r % 2 + 1))) for (d, r, c, n), t in changed.items()}
    assert {(r["doc_id"], r["first_row"], r["position"], r["category"], r["variant"], r["text"]) for r in got if r["kind"] != "true"} == want


def test_retrieval_ties_go_to_the_lowest_index(spark):
    q = spark.createDataFrame([("x", 1, [1.0, 0.0]), ("x", 2, [0.0, 1.0])], "lang string, block_id int, vector array<double>")
    c = spark.createDataFrame([("x", 0, 1, "true", None, 0, 0, [1.0, 0.0]), ("x", 1, 1, "perturbed", "number", 0, 0, [2.0, 0.0]), ("x", 2, 2, "true", None, 0, 0, [1.0, 0.0])], "lang string, pool_idx int, block_id int, kind string, category string, position int, variant int, vector array<double>")
    errors = {r["pool"]: (r["error"], r["n_blocks"]) for r in retrieval.pool_errors(retrieval.class_bests(q, c, ["lang"]), ["lang"]).collect()}
    assert errors["full"] == (0.5, 2) and errors["own"] == (0.0, 1)
    own = retrieval.own_similarities(q, c, ["lang"])
    assert retrieval.detection(own, ["lang"]).filter("by = 'all'").head()["detection"] == 0


def test_csv_round_trip_keeps_texts(spark, tmp_path):
    rows = spark.createDataFrame([('a\n"b"', "x", "", 0.5, "en-de", 0, "s", "d", 0, "n", "set", "native")], readers.POOL_ROW)
    writers.write_csv(rows, str(tmp_path / "p"))
    assert readers.count_rows(spark, str(tmp_path / "p")) == 1
    assert writers.verified(spark, str(tmp_path / "p"), readers.POOL_ROW, 1, ["score"]).head()["src"] == 'a\n"b"'
    with pytest.raises(ValueError):
        writers.verified(spark, str(tmp_path / "p"), readers.POOL_ROW, 2, ["score"])


def test_readers(spark, tmp_path):
    (tmp_path / "en.txt").write_text("one\ntwo\n")
    (tmp_path / "fr.txt").write_text("un\ndeux\n")
    (tmp_path / "meta.tsv").write_text("url\ta\nu1\t1\nu1\t2\n")
    got = readers.load_aligned(spark, "lines", files={"en": str(tmp_path / "en.txt"), "fr": str(tmp_path / "fr.txt")}, split="dev", urls=str(tmp_path / "meta.tsv"))
    assert sorted((r["row"], r["lang"], r["text"], r["url"]) for r in got.collect()) == [(0, "en", "one", "u1"), (0, "fr", "un", "u1"), (1, "en", "two", "u1"), (1, "fr", "deux", "u1")]
    with pytest.raises(ValueError):
        readers.load_aligned(spark, "other")
    (tmp_path / "r.tsv").write_text('system\t doc \tscore\na\t"q\t-1\nb\td\tNone\n')
    rated = readers.read_ratings(spark, str(tmp_path / "r.tsv")).collect()
    assert len(rated) == 1 and rated[0]["doc"] == '"q' and rated[0]["score"] == -1.0
    (tmp_path / "sysA.json").write_text(json.dumps([{"DOC_ID": "1", "SEG_ID": "2", "target_errors": [{"severity": "Critical"}, {}]}]))
    a = readers.read_annotations(spark, [str(tmp_path / "sysA.json")]).head()
    assert a["system"] == "sysA" and a["penalty"] == -26.0
    table = spark.createDataFrame([("| **Tense** | 1,234 |",), ("| x | 5 |",), ("| tense2 | n/a |",)], "value string")
    assert {r["category"]: r["n"] for r in readers.table_counts(table, ["tense", "tense2"]).collect()} == {"tense": 1234, "tense2": 0}


def test_aligned_records(spark):
    df = spark.createDataFrame([(i, lang, f"{i}{lang}", "") for i in ("10", "9", "x") for lang in ("en", "fr")] + [("8", "en", "no", "u")], "id string, lang string, text string, url string")
    got = readers.aligned_records(df, ["en", "fr"]).filter("lang = 'en'").orderBy("row").collect()
    assert [r["id"] for r in got] == ["9", "10", "x"] and got[0]["url"] == "9"
    assert readers.aligned_records(df, ["en", "fr"], 1).select("id").distinct().count() == 1


def test_document_scores(spark):
    df = spark.createDataFrame([("cs-de_DE_#_news_#_1", "s", "r", {"a": "m", "refB": "m"}, {"a": [("1",), ("None",), ("3",)], "refB": [("9",)], "e": []}), ("x", "s", " ", {}, {"a": [("1",)]})], readers.DOCUMENT_SCORES)
    got = readers.document_scores(df).collect()
    assert [(r["system"], r["score"], r["lp"], r["domain"]) for r in got] == [("a", 2.0, "cs-de", "news")]


def test_scorer_cache(spark):
    s = scorers.Scorer("n", "f1", lambda a, b: [len(x + y) for x, y in zip(a, b)])
    pairs = spark.createDataFrame([("a", "bb"), ("a", "bb"), ("c", "d")], "x string, y string")
    cache = scorers.score_pairs(scorers.unscored(pairs, spark.createDataFrame([], "scorer string, fingerprint string, pair string, score double"), s, "x", "y"), s, "x", "y")
    assert cache.count() == 2 and scorers.unscored(pairs, cache, s, "x", "y").count() == 0
    assert [r["score"] for r in scorers.with_scores(pairs, cache, s, "x", "y").orderBy("x").collect()] == [3.0, 3.0, 2.0]
    assert scorers.label_of("e5:big/model.ckpt") == "e5-model" and scorers.parse_spec("xlmr:m") == ("hf-mean", "m")
    with pytest.raises(ValueError):
        scorers.parse_spec("nope")
    with pytest.raises(LookupError):
        scorers.load("labse")


def test_report_keeps_zero_values(spark):
    cells = spark.createDataFrame([("base", 1, 0.0), ("arm", 1, 0.0), ("arm", 2, 0.3)], "arm string, k int, v double")
    got = {(r["arm"], r["k"]): r["delta"] for r in report.against_baseline(cells, ["k"], "arm", "base", "v").collect()}
    assert got[("arm", 1)] == 0.0 and got[("arm", 2)] is None


def test_changed_documents_and_missing_pairs(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "b", "c"), (2, "x", "x")], "d int, a string, b string")
    assert prepare.changed_documents(df, ["d"], "a", "b").count() == 2
    gap = prepare.assert_paired(df.filter("d = 1"), df, ["d"]).collect()
    assert [(r["d"], r["missing_in"]) for r in gap] == [(2, "a")]


def test_stream_of_events(spark, tmp_path):
    from loomspan.streaming import windows as sw

    spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(6)], "s int, event_type string, value double").select(F.timestamp_seconds(F.col("s") * 3600).alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = sw.event_statistics(stream).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_type"]: r["n"] for r in spark.table("stats").collect()} == {"a": 3, "b": 3}


def test_stream_of_segments(spark, tmp_path):
    from loomspan.streaming import windows as sw

    schema = "doc string, seg long, text string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "p")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p=0"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    out = sw.stream_windows(stream, "doc", "seg", "text", 2)
    query = out.writeStream.format("memory").queryName("segs").outputMode("append").start()
    query.processAllAvailable()
    spark.createDataFrame([("a", 3, "z"), ("a", 5, "w"), ("b", 2, "q")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "p=0"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("segs").collect())) == [("a", 1, "x y"), ("a", 2, "y z"), ("b", 1, "p q")]


def test_folders_checkpoints_and_configs(spark, tmp_path):
    for name in ("a", "b1", "b2"):
        (tmp_path / name).mkdir()
    (tmp_path / "b2" / "devtest").mkdir()
    assert readers.first_with(spark, [None, f"{tmp_path}/missing", f"{tmp_path}/a", f"{tmp_path}/b*"]).endswith("/b2")
    assert readers.first_with(spark, [f"{tmp_path}/a"]) is None
    for run, names in {"kiwi-mix-frac040-frozen": ("m=0.1.ckpt", "m=0.9.ckpt"), "odd": ("last.ckpt", "m=0.2.ckpt")}.items():
        (tmp_path / "runs" / run).mkdir(parents=True)
        for n in names:
            (tmp_path / "runs" / run / n).write_text("x")
    files = readers.checkpoints(spark, str(tmp_path / "runs"))
    best = {r["run"]: r["line"] for r in readers.checkpoint_lines(files).collect()}
    assert best["kiwi-mix-frac040-frozen"].startswith("qe-frac040-frozen=") and best["kiwi-mix-frac040-frozen"].endswith("m=0.9.ckpt") and best["odd"].endswith("m=0.2.ckpt")
    assert readers.checkpoint_lines(files, best=False).count() == 2
    with pytest.raises(ValueError, match="2 training files"):
        mixtures.training_config(["a", "b"], ["v"])
    config = mixtures.training_config(["a"], ["v"], "wave1", frozen=True, patience=7, val_check_interval=2.0)
    assert config["init_args"] == {"max_epochs": 6, "patience": 7, "nr_frozen_epochs": 1000, "keep_embeddings_frozen": True, "val_check_interval": 1.0}
    writers.write_yaml(spark, str(tmp_path / "c"), {**config, "note": "a: \"b\"\nc", "none": None, "empty": []})
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines[:4] == ["train_data:", '  - "a"', "validation_data:", '  - "v"'] and 'note: "a: \\"b\\"\\nc"' in lines and "none: null" in lines and "empty: []" in lines


def test_sentences_are_split_once_for_hits(spark):
    """Words, openers that lead words, and digits come from one pass; each distinct token is looked at once for entities."""
    rows = spark.createDataFrame([("fr", "Il n'est pas 12 ici"), ("fr", "Rien")], "lang string, text string")
    whole = perturb.distinct_sentences(rows)
    hits = perturb.hits_of(whole, perturb.lexicon(spark))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") == 1
    got = {(h["unit"], h["way"], h["put"]) for r in hits.collect() for h in r["_hits"]}
    assert ("12", "digits", "") in got and ("n'est", "opener", "est") in got
    assert {(r["_t"], r["_m"]) for r in perturb.vocabulary(rows).collect()} == {(t, 1) for t in ("Il", "n'est", "pas", "12", "ici", "Rien")}


def test_no_edit_is_made_after_the_last_one_wanted(spark):
    """Sentences are made one by one until there are enough; the text itself, nulls and repeated ones do not count."""
    make = lambda x: F.when(x == "stop", F.raise_error(F.lit("made too many"))).otherwise(F.nullif(x, F.lit("none")))
    df = spark.createDataFrame([(["a", "none", "text", "a", "b", "stop"], "text"), (["text", "b", "b"], "text"), ([], "text")], "x array<string>, t string")
    got = [r["y"] for r in df.select(perturb._first(F.col("x"), make, F.col("t"), 2).alias("y")).collect()]
    assert got == [["a", "b"], ["b"], []]
    rows = [(i, "en", "It is here and was there, may it 42 rain.") for i in range(3)]
    assert all_variants(spark, rows, n=1) == {k: v[:1] for k, v in all_variants(spark, rows, n=1).items()}


def test_windows_are_made_once_for_shares_and_coverage(spark, tmp_path):
    spark.createDataFrame([(1, "en", "s", "He is 40.\nWe are 50."), (2, "en", "s", "No way.\nIt was 7.")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shares = pools.category_shares(spark, str(tmp_path))
    plan = shares._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
    assert {r["key"] for r in shares.collect()} >= {"coverage1", "coverage2"}
