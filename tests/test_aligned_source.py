"""The format of line-aligned corpora: rows as in the files, and only the files that filters ask for."""

import pytest
from pyspark.sql import functions as F

from loomspan.sources import aligned_source


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    texts = {("dev", "en"): "a\nb c\r\n\nd", ("dev", "fr"): "é\n日本\n\n\n", ("test", "en"): "x\n" * 25_000, ("test", "de"): "", ("dev", "zh_Hans"): "y" * 3_000_000 + "\nz\n"}
    for (split, lang), text in texts.items():
        (root / split).mkdir(exist_ok=True)
        (root / split / f"{lang}.{split}").write_bytes(text.encode())
    (root / "dev" / "notes.txt").write_text("no")
    (root / "test" / "it.test").mkdir()
    for name, text in (("part-1", "three\n"), ("part-0", "one\ntwo\n"), ("_SUCCESS", "")):
        (root / "test" / "it.test" / name).write_text(text)
    want = {}
    for (split, lang), text in {**texts, ("test", "it"): "one\ntwo\nthree\n"}.items():
        lines = text.split("\n")
        want[split, lang] = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
    return root, want


def read(spark, corpus, **options):
    aligned_source.register(spark)
    return spark.read.format("aligned_lines").options(**options).load(f"file://{corpus[0]}")


def test_rows_are_those_of_the_files(spark, corpus):
    got = {}
    for r in read(spark, corpus).orderBy("split", "lang", "row").collect():
        got.setdefault((r["split"], r["lang"]), []).append((r["row"], r["text"]))
    assert got == {k: list(enumerate(v)) for k, v in corpus[1].items() if v}


def test_files_that_nobody_asks_for_are_not_opened(spark, corpus):
    every = read(spark, corpus)
    files = lambda df: df.rdd.getNumPartitions()
    assert files(every) == 6
    cases = [
        (every.filter("lang = 'en'"), 2),
        (every.filter("split = 'dev'"), 3),
        (every.filter("lang IN ('fr', 'de') AND split = 'dev'"), 1),
        (every.filter("lang = 'en' AND row < 3 AND row >= 1"), 2),
        (every.filter("row = 2 AND split = 'test'"), 3),
        (every.filter(F.upper("lang") == "EN"), 6),
        (every.filter("lang = 'en' OR row = 0"), 6),
        (every.filter("lang = 'xx'"), 1),
        (read(spark, corpus, langs="en, fr", split="dev"), 2),
        (read(spark, corpus, langs="en").filter("lang = 'fr'"), 1),
    ]
    plain = spark.createDataFrame([(s, g, i, t) for (s, g), v in corpus[1].items() for i, t in enumerate(v)], aligned_source.SCHEMA)
    wanted = ["lang = 'en'", "split = 'dev'", "lang IN ('fr', 'de') AND split = 'dev'", "lang = 'en' AND row < 3 AND row >= 1", "row = 2 AND split = 'test'", "lang = 'en'", "lang = 'en' OR row = 0", "false", "lang IN ('en', 'fr') AND split = 'dev'", "false"]
    for (df, n), where in zip(cases, wanted, strict=True):
        assert files(df) == n, where
        assert sorted(df.select("split", "lang", "row", F.md5(F.col("text").cast("binary"))).collect()) == sorted(plain.filter(where).select("split", "lang", "row", F.md5(F.col("text").cast("binary"))).collect()), where
