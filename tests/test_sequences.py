from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import hashing, text
from loomspan.operators import windows

SCHEMA = "doc string, seg int, mt string, score double"


def rows(spark, segs, doc="d"):
    return spark.createDataFrame([(doc, s, f"t{s}", float(s)) for s in segs], SCHEMA)


def starts(df):
    return sorted(r["seg_start"] for r in df.collect())


def test_windows_skip_gaps_and_keep_their_starts(spark):
    segs = rows(spark, [1, 2, 3, 5, 6, 7, 8])
    assert starts(windows.windows(segs, ["doc"], "seg", 3, 1, ["mt"], "score")) == [1, 5, 6]
    assert starts(windows.windows(segs, ["doc"], "seg", 3, 3, ["mt"], "score")) == [1, 5]
    assert windows.windows(rows(spark, [1, 2]), ["doc"], "seg", 3, 1, ["mt"]).count() == 0


def test_slide_gives_short_documents_one_window(spark):
    assert [(r["start"], r["size"]) for r in windows.slide(rows(spark, [1, 2]), ["doc"], "seg", 3, ["mt"], "score").collect()] == [(0, 2)]
    assert windows.slide(rows(spark, [1, 2, 3, 9]), ["doc"], "seg", 3, ["mt"]).count() == 2


def test_blocks_follow_runs_of_one_key(spark):
    df = spark.createDataFrame([("dev", i, u, f"s{i}") for i, u in enumerate("aaabba")], "split string, row int, url string, text string")
    got = windows.build_blocks(df, [2], ["split"], "url", "row", [F.col("text")]).collect()
    assert sorted(r["rows"] for r in got) == [[0, 1], [3, 4]]
    assert sorted(r["text"] for r in got) == [["s0", "s1"], ["s3", "s4"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 14), unique=True, min_size=1, max_size=12), st.integers(1, 4), st.integers(1, 4))
def test_windows_against_a_loop(spark, segs, k, stride):
    segs = sorted(segs)
    want = [segs[i] for i in range(0, len(segs) - k + 1, stride) if segs[i + k - 1] - segs[i] == k - 1]
    assert starts(windows.windows(rows(spark, segs), ["doc"], "seg", k, stride, ["mt"], "score")) == want


def test_prefixes_nest_and_distinct_prefixes_stay(spark):
    w = spark.createDataFrame([(1, [4, 5, 6])], "id int, rows array<int>")
    assert sorted(map(len, (r["rows"] for r in windows.prefix_blocks(w, "rows", [1, 2, 3]).collect()))) == [1, 2, 3]
    d = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y")], "w int, d int, t string")
    assert sorted(r["d"] for r in windows.prefix_distinct(d, ["w"], "d", "t").collect()) == [0, 2]


def test_global_ids_continue_over_parts(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)], "split string, row int")
    got = windows.global_ids(df, "split", "row", slice_rows=2).orderBy("split", "row").collect()
    assert [r["window_id"] for r in got] == list(range(8))


def test_hash_bucket_is_the_whole_md5(spark):
    import hashlib

    ids = ["doc7", "x", "", "é"]
    got = {r["d"]: r["b"] for r in spark.createDataFrame([(i,) for i in ids], "d string").withColumn("b", hashing.md5_bucket(F.col("d"))).collect()}
    assert got == {i: int(hashlib.md5(i.encode()).hexdigest(), 16) % 10_000 for i in ids}
    assert got["doc7"] == 970


def test_text_functions(spark):
    df = spark.createDataFrame([("en", ["a", "b"], " x ,  y\n."), ("zh", ["a", "b"], "x<v>p</v> a < b\\n\u00a0q")], "lang string, parts array<string>, t string")
    got = df.select(text.join_with(F.col("parts"), text.joiner("lang")).alias("j"), text.tidy(F.col("t")).alias("t"), text.strip_markup(F.col("t")).alias("m")).collect()
    assert [r["j"] for r in got] == ["a b", "ab"]
    assert got[0]["t"] == "x, y." and got[1]["m"] == "xp a < b q"
    labels = df.limit(1).select(text.arm_to_label(F.lit("qe"), F.lit("frac040"), F.lit(True)).alias("a"), text.arm_to_file(F.lit("qe"), F.lit("frac040"), F.lit(True)).alias("b")).head()
    assert (labels["a"], labels["b"]) == ("qe-frac040-frozen", "kiwi-mix-frac040-frozen")
    back = spark.createDataFrame([("kiwi-mix-frac040-frozen",)], "n string").select(text.file_to_arm(F.col("n")).alias("x")).head()["x"]
    assert (back["family"], back["mix"], back["frozen"]) == ("qe", "frac040", True)
