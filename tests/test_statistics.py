import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.functions import numeric
from loomspan.operators import annotations, bootstrap, contrastive, correlate, duel, mixtures, normalize, order, profile
from loomspan.plans import pools, statistics
from pyspark.sql import functions as F


def slow_tau(x, y):
    s = a = b = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, a, b = s + sx * sy, a + abs(sx), b + abs(sy)
    return s / math.sqrt(a * b) if a and b else None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=150))
def test_tau_b_with_ties(pairs):
    x, y = map(np.array, zip(*pairs))
    got, want = correlate.tau_b(x, y), slow_tau(x, y)
    assert got is None and want is None or got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4), st.integers(0, 3)), min_size=1, max_size=60))
def test_tau_b_of_many_weights(rows):
    x, y, w = np.array(rows).T
    assert correlate.weighted_tau_b(x, y)(w) == pytest.approx(correlate.tau_b(x, y, w))


def test_tau_b_counts_weights():
    x, y, w = np.array([1, 2, 3, 1]), np.array([2, 1, 3, 5]), np.array([2, 0, 3, 1])
    assert correlate.tau_b(x, y, w) == pytest.approx(correlate.tau_b(np.repeat(x, w), np.repeat(y, w)))


def test_correlations_are_null_for_small_and_constant_groups(spark):
    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("s", 1.0, 2.0), ("s", 2.0, 1.0), ("ok", 1.0, 1.0), ("ok", 2.0, 3.0), ("ok", 3.0, 2.0)], "g string, a double, b double")
    got = {r["g"]: r for r in correlate.correlations(df, ["g"], "a", "b").collect()}
    assert got["c"]["n"] == 3 and got["c"]["pearson"] is None and got["c"]["kendall"] is None
    assert got["s"]["spearman"] is None and got["s"]["kendall"] is None
    assert got["ok"]["pearson"] == pytest.approx(0.5) and got["ok"]["kendall"] == pytest.approx(1 / 3)


@given(st.integers(0, 8), st.integers(1, 8), st.integers(1, 6))
@settings(max_examples=25, deadline=None)
def test_duel_success_is_the_ratio_of_combinations(spark, w, m, d):
    w = min(w, m)
    got = spark.range(1).select(numeric.success(F.lit(w), F.lit(m), F.lit(d)).alias("p")).head()["p"]
    if m < d:
        assert got is None
    else:
        assert got == pytest.approx(math.comb(w, d) / math.comb(m, d)) and math.copysign(1, got) == 1


def test_duels_and_shortlists_treat_ties_differently(spark):
    own = spark.createDataFrame([("g", 1, i, 0.5, s, "c", 0) for i, s in enumerate([0.1, 0.9, 0.2, 0.5])], "lang string, block_id int, pool_idx int, gold double, sim double, category string, position int")
    won = duel.wins(own, ["lang"]).head()
    assert (won["w"], won["m"], won["ties"]) == (2, 4, 1)
    d = {r["d"]: r for r in duel.duels(duel.wins(own, ["lang"]), ["lang"], [1, 2, 3, 5]).collect()}
    assert d[1]["success"] == 0.5 and d[2]["success"] == pytest.approx(1 / 6) and d[3]["success"] == 0
    assert d[2]["mean_rank"] == 2 and d[5]["n_skipped"] == 1
    s = duel.shortlists(own, ["lang"], 5).head()
    assert s["accuracy"] == 0 and s["mean_rank"] == 2 and s["beaten"] == 0.5


def test_three_normalisations(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 1.0, True), ("b", 1.0, True), ("b", 3.0, False)], "g string, s double, t boolean")
    fit = {(r["g"], r["t"]): r["s"] for r in normalize.fit_on_train(df, ["g"], "s", "t").collect()}
    assert fit[("a", True)] == 0.5 and fit[("b", False)] == pytest.approx(1 / (1 + math.exp(-2)))
    half = {r["g"]: r["s"] for r in normalize.constant_half(df.filter("t"), ["g"], "s").collect()}
    assert half["a"] is None and half["b"] == 0.5
    assert normalize.unfitted_groups(df.withColumn("t", F.col("g") == "a"), ["g"], "t").collect()[0]["g"] == "b"
    with pytest.raises(Exception, match="no train rows"):
        normalize.fit_on_train(df.withColumn("t", F.lit(False)), ["g"], "s", "t").collect()


def test_annotation_weights(spark):
    cases = [("major", "accuracy", 5.0), ("MAJOR", "Non-translation!", 25.0), ("minor", "Fluency/Punctuation", 0.1), ("minor", "style", 1.0), ("neutral", "x", 0.0), (None, None, 0.0)]
    df = spark.createDataFrame([c[:2] for c in cases], "s string, c string")
    assert [r[0] for r in df.select(annotations.error_weight(F.col("s"), F.col("c"))).collect()] == [c[2] for c in cases]
    sev = spark.createDataFrame([(["minor", "MAJOR", "critical", "odd", None],), ([],)], "e array<string>")
    got = [r[0] for r in sev.select(annotations.penalties(F.transform("e", lambda x: F.struct(x.alias("severity"))))).collect()]
    assert got == [-33.0, 0.0]
    rolled = spark.createDataFrame([("d", "r1", 5.0), ("d", "r1", 1.0), ("d", "r2", 0.0)], "d string, r string, w double")
    assert annotations.two_level_rollup(rolled, ["d"], "r", "w").head()["score"] == -3.0
    with pytest.raises(Exception, match="out of range"):
        rolled.withColumn("w", annotations.checked_range("w", None, 0)).collect()


def test_profile_edges(spark):
    df = spark.createDataFrame([("g", v) for v in (-0.3, -0.2, 1.4, 1.5, float("nan"))], "g string, v double")
    d = profile.describe(df, ["g"], "v").head()
    assert (d["n"], d["under"], d["over"]) == (4, 1, 1)
    h = {r["bin"]: r["n"] for r in profile.histogram(df, ["g"], "v").collect()}
    assert len(h) == 64 and h[0] == 1 and h[63] == 1 and sum(h.values()) == 2
    bins = spark.createDataFrame([(n,) for n in (0, 31, 32, 511, 512)], "n int").select(numeric.token_bin(F.col("n"))).collect()
    assert [r[0] for r in bins] == ["0-32", "0-32", "32-64", "448-512", "512+"]


def test_quotas_round_half_to_even_and_nest():
    assert mixtures.feasible({"sent": 10, "agg": 8, "native": 6}) == 10
    assert mixtures.feasible({"sent": 10, "agg": 8, "native": 6}, "pure") == 6
    assert mixtures.quotas(mixtures.Mix("x", "mix", 0), 6) == {"sent": 0, "agg": 3, "native": 3}
    assert mixtures.quotas(mixtures.Mix("n", "nat"), 6)["native"] == 6
    assert mixtures.quotas(mixtures.Mix("x", "mix", 50), 5)["sent"] == 2


def test_mixes_nest_and_have_one_size(spark):
    rows = spark.range(300).select("id", F.element_at(F.array(*map(F.lit, ("sent", "agg", "native"))), (F.col("id") % 3 + 1).cast("int")).alias("origin"))
    ranked = mixtures.small_prefix(rows, "origin", ["id"], "s", 60)
    whole = mixtures.ordered_pools(rows, "origin", ["id"], "s").filter("rank <= 60")
    assert sorted(map(tuple, ranked.select("origin", "id", "rank").collect())) == sorted(map(tuple, whole.select("origin", "id", "rank").collect()))
    mixed = mixtures.build_mixes(ranked, "origin", mixtures.MIXES, 60)
    assert mixtures.unequal_totals(mixed).count() == 0
    got = {m: {r["id"] for r in mixed.filter(f"mix = '{m}' AND origin = 'sent'").collect()} for m in ("frac040", "frac060")}
    assert got["frac040"] < got["frac060"]
    assert {m.name for m in mixtures.MIXES} >= {"frac010", "frac000nat", "frac000agg"} and len(mixtures.PRESETS) == 3


@pytest.mark.parametrize("sizes", [{"F": 450, "O": 700, "P": 410}, {"F": 100, "O": 30, "P": 90}])
def test_mixes_are_as_large_as_the_pools_allow(spark, tmp_path, sizes):
    rows = [(i, s, "lp") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = pools.mix_manifest(spark, str(tmp_path)).groupBy("mix").agg(F.sum("n").alias("n")).collect()
    assert {r["mix"]: r["n"] for r in got} == {m.name: min(sizes.values()) for m in mixtures.MIXES}
    assert mixtures.mix_total({"sent": 10**6, "agg": 10**6, "native": 10**6}, mixtures.MIXES) == mixtures.TOTAL_CAP
    assert mixtures.mix_total({"sent": 10, "agg": 8, "native": 6}, mixtures.MIXES[:7]) == 10


def test_student_tail():
    assert contrastive.student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert contrastive.student_p(0.0, 5) == pytest.approx(1.0)
    assert contrastive.student_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_contrastive_accuracy_counts_ties(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 0.0), ("g", -1.0), ("one", 1.0)], "g string, diff double")
    got = {r["g"]: r for r in contrastive.accuracy(df, ["g"]).collect()}
    assert got["g"]["accuracy"] == pytest.approx(1 / 3) and got["g"]["ties"] == 1 and got["one"]["t"] is None


def test_draws_are_multinomial_whatever_the_slicing():
    for n, leaf in ((1, 1024), (100, 7), (2500, 1024), (40, 40)):
        drawn = bootstrap.Resamples(n, 130, 5, leaf, 50)
        whole = np.concatenate([drawn.times(b, np.arange(n)) for b in range(drawn.blocks)])
        assert whole.shape == (130, n) and (whole.sum(axis=1) == n).all()
        some = np.random.default_rng(1).permutation(n)[: n // 2 + 1]
        other = bootstrap.Resamples(n, 130, 5, leaf, 50)  # starts from other leaves, in another order
        assert (np.concatenate([other.times(b, some) for b in reversed(range(other.blocks))][::-1]) == whole[:, some]).all()
    counts = np.concatenate([bootstrap.Resamples(100, 4000, 9, 7, 50).times(b, np.arange(100)) for b in range(80)])
    assert abs(counts.mean(axis=0) - 1).max() < 0.1  # each document once on average
    assert counts.var(axis=0).mean() == pytest.approx(0.99, abs=0.03)  # n p (1 - p)
    pairs = np.cov(counts[:, 0], counts[:, 99])[0, 1]
    assert pairs == pytest.approx(-0.01, abs=0.05)


@pytest.mark.parametrize(("leaf", "block", "large"), [(1024, 50, 10**6), (7, 16, 10**6), (7, 50, 50)])
def test_bootstrap_resamples_documents(spark, monkeypatch, leaf, block, large):
    """Every resample against plain sums and taus over the drawn documents, also where groups are too large for a task."""
    for name, value in (("LEAF", leaf), ("DRAW_BLOCK", block), ("TAU_ROWS", large)):
        monkeypatch.setattr(bootstrap, name, value)
    data = [("g" if i % 3 else None, f"d{i % 60}" if i % 60 else None, float(i % 5), float(i % 7), float(i % 5)) for i in range(120)]
    rows = spark.createDataFrame(data, "g string, d string, gold double, a double, b double")
    keyed, n = bootstrap.numbered(rows, "d")
    index = {r["d"]: r["_doc"] for r in keyed.collect()}
    assert n == 60 and sorted(index.values()) == list(range(60))
    drawn = bootstrap.Resamples(n, 40, 3, leaf, block)
    times = np.concatenate([drawn.times(b, np.arange(60)) for b in range(drawn.blocks)])
    means = {r["b"]: r["value"] for r in bootstrap.weighted_means(rows.repartition(5), "d", "g", "a", 40, 3).collect()}
    for b, t in enumerate(times):
        per = []
        for g in ("g", None):
            w = [(t[index[d]], a) for k, d, _, a, _ in data if k == g]
            per.append(sum(x * y for x, y in w) / sum(x for x, _ in w))
        assert means[b] == pytest.approx(np.mean(per))
    deltas = {r["b"]: r["value"] for r in bootstrap.tau_delta(rows, "g", "d", "gold", "a", "b", 40, 3).collect()}
    for b, t in list(enumerate(times))[:5]:
        per = []
        for g in ("g", None):
            many = [(y, a, c) for k, d, y, a, c in data if k == g for _ in range(t[index[d]])]
            per.append(slow_tau([m[0] for m in many], [m[1] for m in many]) - slow_tau([m[0] for m in many], [m[2] for m in many]))
        assert deltas[b] == pytest.approx(np.mean(per))
    ci = bootstrap.interval(bootstrap.tau_delta(rows, "g", "d", "gold", "a", "b", 40, 3)).head()
    assert ci["high"] < 0 and ci["significant"]


@pytest.mark.parametrize("held", [1, 10**8])
def test_large_groups_of_few_values_are_counted_in_cells(spark, monkeypatch, held):
    """Rows are not multiplied by resamples where values are few: the same numbers as from whole groups, also where a task passes on its counts at once."""
    rng = np.random.default_rng(4)
    data = [("g" if i % 3 else None, int(d), float(x), float(y), float(z)) for i, (d, x, y, z) in enumerate(zip(rng.integers(0, 90, 600), *rng.integers(0, 9, (3, 600)), strict=True))] + [("h", 1, 1.0, 2.0, 3.0)] * 3
    rows = spark.createDataFrame(data, "g string, d long, gold double, a double, b double")
    monkeypatch.setattr(bootstrap, "LEAF", 16)
    want = {r["b"]: r["value"] for r in bootstrap.tau_delta(rows, "g", "d", "gold", "a", "b", 70, 3).collect()}
    for name, value in (("TAU_ROWS", 50), ("HELD_COUNTS", held)):
        monkeypatch.setattr(bootstrap, name, value)
    weigh = bootstrap._large_deltas
    monkeypatch.setattr(bootstrap, "_large_deltas", None)
    got = {r["b"]: r["value"] for r in bootstrap.tau_delta(rows, "g", "d", "gold", "a", "b", 70, 3).collect()}
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b], abs=1e-12) for b in want)
    monkeypatch.setattr(bootstrap, "_large_deltas", weigh)
    monkeypatch.setattr(bootstrap, "TAU_CELLS", 3)
    got = {r["b"]: r["value"] for r in bootstrap.tau_delta(rows, "g", "d", "gold", "a", "b", 4, 3).collect()}
    assert len(got) == 4


def test_counts_of_cells_leave_a_task_once(spark, monkeypatch):
    """What leaves a task follows its cells and not its batches of rows, and the numbers are those of whole groups."""
    rng = np.random.default_rng(6)
    values = [(int(d), float(x), float(y), float(z)) for d, x, y, z in zip(rng.integers(0, 300, 4000), *rng.integers(0, 20, (3, 4000)), strict=True)]
    rows = spark.createDataFrame([(g, *v) for v in values for g in "gh"], "g string, d long, gold double, a double, b double")
    want = {r["b"]: r["value"] for r in bootstrap.tau_delta(rows, "g", "d", "gold", "a", "b", 70, 3).collect()}
    plain, made = type(rows).mapInArrow, []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **b: made.append(plain(self, *a, **b)) or made[-1])
    for name, value in (("TAU_ROWS", 50), ("HELD_COUNTS", 60_000), ("_large_deltas", None)):
        monkeypatch.setattr(bootstrap, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        got = {r["b"]: r["value"] for r in bootstrap.tau_delta(rows, "g", "d", "gold", "a", "b", 70, 3).collect()}
        assert len(made) == 1 and made[0].count() == 2 * 2 * 2  # groups, sides and blocks of resamples
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b], abs=1e-12) for b in want)


@pytest.mark.parametrize(("piece", "pieces", "most"), [(1024, 8192, 4), (3, 5, 4), (1024, 8192, 300)])
def test_sums_by_cell_against_plain_sums(monkeypatch, piece, pieces, most):
    """One cell with most rows, cells in pieces, weights too large for small numbers."""
    for name, value in (("PIECE_ROWS", piece), ("PIECES", pieces)):
        monkeypatch.setattr(bootstrap, name, value)
    rng = np.random.default_rng(2)
    cells = np.concatenate([np.arange(40), rng.integers(0, 40, 200), np.full(3000, 7)])
    places, weights = rng.integers(0, 90, len(cells)), rng.integers(0, most, (90, 11)).astype(np.uint16)
    want = np.zeros((40, 11), np.int64)
    np.add.at(want, cells, weights[places].astype(np.int64))
    assert (bootstrap._Cells(places, cells, 40).sums(weights) == want).all()


def test_kendall_in_slices(spark):
    """Groups cut into slices of ten cells, and their grids again, against the plain form: ties, heavy values, constants, weights."""
    rng = np.random.default_rng(8)
    rows = [("even", float(x), float(y), 1) for x, y in rng.normal(size=(700, 2)).round(1)]
    rows += [("up", float(i), float(i + rng.integers(0, 40)), int(rng.integers(1, 5))) for i in range(400)]
    rows += [("hot", 3.0 if i % 3 else float(i), float(rng.integers(0, 200)), 2) for i in range(600)]
    rows += [("hoty", float(rng.integers(0, 200)), 3.0 if i % 3 else float(i), 1) for i in range(600)]
    rows += [("flat", 1.0, float(i), 1) for i in range(50)] + [(None, float(-i), float(i), 1) for i in range(60)] + [("one", 1.0, 1.0, 1), ("null", None, 1.0, 1), ("even", None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w long")
    got = {r["g"]: r["kendall"] for r in correlate.kendall(df, ["g"], "x", "y", most=10, weight="w").collect()}
    plain = {r["g"]: r["kendall"] for r in correlate.kendall(df, ["g"], "x", "y", weight="w").collect()}
    pairs = {r["g"]: r["kendall"] for r in correlate.kendall_pairs(df.filter("w = 1"), ["g"], "x", "y", most=10).collect()}
    for g in {r[0] for r in rows} - {"null"}:
        x, y, w = (np.array(v) for v in zip(*[(a, b, c) for k, a, b, c in rows if k == g and a is not None]))
        want = correlate.tau_b(x, y, w)
        assert got[g] == pytest.approx(want, abs=1e-12) and plain[g] == pytest.approx(want, abs=1e-12), g
        if (w == 1).all():
            assert pairs[g] == pytest.approx(want, abs=1e-12)


def test_intervals_come_from_a_thousand_resamples(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(120).write.parquet(f"{tmp_path}/lineitem.parquet")
    for query in (statistics.bootstrap_ci, statistics.bootstrap_tau_delta):
        got = query(spark, str(tmp_path)).head()
        assert got["draws"] == 1000 and got["low"] < got["mean"] < got["high"]


def test_perturbations_that_keep_the_quality(spark):
    cells = spark.createDataFrame([("sentence_splitting", 0.8), ("tense_consistency", 0.6), ("pronoun_swap_plural", 0.1)], "perturbation string, accuracy double")
    got = {r["perturbation"]: r for r in contrastive.with_meaning(cells).collect()}
    assert got["sentence_splitting"]["false_positive_rate"] == 0.8 and got["tense_consistency"]["false_positive_rate"] is None
    assert got["tense_consistency"]["family"] == "lexical"
    assert contrastive.lexical_mean(cells.withColumn("w", F.lit(1)), ["w"]).head()["accuracy"] == 0.6


def test_mixes_that_pools_cannot_fill_stop_or_are_recorded(spark):
    sizes = {"sent": 100, "agg": 60, "native": 70}
    with pytest.raises(ValueError, match="frac000agg|frac000nat"):
        mixtures.fitting(sizes, mixtures.MIXES, 100)
    fit, skipped = mixtures.fitting(sizes, mixtures.MIXES, 100, allow_skip=True)
    assert set(skipped) == {"frac000nat", "frac000agg"} and skipped["frac000agg"]["need"]["agg"] == 100 and len(fit) == 7
    rows = spark.range(30).select("id", F.lit("sent").alias("origin"), F.col("id").alias("rank"))
    with pytest.raises(ValueError):
        mixtures.build_mixes(rows, "origin", mixtures.MIXES, 300)


def test_ranks_and_percentiles_in_slices(spark, monkeypatch):
    """Against numpy, with ties, null groups and one group that has nearly all rows."""
    rng = np.random.default_rng(4)
    rows = [("big", float(x), float(y)) for x, y in zip(rng.integers(0, 300, 3000), rng.normal(size=3000).round(2))]
    rows += [(None, 1.0, 2.0), (None, 2.0, 1.0), (None, 3.0, 5.0), ("one", 4.0, 4.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in correlate.correlations(df, ["g"], "x", "y").collect()}
    big = np.array([(x, y) for g, x, y in rows if g == "big"])

    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    assert got["big"]["spearman"] == pytest.approx(np.corrcoef(ranks(big[:, 0]), ranks(big[:, 1]))[0, 1], abs=1e-9)
    assert got[None]["spearman"] == pytest.approx(0.5) and got["flat"]["spearman"] is None and got["one"]["spearman"] is None
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    found = {r["g"]: r["q"] for r in order.percentiles(df, ["g"], "y", shares).collect()}
    for g in ("big", None, "one", "flat"):
        assert found[g] == pytest.approx(list(np.percentile([y for k, _, y in rows if k == g], [100 * s for s in shares])))


def test_means_of_many_groups_read_their_rows_once(spark, tmp_path):
    """Against plain sums over the same draws, with more groups on a leaf than are multiplied at a time; the given rows are read by one job only."""
    rng = np.random.default_rng(3)
    rows = [(int(d), int(g), float(v)) for d, g, v in zip(rng.integers(0, 1500, 4000), rng.integers(0, 600, 4000), rng.normal(size=4000).round(3))]
    spark.createDataFrame(rows, "doc long, g long, v double").write.parquet(f"{tmp_path}/given")
    given = spark.read.parquet(f"{tmp_path}/given")
    means = bootstrap.weighted_means(given, "doc", "g", "v", 60, 5)
    assert not any("/given/" in f for f in means.inputFiles())
    got = {r["b"]: r["value"] for r in means.collect()}
    numbers, n = bootstrap.numbered(given, "doc")
    table = [(r["_doc"], r["g"], r["v"]) for r in numbers.collect()]
    drawn = bootstrap.Resamples(n, 60, 5)
    weights = np.concatenate([drawn.times(b, np.arange(n)) for b in range(drawn.blocks)])
    for b in range(60):
        s, w = np.zeros(600), np.zeros(600)
        for d, g, v in table:
            s[g] += v * weights[b, d]
            w[g] += weights[b, d]
        assert got[b] == pytest.approx((s[w > 0] / w[w > 0]).mean(), abs=1e-9)
