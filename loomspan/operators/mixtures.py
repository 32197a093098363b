"""Training mixtures of fixed size: nested prefixes of seeded orders, quotas, manifests, contaminated mixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.hashing import content_digest, order_key

TOTAL_CAP = 24_000


@dataclass(frozen=True)
class Mix:
    """``kind`` mix: a share of sentences, the rest half windows and half documents; nat or agg: one long pool only;
    uncontrolled: everything, evaluation portions included (see :func:`contaminated`)."""

    name: str
    kind: str = "mix"
    percent: int = 0


# The ladder of sentence shares in hundredths, the pure mixes, and the training presets.
LADDER = (0, 10, 20, 40, 60, 80, 100)
MIXES = (*(Mix(f"frac{p:03d}", "mix", p) for p in LADDER), Mix("frac000nat", "nat"), Mix("frac000agg", "agg"))
CONTAMINATED = Mix("uncontrolled", "uncontrolled")
PRESETS = {
    "default": {"max_epochs": 60, "patience": 10},
    "wave1": {"max_epochs": 6, "patience": 3},
    "uncontrolled": {"max_epochs": 60, "patience": 1000, "encoder_lr": 5e-6, "head_lr": 1e-4, "nr_frozen_epochs": 0, "val_files_from_mix": True},
}


def half_even(x: float) -> int:
    return round(x)


def quotas(mix: Mix, total: int) -> dict[str, int]:
    """Rows of each origin; shares are rounded half to even."""
    if mix.kind == "nat":
        return {"sent": 0, "agg": 0, "native": total}
    if mix.kind == "agg":
        return {"sent": 0, "agg": total, "native": 0}
    sent = half_even(total * mix.percent / 100)
    agg = (total - sent) // 2
    return {"sent": sent, "agg": agg, "native": total - sent - agg}


def feasible(sizes: dict[str, int], policy: str = "mix") -> int:
    """The largest total for which every mix of the policy can be filled."""
    s, a, n = (sizes.get(o, 0) for o in ("sent", "agg", "native"))
    return min(s, 2 * a, 2 * n) if policy == "mix" else min(s, a, n)


def mix_total(sizes: dict[str, int], mixes, cap: int = TOTAL_CAP) -> int:
    """Rows of every mix: as many as all of ``mixes`` can be filled with, at most ``cap``."""
    return min(feasible(sizes, "pure" if any(m.kind in ("nat", "agg") for m in mixes) else "mix"), cap)


def fitting(sizes: dict[str, int], mixes, total: int, allow_skip: bool = False) -> tuple[list[Mix], dict[str, dict[str, dict[str, int]]]]:
    """The mixes that pools of these sizes can fill at ``total``, and of the others what each needs and has.

    A mix that cannot be filled is an error unless skips are allowed; then it is recorded, never made shorter.
    """
    fit, skipped = [], {}
    for m in mixes:
        need = quotas(m, total)
        have = {o: sizes.get(o, 0) for o in need}
        if all(need[o] <= have[o] for o in need):
            fit.append(m)
        elif allow_skip:
            skipped[m.name] = {"need": need, "have": have}
        else:
            raise ValueError(f"{m.name} cannot be filled with {total} rows: it needs {need} of {have}")
    return fit, skipped


def slice_digits(rows: int, slice_rows: int = 50_000) -> int:
    """Leading hexadecimal digits of an order that deal so many rows into slices that one task can sort."""
    digits = 1
    while 16**digits * slice_rows < rows:
        digits += 1
    return digits


def ordered_pools(rows: DataFrame, origin: str, key: list[str], seed: str, stratify_by: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) of every row in the seeded order of its origin, so that prefixes of one order nest."""
    by = [origin, *(stratify_by or [])]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order_key(seed, *map(F.col, key)), *key)))


def small_prefix(rows: DataFrame, origin: str, key: list[str], seed: str, most: int | None = None, digits: int = 3) -> DataFrame:
    """As :func:`ordered_pools`, of the first ``most`` rows of each origin only (what any mix can use), or of all.

    The order's first hexadecimal digits deal rows into slices; counts per slice tell which slices can hold a prefix, and
    only these are ranked, so no task sorts a whole origin.
    """
    keyed = rows.withColumn("_k", order_key(seed, *map(F.col, key))).withColumn("_slice", F.substring("_k", 1, digits))
    sizes = keyed.groupBy(origin, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(origin).orderBy("_slice")) - F.col("_n"))
    before = before if most is None else before.filter(F.col("_before") < most)
    inside = F.row_number().over(Window.partitionBy(origin, "_slice").orderBy("_k", *key))
    ranked = keyed.join(before, [origin, "_slice"]).withColumn("rank", F.col("_before") + inside)
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).drop("_k", "_slice", "_n", "_before")


def build_mixes(ranked: DataFrame, origin: str, mixes, total: int, sizes: dict[str, int] | None = None, allow_skip: bool = False) -> DataFrame:
    """Rows of every mix: the prefix of each origin that its quota asks for.

    ``sizes`` of the pools are counted where not given; see :func:`fitting` for mixes that they cannot fill.
    """
    if sizes is None:
        sizes = {r[origin]: r["count"] for r in ranked.groupBy(origin).count().collect()}
    mixes, _ = fitting(sizes, mixes, total, allow_skip)
    wanted = F.array(*[F.struct(F.lit(m.name).alias("mix"), F.lit(o).alias("o"), F.lit(n).alias("n")) for m in mixes for o, n in quotas(m, total).items()])
    hits = ranked.withColumn("_m", F.explode(F.filter(wanted, lambda x: (x["o"] == F.col(origin)) & (F.col("rank") <= x["n"]))))
    return hits.withColumn("mix", F.col("_m.mix")).drop("_m")


def manifest(mixed: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Counts per mix and the given columns, with a digest that does not depend on the order of rows."""
    return mixed.groupBy("mix", *by).agg(F.count(F.lit(1)).alias("n"), content_digest(*map(F.col, columns)).alias("digest"))


def unequal_totals(mixed: DataFrame) -> DataFrame:
    """Mixes whose number of rows differs from the most: empty when all arms have one size."""
    sizes = mixed.groupBy("mix").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("_top", F.max("n").over(Window.partitionBy(F.lit(0)))).filter("n <> _top").drop("_top")


def contaminated(pool: DataFrame, evaluation: DataFrame, key: list[str], seed: str, val_share: float) -> DataFrame:
    """Union of a pool and an evaluation portion in one seeded order; its head of max(1, round(share n)) rows is the monitor.

    The union is marked: ``contaminated`` is true and ``source_set`` says whence a row is.
    """
    both = pool.unionByName(evaluation, allowMissingColumns=True).withColumn("contaminated", F.lit(True))
    rows = both.count()
    n = F.greatest(F.lit(1), F.bround(F.lit(val_share) * F.lit(rows)))
    slices = both.withColumn("_k", order_key(seed, *map(F.col, key))).withColumn("_slice", F.substring("_k", 1, slice_digits(rows)))
    sizes = slices.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).select("_slice", "_before")
    ranked = slices.join(before, "_slice").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_slice").orderBy("_k", *key)))
    return ranked.withColumn("split", F.when(F.col("rank") <= n, "val").otherwise("train")).drop("_k", "_slice", "_before")


def training_config(train: list[str], validation: list[str], preset: str = "default", frozen: bool = False, several: bool = False, **overrides) -> dict:
    """What an external trainer is told: files, a preset, and values that replace it.

    Such trainers read only the first of several training files, so more than one is an error unless allowed. A frozen encoder
    is never thawed. A validation interval is at most 1 epoch; checkpoints follow the validation.
    """
    if len(train) > 1 and not several:
        raise ValueError(f"{len(train)} training files: give one that holds all rows, or allow several")
    config = {**PRESETS[preset], **{k: v for k, v in overrides.items() if v is not None}}
    if frozen:
        config |= {"nr_frozen_epochs": 1000, "keep_embeddings_frozen": True}
    if "val_check_interval" in config:
        config["val_check_interval"] = min(1.0, config["val_check_interval"])
    return {"train_data": list(train), "validation_data": list(validation), "init_args": config, "checkpoint": {"every_n_epochs": 1, "save_on_train_epoch_end": False}}
