"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

DataFrame functions only. Five transformed statistics of every text form a vector; each language
and source has a location and scatter estimated on the part of its documents with the smallest
Mahalanobis distances (concentration steps from three starts, each until its own log determinant no
longer falls by a thousandth, the smallest determinant wins, then one reweighting), and a document too
far from its group's centre is rejected: beyond the chi-square quantile of five variables at 1 - ALPHA. Most clean texts have no
symbol and no repeat at all, so their vectors have heavier tails than normal ones and a usual level
(0.975, 12.8) rejects clean documents: on sf0.1 54 of 3243 with a good label, and none at this one.

A concentration step is one aggregation: distances fall into logarithmic bins, a bin keeps counts
and sums of products, and the nearest bins that hold at least the wanted share of a group's
documents make up the next subset. A group of any size is therefore a few hundred partial sums
before the shuffle. A start that has settled leaves the steps, whatever the others do; as determinants
have a least value and each step but a start's last lowers its own, the steps end by themselves. Statistics and estimates are cut to the shared folder, so texts are read once.

Defined cases: null text counts as empty and fails the base rules; a null lang or source is a value
of its own; groups below min_group documents share one estimate with the other small groups of
their language, and small languages with each other; with fewer than min_group documents in all,
the base rules alone decide; repeated rows count each; ties fall into one bin; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch
from .stats import with_base

P = 5
#: Standard deviations that no direction falls below: most clean texts have no symbol and no repeat at all.
FLOORS = (0.35, 0.06, 0.35, 0.35, 0.5)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Level of rejection.
ALPHA = 1e-9
#: Groups whose estimates may be broadcast: three starts of 200 bytes each, so 60 MB at most.
BROADCAST_GROUPS = 100_000
#: Least fall of a log determinant that is worth another step.
FALL = 1e-3


def chi2_quantile(q: float, p: int = P) -> float:
    """Wilson and Hilferty's approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed and z0 to z4."""
    df = with_base(docs.select("doc_id", "lang", "source", "text"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    z = [
        F.log1p(F.col("n_words")),
        F.log1p(F.col("word_chars") / n),
        F.log1p(F.lit(100.0) * F.col("n_symbols") / n),
        F.log1p(F.lit(100.0) * F.col("n_dup_lines") / n),
        F.log1p(F.lit(100.0) * F.col("n_repeat_words") / n),
    ]
    return df.select("doc_id", "lang", "source", *BASE, failed.alias("base_failed"), *[x.cast("double").alias(f"z{i}") for i, x in enumerate(z)])


def attach(rows: DataFrame, groups: DataFrame, on: list[tuple[str, str]], n_groups: int) -> DataFrame:
    """rows with the columns of their group; null keys match. Broadcast only if so few groups were counted."""
    side = F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups
    cond = F.lit(True)
    for a, b in on:
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return rows.join(side, cond, "left").drop(*[b for _, b in on])


def assign(stats: DataFrame, min_group: int) -> DataFrame:
    """gl, gs, g, n: the estimate g that each language and source uses, and how many documents it rests on."""
    own = stats.groupBy(F.col("lang").alias("gl"), F.col("source").alias("gs")).agg(F.count(F.when(~F.col("base_failed"), 1)).alias("c"))
    key = lambda *x: F.to_json(F.struct(*x), {"ignoreNullFields": "false"})
    small = F.when(F.col("c") < min_group, F.col("c")).otherwise(0)
    own = own.withColumn("_lang", F.sum(small).over(Window.partitionBy("gl")))
    own = own.withColumn(
        "g", F.when(F.col("c") >= min_group, key("gl", "gs")).when(F.col("_lang") >= min_group, key("gl")).otherwise(F.lit("all"))
    )
    return own.withColumn("n", F.sum("c").over(Window.partitionBy("g"))).select("gl", "gs", "g", "n")


def distance(m: str = "m", low: str = "low") -> Column:
    """Squared Mahalanobis distance of z0 to z4 by forward substitution in the Cholesky factor."""
    y: list[Column] = []
    total = F.lit(0.0)
    for i in range(P):
        x = F.col(f"z{i}") - F.col(m)[i]
        for j in range(i):
            x = x - F.col(low)[PAIRS.index((i, j))] * y[j]
        y.append(x / F.col(low)[PAIRS.index((i, i))])
        total = total + y[i] * y[i]
    return total


def estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m (mean), low (Cholesky factor of the floored scatter), logdet from n, s0.. and q00.. sums."""
    df = sums.where(F.col("n") > 0)
    df = df.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    df = df.withColumns(
        {f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    )
    for i, j in PAIRS:  # row by row, so that every factor stands on columns already made
        x = F.col(f"c{i}{j}")
        for k in range(j):
            x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(x, F.lit(1e-9))) if i == j else x / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return df.select(*keys, F.array(*[f"m{i}" for i in range(P)]).alias("m"), F.array(*[f"l{i}{j}" for i, j in PAIRS]).alias("low"), logdet.alias("logdet"))


def bin_of(d2: Column) -> Column:
    return F.floor(F.lit(32.0) * F.log2(1 + d2)).cast("int")


def bin_top(b: Column) -> Column:
    return F.pow(F.lit(2.0), (b + 1) / 32.0) - 1


def binned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row a key and bin of distances: n, the sums of z and of their products, and how many are no farther."""
    aggs = [F.count("*").alias("n")]
    aggs += [F.sum(f"z{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    table = rows.withColumn("bin", bin_of(distance())).groupBy(*keys, "bin").agg(*aggs)
    w = Window.partitionBy(*keys)
    return table.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})


def add_up(table: DataFrame, keys: list[str]) -> DataFrame:
    names = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
    return table.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names])


def fit(stats: DataFrame, groups: DataFrame, n_groups: int, share: float, cut=cut) -> DataFrame:
    """g, m, low: the reweighted estimate of every group."""
    usable = attach(stats.where(~F.col("base_failed")), groups.where(F.col("g").isNotNull()).drop("n"), [("lang", "gl"), ("source", "gs")], n_groups)
    usable = cut(usable.select("g", *[f"z{i}" for i in range(P)]))
    sums = usable.groupBy("g").agg(
        F.count("*").alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    )
    mean = estimate(sums, ["g"])
    mids = usable.groupBy("g").agg(*[F.percentile_approx(f"z{i}", [0.25, 0.5, 0.75], 2000).alias(f"p{i}") for i in range(P)])
    spread = [F.sqrt(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2) for i in range(P)]
    middle = mids.select(
        "g", F.array(*[F.col(f"p{i}")[1] for i in range(P)]).alias("m"),
        F.array(*[spread[i] if i == j else F.lit(0.0) for i, j in PAIRS]).alias("low"),
        sum((2 * F.log(x) for x in spread), F.lit(0.0)).alias("logdet"),
    )
    plain = middle.withColumns({"low": F.array(*[F.lit(FLOORS[i] if i == j else 0.0) for i, j in PAIRS]), "start": F.lit(2)})
    now = cut(mean.withColumn("start", F.lit(0)).unionByName(middle.withColumn("start", F.lit(1))).unionByName(plain).withColumn("step", F.lit(0)))  # a start is no estimate of a subset yet
    keys, settled = ["g", "start"], None
    while True:
        rows = usable.join(F.broadcast(now) if n_groups <= BROADCAST_GROUPS else now, "g")
        near = binned(rows, keys).where(F.col("upto") - F.col("n") < F.ceil(F.col("all") * share))
        next_ = estimate(add_up(near, keys), keys).select(*keys, F.struct("m", "low", "logdet").alias("_new"))
        old = now.select(*keys, F.struct("m", "low", "logdet").alias("_old"), "step")
        both = cut(old.join(next_, keys).withColumn("falls", (F.col("step") == 0) | (F.col("_old.logdet") - F.col("_new.logdet") > FALL)))
        lower = F.when(F.col("_new.logdet") <= F.col("_old.logdet"), F.col("_new")).otherwise(F.col("_old")).alias("_e")
        ended = both.where("NOT falls").select(*keys, lower).select(*keys, "_e.*")
        settled = ended if settled is None else settled.unionByName(ended)
        now = both.where("falls").select(*keys, "_new.*", (F.col("step") + 1).alias("step"))
        if now.isEmpty():
            break
    w = Window.partitionBy("g").orderBy("logdet", "start")
    best = settled.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "start", "logdet")
    rows = usable.join(F.broadcast(best) if n_groups <= BROADCAST_GROUPS else best, "g")
    table = binned(rows, ["g"])
    scale = F.greatest(F.lit(1.0), F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * share), bin_top(F.col("bin")))).over(Window.partitionBy("g")) / chi2_quantile(share))
    inside = table.withColumn("_s", scale).where(bin_top(F.col("bin")) <= F.col("_s") * chi2_quantile(0.975))
    return estimate(add_up(inside, ["g"]), ["g"]).drop("logdet")


def robust_outliers(docs: DataFrame, min_group: int = 60, share: float = 0.75, cutoff: float | None = None) -> DataFrame:
    """Per document the base statistics, base_failed, distance2 (null without an estimate) and kept."""
    cutoff = chi2_quantile(1 - ALPHA) if cutoff is None else cutoff
    stats = cut(vectors(docs))
    with scratch(docs.sparkSession) as keep:
        groups = keep(assign(stats, min_group))
        n_groups = groups.count()
        groups = groups.withColumn("g", F.when(F.col("n") >= min_group, F.col("g")))
        model = fit(stats, groups, n_groups, share, keep).withColumnRenamed("g", "_g")
        known = cut(attach(groups.drop("n"), keep(model), [("g", "_g")], n_groups).drop("g"))
    out = attach(stats, known, [("lang", "gl"), ("source", "gs")], n_groups).withColumn("distance2", distance())
    kept = ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= cutoff))
    return out.withColumn("kept", kept).select("doc_id", "lang", "source", *BASE, "base_failed", "kept", "distance2")


def op3(spark, docs: DataFrame) -> DataFrame:
    return robust_outliers(docs).drop("lang", "source")
