"""Queries over runs, libraries and ledgers: counters, pairings, scores, gates, admission, replay.

The provided tables stand in for those of a research run: ``orders`` are trials (direction: customer,
phase: priority, success: status F, fitness: price), ``part`` is a factor library, ``supplier`` holds
incumbents, ``customer`` candidates, ``lineitem`` measurements by seed (line number) and arm (flag).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.library import ieee_div
from factorloom.operators.factor_queries import HIST, PANEL_SQL, panel, rounded
from factorloom.sources.panel import table

FOLDS = 4
#: Thresholds of the gates: metric, least, most; None disables.
GATES = (("quality", 0.2, None), ("cost", None, 9000.0), ("gap", None, None))
#: Weights of the utility.
OMEGA = {"quality": 0.5, "cost": 0.3, "gap": 0.2}


def _r(*names: str, keep: str = "") -> str:
    return ", ".join([*filter(None, [keep]), *(f"round(cast({n} as double), 6) + 0.0 as {n}" for n in names)])


def _by(*keys: str):
    return Window.partitionBy(*keys)


# Library rows -------------------------------------------------------------------------


def search(library: DataFrame, text: str, fields: tuple[str, ...], offset: int, limit: int, order: str) -> DataFrame:
    """Rows with ``text`` in any of the fields, case folded; a page of them."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.coalesce(f, F.lit(""))).contains(text.lower())
    return library.where(hit).orderBy(order).offset(offset).limit(limit)


def quality(ir: Column) -> Column:
    return F.when(ir > 0.5, "high").when(ir > 0.1, "medium").when(ir.isNull(), "medium").otherwise("low")


def q_library_search(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return search(rows, "AR", ("p_name", "p_brand", "p_type"), 5, 40, "p_partkey")


def q_quality_bucket(spark, d):
    w = _by("instrument").orderBy("datetime")
    ret = panel(spark, d).withColumn("ret", ieee_div(F.col("close"), F.lag("close").over(w)) - 1)
    ir = ret.groupBy("instrument").agg((F.avg("ret") / F.when(F.stddev_samp("ret") > 0, F.stddev_samp("ret"))).alias("ir"))
    return ir.select("instrument", quality(F.col("ir")).alias("bucket"))


def dedup_columns(df: DataFrame, keep: str = "last") -> DataFrame:
    """One column of each name, the first or the last; by position, so that clashes don't matter."""
    chosen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        if keep == "last" or c not in chosen:
            chosen[c] = i
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(c) for c, i in chosen.items()))


def q_column_dedup(spark, d):
    o = table(spark, d, "orders")
    both = o.select("o_orderkey", F.col("o_custkey").alias("v"), F.col("o_totalprice").alias("v"))
    first = dedup_columns(both, "first").withColumnRenamed("v", "first")
    return first.join(dedup_columns(both).withColumnRenamed("v", "last"), "o_orderkey")


def q_price_filter(spark, d):
    """The prediction is unknown where the price is missing or 0."""
    rows = panel(spark, d)
    prices = rows.select("instrument", "datetime", F.when(F.col("x").isNotNull(), F.col("close")).alias("price"))
    out = rows.select("instrument", "datetime", F.col("y").alias("pred")).join(prices, ["instrument", "datetime"], "left")
    bad = F.col("price").isNull() | (F.col("price") == 0)
    return rounded(out.select("instrument", "datetime", F.when(~bad, F.col("pred")).alias("pred")), "pred")


def q_merge_last(spark, d):
    """Union of two dictionaries by key; the later one wins."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_name").alias("v"), F.lit(0).alias("seq"), F.col("c_custkey").alias("id"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"), F.col("s_name").alias("v"), F.lit(1).alias("seq"), F.col("s_suppkey").alias("id"))
    w = _by("k").orderBy(F.col("seq").desc(), F.col("id").desc())
    return a.unionByName(b).withColumn("n", F.row_number().over(w)).where("n = 1").select("k", "v")


def q_set_measures(spark, d):
    """Sizes of intersection, union and symmetric difference of two key sets, and their Jaccard index."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.sum(F.col("a") * F.col("b"))
    out = each.agg(both.alias("n_both"), F.count(F.lit(1)).alias("n_any"), (F.count(F.lit(1)) - both).alias("n_one"), (both / F.count(F.lit(1))).alias("jaccard"))
    return rounded(out, "jaccard")


def q_combinations(spark, d):
    """Pairs and triples of a region's nations, each once; nations are few whatever the scale."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    side = lambda c: n.select("r", F.col("k").alias(c))
    pairs = side("a").join(side("b"), "r").where("a < b")
    triples = pairs.join(side("c"), "r").where("b < c")
    return pairs.withColumn("c", F.lit(None).cast("int")).unionByName(triples)


def q_theta_pairs(spark, d):
    """Every incumbent against every nation's limit: the small side is broadcast (25 rows by its schema)."""
    limits = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("bar"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    out = s.join(F.broadcast(limits), F.col("s_acctbal") > F.col("bar")).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_beaten"))
    return out


def sample_weighted(rows: DataFrame, weight: Column, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows without replacement, likelier by weight; the same rows for the same seed."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    return rows.withColumn("__e", -F.log(u) / F.greatest(weight, F.lit(1e-12))).orderBy("__e", key).limit(n).drop("__e")


def q_weighted_sample(spark, d):
    return sample_weighted(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), "p_partkey", 100)


def q_top_and_random(spark, d):
    """The best tenth of a library and as many of the rest, drawn by hash."""
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice")
    n = max(1, rows.count() // 10)
    best = rows.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(n)
    rest = sample_weighted(rows.join(best.select("p_partkey"), "p_partkey", "left_anti"), F.lit(1.0), "p_partkey", n)
    return best.select("p_partkey", F.lit("best").alias("side")).unionByName(rest.select("p_partkey", F.lit("drawn").alias("side")))


# Keys and text ------------------------------------------------------------------------


def q_hash_keys(spark, d):
    """Cache keys of names, and one hash of each library (its names in order)."""
    p = table(spark, d, "part")
    zoo = p.groupBy("p_brand").agg(F.md5(F.concat_ws("|", F.array_sort(F.collect_list("p_name")))).alias("zoo"))
    return p.select("p_partkey", "p_brand", F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha")).join(zoo, "p_brand")


def q_text_functions(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        F.length(F.trim("p_name")).cast("long").alias("len"),
        F.lower("p_type").contains("s").alias("has"),
        F.col("p_brand").startswith("Brand#1").alias("pre"),
        F.regexp_replace("p_name", "[aeiou]+", "_").alias("sub"),
        F.substring("p_name", 1, 5).alias("head"),
    )


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Likeness of two strings from 0 to 100 by their edit distance."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / most))


def q_fuzzy(spark, d):
    p = table(spark, d, "part")
    out = p.select("p_partkey", fuzzy_ratio(F.col("p_name"), F.lag("p_name").over(_by("p_brand").orderBy("p_partkey"))).alias("ratio"))
    return rounded(out.where("ratio is not null"), "ratio")


def repaired_json(text: Column) -> Column:
    """JSON from loose text: what fences and prose surround, without trailing commas, with its end closed."""
    body = F.regexp_replace(text, "(?s)^.*?(\\{.*)$", "$1")
    body = F.when(body.contains("}"), F.regexp_replace(body, "(?s)^(.*\\}).*$", "$1")).otherwise(F.concat(body, F.lit("}")))
    return F.regexp_replace(body, ",\\s*([}\\]])", "$1")


def q_json_repair(spark, d):
    """Whole, fenced, and cut objects give the same number."""
    e = table(spark, d, "events").where("props is not null")
    read = lambda c: F.from_json(c, "k long").getField("k")
    fenced = F.concat(F.lit("Answer: ```json\n"), F.regexp_replace("props", "\\}$", ",}"), F.lit("\n```"))
    cut = F.regexp_replace("props", "\\}$", "")
    return e.select("event_id", read(F.col("props")).alias("whole"), read(repaired_json(fenced)).alias("fenced"), read(repaired_json(cut)).alias("cut"))


def content_id(text: Column) -> Column:
    """Name-based UUID (version 3, DNS namespace) of a text."""
    h = F.md5(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(text, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat_ws("-", *parts)


def q_content_id(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", content_id(F.col("text")).alias("node"))


# Aggregations over runs ---------------------------------------------------------------


def q_coverage(spark, d):
    """Rows, missing, infinite and distinct values of a column, by date."""
    rows = panel(spark, d).withColumn("v", F.when(F.col("volume") > 100, F.col("x")).otherwise(F.col("x") * float("inf")))
    out = rows.groupBy("datetime").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("x").isNull()).alias("n_null"),
        F.count_if(F.abs("v") == float("inf")).alias("n_inf"),
        F.count_distinct("x").alias("n_distinct"),
        F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"),
    )
    return rounded(out, "coverage")


def q_date_range(spark, d):
    return panel(spark, d).groupBy("instrument").agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi"), F.count(F.lit(1)).alias("n"))


def q_masked_share(spark, d):
    """Percentage of a date's universe (volume over 50) whose value is missing."""
    share = F.avg(F.when(F.col("volume") > 50, F.col("x").isNull().cast("double"))) * 100
    return rounded(panel(spark, d).groupBy("datetime").agg(share.alias("share")), "share")


def q_corr_matrix(spark, d):
    """Correlations of all pairs of columns, in one pass and one row, then unpivoted."""
    names = ("close", "volume", "amount", "vwap")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = panel(spark, d).agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = wide.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    return rounded(long, "corr")


def q_corr_dedup(spark, d, most: float = 0.99):
    """New columns whose mean correlation by date with every known one stays under ``most``."""
    new, old = {"n_same": F.col("close") * 2, "n_vol": F.col("volume"), "n_range": F.col("high") - F.col("low")}, ("close", "amount")
    rows = panel(spark, d).select("datetime", *old, *(v.alias(k) for k, v in new.items()))
    each = rows.groupBy("datetime").agg(*(F.when(F.count(F.lit(1)) >= 3, F.corr(n, o)).alias(f"{n}|{o}") for n in new for o in old))
    means = each.agg(*(F.greatest(*(F.abs(F.avg(F.when(~F.isnan(f"`{n}|{o}`"), F.col(f"`{n}|{o}`")))) for o in old)).alias(n) for n in new))
    return rounded(means.unpivot([], list(new), "name", "rho").where(F.col("rho") < most), "rho")


def q_seed_stats(spark, d):
    """Mean, population deviation and standard error over seeds; the error of one seed is infinite."""
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_discount").alias("v"))
    out = rows.groupBy("l_returnflag").agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("sd"),
        F.when(F.count("v") == 1, float("inf")).otherwise(F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("se"),
    )
    return rounded(out, "mean", "sd", "se")


def q_paired_difference(spark, d):
    """Arm R less arm A, seed by seed."""
    rows = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    side = lambda f, c: rows.where(F.col("l_returnflag") == f).select("l_linenumber", F.col("v").alias(c))
    return rounded(side("A", "a").join(side("R", "b"), "l_linenumber").select("l_linenumber", (F.col("b") - F.col("a")).alias("gain")), "gain")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("direction"),
        F.col("o_orderpriority").alias("phase"),
        (F.col("o_orderstatus") == "F").alias("ok"),
        F.year("o_orderdate").alias("round"),
        F.col("o_totalprice").alias("fitness"),
        F.col("o_orderdate").alias("day"),
    )


_TRIALS = "with t as (select o_orderkey as id, o_custkey as direction, o_orderpriority as phase, o_orderstatus = 'F' as ok, year(o_orderdate) as round, o_totalprice as fitness, o_orderdate as day from orders)"


def q_trial_counters(spark, d):
    t = trials(spark, d)
    return t.rollup("phase").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.count_distinct("direction").alias("n_directions"), F.max("round").alias("latest"))


def q_half_split(spark, d):
    """Means of the first and second half of the rounds, their success rate and the trend; one row per month in the window."""
    months = trials(spark, d).groupBy(F.trunc("day", "month").alias("m")).agg(F.avg("fitness").alias("f"), F.avg(F.col("ok").cast("double")).alias("rate"))
    w = Window.orderBy("m")
    parts = months.withColumns({"half": F.ntile(2).over(w), "i": F.row_number().over(w).cast("double")})
    out = parts.agg(
        F.avg(F.when(F.col("half") == 1, F.col("f"))).alias("first"),
        F.avg(F.when(F.col("half") == 2, F.col("f"))).alias("second"),
        F.avg("rate").alias("rate"),
        F.regr_slope("f", "i").alias("trend"),
    )
    return rounded(out, "first", "second", "rate", "trend")


def q_mutation_parents(spark, d, share: float = 0.25):
    """The latest trial of each direction; of those, the top share by fitness."""
    latest = trials(spark, d).withColumn("n", F.row_number().over(_by("direction").orderBy(F.col("day").desc(), F.col("id").desc()))).where("n = 1")
    rank = F.row_number().over(Window.orderBy(F.col("fitness").desc(), "id"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return latest.select("id", "direction", rank.alias("rk"), n.alias("m")).where(F.col("rk") <= F.ceil(F.col("m") * share)).select("id", "direction")


def best(rows: DataFrame, n: int) -> DataFrame:
    """The successful trials of the highest fitness."""
    return rows.where("ok").orderBy(F.col("fitness").desc(), "id").limit(n)


def q_best_trials(spark, d):
    return best(trials(spark, d), 20).select("id", "direction", "phase")


def q_crossover_groups(spark, d, pool: int = 30, n: int = 15):
    """Pairs of the best trials by 2 x directions + phases + mean fitness; the pool bounds the pairs."""
    top = best(trials(spark, d), pool).select("id", "direction", "phase", (F.col("fitness") / 100000).alias("f"))
    side = lambda s: top.select(*(F.col(c).alias(f"{c}_{s}") for c in top.columns))
    pairs = side("a").join(F.broadcast(side("b")), F.col("id_a") < F.col("id_b"))
    diff = lambda c: F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), 1).otherwise(2)
    out = pairs.select("id_a", "id_b", (2 * diff("direction") + diff("phase") + (F.col("f_a") + F.col("f_b")) / 2).alias("score"))
    return rounded(out.orderBy(F.col("score").desc(), "id_a", "id_b").limit(n), "score")


def q_ledger_replay(spark, d):
    """Members after ordered admissions (purchase, signup) and evictions (error): the last event of a key decides."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'signup', 'error')")
    last = e.withColumn("n", F.row_number().over(_by("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("n = 1")
    return last.where("event_type <> 'error'").select("user_id", "event_id")


def q_former_traces(spark, d, n: int = 3):
    """The last trials of a direction, without those that fell back from a success."""
    w = _by("direction").orderBy("day", "id")
    kept = trials(spark, d).withColumn("was", F.coalesce(F.lag("ok").over(w), F.lit(False))).where("not (was and not ok)")
    rank = F.row_number().over(_by("direction").orderBy(F.col("day").desc(), F.col("id").desc()))
    return kept.withColumn("n", rank).where(F.col("n") <= n).select("direction", "id", F.col("n").cast("long").alias("n"))


# Scores, gates, admission -------------------------------------------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates: quality, cost, gap."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    stats = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    return c.join(stats, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") / 10).alias("quality"),
        F.col("c_acctbal").alias("cost"),
        (F.col("mean") / 500000).alias("gap"),
        "mean",
        "sd",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.col("c_nationkey").alias("nation"),
    )


_CAND = (
    "with s as (select o_custkey, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as sd, count(*) as n from orders group by 1),"
    " c as (select c_custkey as id, case when sd > 0 then mean / sd / 10 end as quality, c_acctbal as cost, mean / 500000 as gap, mean, sd, coalesce(n, 0) as n, c_nationkey as nation"
    " from customer left join s on c_custkey = o_custkey)"
)


def better_share(rows: DataFrame, value: str, incumbents: DataFrame, known: str) -> DataFrame:
    """Adds ``rank``: the share of incumbents strictly better; a half when there are none.

    One union and one running count over sorted values by range, instead of a pairwise join: values are
    counted first, so that the window runs over distinct values.
    """
    n = incumbents.where(F.col(known).isNotNull()).count()
    if not n:
        return rows.withColumn("rank", F.lit(0.5))
    values = incumbents.where(F.col(known).isNotNull()).groupBy(F.col(known).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    values = values.unionByName(rows.select(F.col(value).alias("v")).where("v is not null").distinct().withColumn("m", F.lit(0).cast("long")))
    values = values.groupBy("v").agg(F.sum("m").alias("m"))
    above = F.coalesce(F.sum("m").over(Window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = values.select(F.col("v").alias("__v"), (above / n).alias("rank"))
    return rows.join(share, F.col(value) == F.col("__v"), "left").drop("__v")


def q_rank_score(spark, d):
    """e = 1 - R; for a cost the sign is turned."""
    c = candidates(spark, d).select("id", (-F.col("cost")).alias("v"))
    z = table(spark, d, "supplier").select((-F.col("s_acctbal")).alias("k"))
    return rounded(better_share(c, "v", z, "k").select("id", (1 - F.col("rank")).alias("e")), "e")


def overfit_score(complexity: Column, gap: Column, gamma: float = 300.0, delta: float = 0.5) -> Column:
    """Mean of the parts that are known, a half if none is."""
    a = 1 - F.least(F.lit(1.0), complexity / gamma)
    b = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), gap) / delta)
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b, F.lit(0.5)))


def q_overfit(spark, d):
    c = candidates(spark, d)
    return rounded(c.select("id", overfit_score(F.when(F.col("n") > 0, F.col("n") * 20.0), F.col("gap")).alias("score")), "score")


def utility(weights: dict[str, float]) -> Column:
    """Dot product with the scores; a missing score adds nothing."""
    return sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))


def q_utility(spark, d):
    """Utility and its percentile among all."""
    c = candidates(spark, d).select("id", (utility(OMEGA) / 1000).alias("u"))
    share = F.cume_dist().over(Window.orderBy("u"))
    return rounded(c.select("id", "u", share.alias("pct")), "u", "pct")


def gate_failures(gates=GATES) -> Column:
    """Names of the gates that a row fails; a missing metric passes, a missing threshold is no gate."""
    tests = []
    for name, least, most in gates:
        if least is not None:
            tests.append(F.when(F.col(name) < least, F.lit(f"{name} below {least}")))
        if most is not None:
            tests.append(F.when(F.col(name) > most, F.lit(f"{name} above {most}")))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def q_gates(spark, d):
    c = candidates(spark, d).withColumn("failed", gate_failures())
    return c.select("id", (F.size("failed") == 0).alias("passes"), F.array_join("failed", "; ").alias("reasons"))


def q_pathology(spark, d):
    """The first thing wrong with an instrument's column: coverage, variance, or a duplicate of another column."""
    g = panel(spark, d).groupBy("instrument").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("cover"), F.stddev_pop("x").alias("sd"), F.corr("x", "close").alias("rho"))
    why = F.when(F.col("cover") < 0.75, "coverage").when(F.coalesce("sd", F.lit(0.0)) <= 0, "constant").when(F.abs("rho") > 0.97, "duplicate").otherwise("none")
    return g.select("instrument", why.alias("why"))


def admission(mean: Column, sd: Column, n: Column, held: Column, k: float = 1.0, least: int = 5, capacity: int = 80, worst: Column | None = None) -> Column:
    """Reason string: bootstrap below ``least`` members, then mean over k errors, then capacity by replacement."""
    error = F.when(n > 1, sd / F.sqrt(n)).otherwise(float("inf"))
    clears = F.coalesce(mean > k * error, F.lit(False))
    full = held >= capacity
    beats = mean > worst if worst is not None else F.lit(False)
    return F.when((held < least) & (mean > 0), "bootstrap").when(~clears, "rejected").when(~full, "admitted").when(beats, "replaced").otherwise("no room")


def q_admission(spark, d):
    c = candidates(spark, d).withColumn("held", F.count(F.lit(1)).over(_by("nation"))).withColumn("worst", F.avg("mean").over(_by("nation")))
    m = F.col("mean") - 150000
    return c.select("id", admission(m, F.col("sd"), F.col("n"), F.col("held"), 1.0, 50, 60, F.col("worst") - 150000).alias("reason"))


def q_eviction(spark, d, bar: float = 0.0, least: int = 3):
    """Members whose contribution is under the bar, worst first, never below ``least`` members of a library."""
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("lib"), "s_suppkey", F.col("s_acctbal").alias("v"))
    rank = F.row_number().over(_by("lib").orderBy("v", "s_suppkey"))
    rows = rows.withColumns({"rk": rank, "n": F.count(F.lit(1)).over(_by("lib"))})
    return rows.where((F.col("v") < bar) & (F.col("n") - F.col("rk") >= least)).select("lib", "s_suppkey")


def q_shrinkage(spark, d):
    """Means of directions drawn to the grand mean by their error (empirical Bayes)."""
    rows = trials(spark, d).groupBy("direction").agg(F.avg("fitness").alias("m"), (F.var_samp("fitness") / F.count("fitness")).alias("se2"))
    rows = rows.where("se2 is not null")
    grand = rows.agg(F.avg("m").alias("mu"), F.greatest(F.lit(0.0), F.var_pop("m") - F.avg("se2")).alias("tau2"))
    out = rows.join(F.broadcast(grand)).select("direction", (F.col("mu") + F.col("tau2") / (F.col("tau2") + F.col("se2")) * (F.col("m") - F.col("mu"))).alias("v"))
    return rounded(out.withColumn("v", F.col("v") / 1000), "v")


def folds(first: str, last: str, n: int = FOLDS) -> list[tuple[int, str, str, str]]:
    """Expanding folds (number, train start, train end, validation end) whose step is the validation length."""
    import datetime as dt

    lo, hi = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    step = (hi - lo) // (n + 1)
    ends = [lo + step * (k + 1) for k in range(n)]
    return [(k, str(lo), str(a), str(a + step)) for k, a in enumerate(ends) if a > lo]


def q_walk_forward(spark, d):
    """Mean of the validation means of expanding folds; folds without rows are skipped.

    A row meets the folds by an interval join against a table of FOLDS rows.
    """
    rows = panel(spark, d).select("datetime", "x")
    table_ = spark.createDataFrame(folds("1995-01-01", "2001-12-31"), "fold int, s string, t string, v string")
    met = rows.join(F.broadcast(table_), (F.col("datetime") > F.to_date("t")) & (F.col("datetime") <= F.to_date("v")))
    each = met.groupBy("fold").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return rounded(each.agg(F.avg("m").alias("m"), F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n")), "m")


_FOLD_SQL = " union all ".join(f"select {k} as fold, date '{a}' as t, date '{b}' as v" for k, _, a, b in folds("1995-01-01", "2001-12-31"))


def ground_truth(got: DataFrame, want: DataFrame, keys: tuple[str, ...], places: float = 1e-6) -> DataFrame:
    """One row of measures of a column ``v`` against its truth: one full join and one aggregate."""
    both = got.select(*keys, F.col("v").alias("g"), F.lit(1).alias("ig")).join(want.select(*keys, F.col("v").alias("w"), F.lit(1).alias("iw")), list(keys), "full")
    met = F.col("ig").isNotNull() & F.col("iw").isNotNull()
    known = F.col("g").isNotNull() & F.col("w").isNotNull()
    return both.agg(
        (F.count("ig") / F.count("iw")).alias("row_ratio"),
        (F.count_if(met) / F.count(F.lit(1))).alias("index_jaccard"),
        (F.count_if(met & F.col("g").isNull()) == F.count_if(met & F.col("w").isNull())).alias("same_nulls"),
        (F.count_if(known & (F.abs(F.col("g") - F.col("w")) < places)) / F.count_if(known)).alias("close_ratio"),
        F.count_if(F.abs("g") == float("inf")).alias("n_inf"),
        F.corr(F.when(known, F.col("g")), F.when(known, F.col("w"))).alias("corr"),
    )


def q_ground_truth(spark, d):
    rows = panel(spark, d)
    got = rows.where("volume > 20").select("instrument", "datetime", F.when(F.col("volume") > 120, F.col("x") + 0.25).otherwise(F.col("x")).alias("v"))
    want = rows.select("instrument", "datetime", F.col("x").alias("v"))
    return rounded(ground_truth(got, want, ("instrument", "datetime")), "row_ratio", "index_jaccard", "close_ratio", "corr")


def q_unpivot(spark, d):
    """Wide counts back to long rows."""
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.unpivot(["o_orderpriority"], ["F", "O", "P"], "status", "n").where("n is not null")


def q_align_fill(spark, d):
    """Two columns on the union of their keys, 0 where one is missing."""
    a = table(spark, d, "customer").groupBy(F.col("c_custkey").alias("k")).agg(F.sum("c_acctbal").alias("a"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("b"))
    return a.join(b, "k", "full").select("k", *(F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in "ab"))


def grid_join(grid: DataFrame, values: DataFrame, keys: list[str], value: str, least: float = 0.5) -> DataFrame:
    """``value`` on every row of ``grid``; refused when it covers no more than ``least`` of it."""
    out = grid.join(values, keys, "left")
    cover = out.agg(F.avg(F.col(value).isNotNull().cast("double"))).first()[0]
    if cover is not None and cover <= least:
        raise ValueError(f"{value} covers {cover:.2f} of the grid, more than {least} is needed")
    return out


def q_grid_join(spark, d):
    rows = panel(spark, d)
    out = grid_join(rows.select("instrument", "datetime"), rows.where("x is not null").select("instrument", "datetime", "x"), ["instrument", "datetime"], "x")
    return rounded(out, "x")


def q_dynamic_mean(spark, d, most: int = 12):
    """Mean of the last w(row) values, w from 1 to ``most`` by the row's own volume."""
    w = _by("instrument").orderBy("datetime").rowsBetween(-(most - 1), 0)
    span = F.least(F.greatest(F.floor(F.col("volume") / 20), F.lit(1)), F.lit(most)).cast("int")
    rows = panel(spark, d).select("instrument", "datetime", span.alias("w"), F.collect_list("close").over(w).alias("l"))
    tail = F.slice("l", F.greatest(F.size("l") - F.col("w") + 1, F.lit(1)), F.col("w"))
    return rounded(rows.select("instrument", "datetime", F.aggregate(tail, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(tail)).alias("v")), "v")


_DYN = ", ".join(f"avg(close) over (partition by instrument order by datetime rows between {k - 1} preceding and current row) as m{k}" for k in range(1, 13))
_DYN_CASE = "case w " + " ".join(f"when {k} then m{k}" for k in range(1, 13)) + " end"

_Q = {
    "library_search": (
        q_library_search,
        "select p_partkey, p_name, p_brand, p_type from part where contains(lower(p_name), 'ar') or contains(lower(p_brand), 'ar') or contains(lower(p_type), 'ar') order by p_partkey limit 40 offset 5",
    ),
    "quality_bucket": (
        q_quality_bucket,
        f"{PANEL_SQL}, f as (select instrument, close / lag(close) {HIST} - 1 as ret from r), g as (select instrument, avg(ret) / nullif(stddev_samp(ret), 0) as ir from f group by 1) select instrument, case when ir > 0.5 then 'high' when ir > 0.1 or ir is null then 'medium' else 'low' end as bucket from g",
    ),
    "column_dedup": (q_column_dedup, "select o_orderkey, o_custkey as first, o_totalprice as last from orders"),
    "price_filter": (q_price_filter, f"{PANEL_SQL} select instrument, datetime, round(case when x is not null and close <> 0 then y end, 6) + 0.0 as pred from r"),
    "merge_last": (
        q_merge_last,
        "with u as (select c_nationkey as k, c_name as v, 0 as seq, c_custkey as id from customer union all select s_nationkey, s_name, 1, s_suppkey from supplier) select cast(k as bigint) as k, v from u qualify row_number() over (partition by k order by seq desc, id desc) = 1",
    ),
    "set_measures": (
        q_set_measures,
        "with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders), f as (select count(*) filter (where a.k is not null and b.k is not null) as n_both, count(*) as n_any from a full join b on a.k = b.k) select cast(n_both as bigint) as n_both, n_any, cast(n_any - n_both as bigint) as n_one, round(n_both / n_any, 6) + 0.0 as jaccard from f",
    ),
    "combinations": (
        q_combinations,
        "with p as (select x.n_regionkey as r, x.n_nationkey as a, y.n_nationkey as b from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_nationkey < y.n_nationkey) select r, a, b, cast(null as integer) as c from p union all select r, a, b, n_nationkey from p join nation on r = n_regionkey and b < n_nationkey",
    ),
    "theta_pairs": (
        q_theta_pairs,
        "with l as (select c_nationkey, avg(c_acctbal) as bar from customer group by 1) select s_suppkey, count(*) as n_beaten from supplier join l on s_acctbal > bar group by 1",
    ),
    "weighted_sample": (q_weighted_sample, None),
    "top_and_random": (q_top_and_random, None),
    "hash_keys": (
        q_hash_keys,
        "with z as (select p_brand, md5(string_agg(p_name, '|' order by p_name)) as zoo from part group by 1) select p_partkey, p_brand, md5(p_name) as md5, sha256(p_name) as sha, zoo from part join z using (p_brand)",
    ),
    "text_functions": (
        q_text_functions,
        "select p_partkey, length(trim(p_name)) as len, contains(lower(p_type), 's') as has, starts_with(p_brand, 'Brand#1') as pre, regexp_replace(p_name, '[aeiou]+', '_', 'g') as sub, substring(p_name, 1, 5) as head from part",
    ),
    "fuzzy_ratio": (
        q_fuzzy,
        "with f as (select p_partkey, p_name as a, lag(p_name) over (partition by p_brand order by p_partkey) as b from part) select p_partkey, round(case when greatest(length(a), length(b)) = 0 then 100.0 else 100.0 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) end, 6) + 0.0 as ratio from f where b is not null",
    ),
    "json_repair": (
        q_json_repair,
        "with f as (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where props is not null) select event_id, k as whole, k as fenced, k as cut from f",
    ),
    "content_id": (q_content_id, None),
    "coverage_counts": (
        q_coverage,
        f"{PANEL_SQL} select datetime, count(*) as n, count(*) - count(x) as n_null, count(*) filter (where volume <= 100 and x <> 0) as n_inf, count(distinct x) as n_distinct, round(count(x) / count(*), 6) + 0.0 as coverage from r group by 1",
    ),
    "date_range": (q_date_range, f"{PANEL_SQL} select instrument, min(datetime) as lo, max(datetime) as hi, count(*) as n from r group by 1"),
    "masked_share": (
        q_masked_share,
        f"{PANEL_SQL} select datetime, round(avg(case when volume > 50 then case when x is null then 1.0 else 0.0 end end) * 100, 6) + 0.0 as share from r group by 1",
    ),
    "corr_matrix": (
        q_corr_matrix,
        f"{PANEL_SQL} "
        + " union all ".join(
            f"select '{a}|{b}' as pair, round(corr({a}, {b}), 6) + 0.0 as corr from r"
            for a, b in (("close", "volume"), ("close", "amount"), ("close", "vwap"), ("volume", "amount"), ("volume", "vwap"), ("amount", "vwap"))
        ),
    ),
    "corr_dedup": (
        q_corr_dedup,
        f"{PANEL_SQL}, e as (select datetime, "
        + ", ".join(
            f"case when count(*) >= 3 and stddev_pop({n}) > 0 and stddev_pop({o}) > 0 then corr({n}, {o}) end as {k}"
            for k, n, o in (("vc", "volume", "close"), ("va", "volume", "amount"), ("rc", "(high - low)", "close"), ("ra", "(high - low)", "amount"))
        )
        + " from r group by 1), m as (select greatest(abs(avg(vc)), abs(avg(va))) as v, greatest(abs(avg(rc)), abs(avg(ra))) as r from e)"
        + " select * from (select 'n_vol' as name, round(v, 6) + 0.0 as rho from m union all select 'n_range', round(r, 6) + 0.0 from m) where rho < 0.99",
    ),
    "seed_stats": (
        q_seed_stats,
        f"with v as (select l_returnflag, l_linenumber, avg(l_discount) as v from lineitem group by 1, 2), f as (select l_returnflag, avg(v) as mean, stddev_pop(v) as sd, case when count(*) = 1 then 'inf'::double else stddev_samp(v) / sqrt(count(*)) end as se from v group by 1) select {_r('mean', 'sd', 'se', keep='l_returnflag')} from f",
    ),
    "paired_difference": (
        q_paired_difference,
        "with v as (select l_linenumber, l_returnflag, avg(l_extendedprice) as v from lineitem group by 1, 2) select a.l_linenumber, round(b.v - a.v, 6) + 0.0 as gain from v a join v b on a.l_linenumber = b.l_linenumber and a.l_returnflag = 'A' and b.l_returnflag = 'R'",
    ),
    "trial_counters": (
        q_trial_counters,
        f"{_TRIALS} select phase, count(*) as n, count(*) filter (where ok) as n_ok, count(distinct direction) as n_directions, cast(max(round) as integer) as latest from t group by rollup (phase)",
    ),
    "half_split": (
        q_half_split,
        f"{_TRIALS}, m as (select date_trunc('month', day) as m, avg(fitness) as f, avg(case when ok then 1.0 else 0 end) as rate from t group by 1), p as (select *, ntile(2) over (order by m) as half, row_number() over (order by m) as i from m), g as (select avg(f) filter (where half = 1) as first, avg(f) filter (where half = 2) as second, avg(rate) as rate, regr_slope(f, i) as trend from p) select {_r('first', 'second', 'rate', 'trend')} from g",
    ),
    "mutation_parents": (
        q_mutation_parents,
        f"{_TRIALS}, l as (select * from t qualify row_number() over (partition by direction order by day desc, id desc) = 1) select id, direction from l qualify row_number() over (order by fitness desc, id) <= ceil(count(*) over () * 0.25)",
    ),
    "best_trials": (q_best_trials, f"{_TRIALS} select id, direction, phase from t where ok order by fitness desc, id limit 20"),
    "crossover_groups": (
        q_crossover_groups,
        f"{_TRIALS}, p as (select * from t where ok order by fitness desc, id limit 30) select a.id as id_a, b.id as id_b, round(2 * case when a.direction = b.direction then 1 else 2 end + case when a.phase = b.phase then 1 else 2 end + (a.fitness / 100000 + b.fitness / 100000) / 2, 6) + 0.0 as score from p a join p b on a.id < b.id order by 2 * case when a.direction = b.direction then 1 else 2 end + case when a.phase = b.phase then 1 else 2 end + (a.fitness / 100000 + b.fitness / 100000) / 2 desc, id_a, id_b limit 15",
    ),
    "ledger_replay": (
        q_ledger_replay,
        "with l as (select * from events where event_type in ('purchase', 'signup', 'error') qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select user_id, event_id from l where event_type <> 'error'",
    ),
    "former_traces": (
        q_former_traces,
        f"{_TRIALS}, k as (select *, coalesce(lag(ok) over (partition by direction order by day, id), false) as was from t), g as (select * from k where not (was and not ok)) select direction, id, row_number() over (partition by direction order by day desc, id desc) as n from g qualify n <= 3",
    ),
    "rank_score": (
        q_rank_score,
        f"{_CAND} select id, round(1 - (select count(*) from supplier where s_acctbal < cost) / (select count(*) from supplier), 6) + 0.0 as e from c",
    ),
    "overfit_score": (
        q_overfit,
        f"{_CAND}, f as (select id, 1 - least(1.0, case when n > 0 then n * 20.0 end / 300) as a, 1 - least(1.0, greatest(0.0, gap) / 0.5) as b from c where n > 0 union all select id, null, null from c where n = 0) select id, round(coalesce((a + b) / 2, 0.5), 6) + 0.0 as score from f",
    ),
    "utility": (
        q_utility,
        f"{_CAND}, f as (select id, (coalesce(quality * 0.5, 0) + coalesce(cost * 0.3, 0) + coalesce(gap * 0.2, 0)) / 1000 as u from c) select id, round(u, 6) + 0.0 as u, round(cume_dist() over (order by u), 6) + 0.0 as pct from f",
    ),
    "gates": (
        q_gates,
        f"{_CAND} select id, not coalesce(quality < 0.2, false) and not coalesce(cost > 9000, false) as passes, concat_ws('; ', case when quality < 0.2 then 'quality below 0.2' end, case when cost > 9000 then 'cost above 9000.0' end) as reasons from c",
    ),
    "pathology": (
        q_pathology,
        f"{PANEL_SQL}, g as (select instrument, count(x) / count(*) as cover, coalesce(stddev_pop(x), 0) as sd, case when stddev_pop(x) > 0 then corr(x, close) end as rho from r group by 1) select instrument, case when cover < 0.75 then 'coverage' when sd <= 0 then 'constant' when abs(rho) > 0.97 then 'duplicate' else 'none' end as why from g",
    ),
    "admission": (
        q_admission,
        f"{_CAND}, g as (select *, count(*) over (partition by nation) as held, avg(mean) over (partition by nation) as worst, case when n > 1 then sd / sqrt(n) else 'inf'::double end as se, mean - 150000 as m from c) select id, case when held < 50 and m > 0 then 'bootstrap' when not coalesce(m > se, false) then 'rejected' when held < 60 then 'admitted' when mean > worst then 'replaced' else 'no room' end as reason from g",
    ),
    "eviction": (
        q_eviction,
        "with f as (select s_nationkey as lib, s_suppkey, s_acctbal as v, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) as rk, count(*) over (partition by s_nationkey) as n from supplier) select lib, s_suppkey from f where v < 0 and n - rk >= 3",
    ),
    "shrinkage": (
        q_shrinkage,
        f"{_TRIALS}, m as (select direction, avg(fitness) as m, var_samp(fitness) / count(*) as se2 from t group by 1 having var_samp(fitness) is not null), g as (select avg(m) as mu, greatest(0, var_pop(m) - avg(se2)) as tau2 from m) select direction, round((mu + tau2 / (tau2 + se2) * (m - mu)) / 1000, 6) + 0.0 as v from m, g",
    ),
    "walk_forward": (
        q_walk_forward,
        f"{PANEL_SQL}, f as ({_FOLD_SQL}), e as (select fold, avg(x) as m, count(*) as n from r join f on datetime > t and datetime <= v group by 1) select round(avg(m), 6) + 0.0 as m, count(*) as folds, cast(sum(n) as bigint) as n from e",
    ),
    "ground_truth": (
        q_ground_truth,
        f"{PANEL_SQL}, b as (select x as w, case when volume > 20 then case when volume > 120 then x + 0.25 else x end end as g, volume > 20 as ig from r), f as (select count(*) filter (where ig) / count(*) as row_ratio, count(*) filter (where ig) / count(*) as index_jaccard, true as same_nulls, count(*) filter (where g is not null and w is not null and abs(g - w) < 1e-6) / count(*) filter (where g is not null and w is not null) as close_ratio, 0::bigint as n_inf, corr(g, w) as corr from b) select {_r('row_ratio', 'index_jaccard', 'close_ratio', 'corr', keep='same_nulls, n_inf')} from f",
    ),
    "unpivot": (q_unpivot, "select o_orderpriority, o_orderstatus as status, count(*) as n from orders where o_orderstatus in ('F', 'O', 'P') group by 1, 2"),
    "align_fill": (
        q_align_fill,
        "with a as (select c_custkey as k, sum(c_acctbal) as a from customer group by 1), b as (select o_custkey as k, sum(o_totalprice) as b from orders group by 1) select coalesce(a.k, b.k) as k, round(coalesce(a, 0.0), 2) as a, round(coalesce(b, 0.0), 2) as b from a full join b on a.k = b.k",
    ),
    "grid_join": (q_grid_join, f"{PANEL_SQL} select instrument, datetime, round(x, 6) + 0.0 as x from r"),
    "dynamic_mean": (
        q_dynamic_mean,
        f"{PANEL_SQL}, f as (select instrument, datetime, least(greatest(floor(volume / 20), 1), 12)::int as w, {_DYN} from r) select instrument, datetime, round({_DYN_CASE}, 6) + 0.0 as v from f",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
