"""Hypothesis tests between label classes, computed from aggregated tables.

Every test unpivots the features once to ``(feature, value, label)``,
pre-aggregates to one row per ``(feature, value[, label])`` (map-side partial
aggregation absorbs hot values), and derives the statistic from that table.
p-values are added on the final one-row-per-feature result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import pvalues
from riskframe.functions.columns import attach_scalars, dbl, sdiv, unpivot_numeric, unpivot_string
from riskframe.operators.ranks import mid_ranks


def _value_counts(df: DataFrame, label: str, features: list[str], positive=1, negative=0) -> DataFrame:
    """(feature, value, n, n_pos) over rows whose label is positive or negative."""
    long = (unpivot_numeric(df.select(label, *features), [label], features)
            .where(F.col("value").isNotNull() & F.col(label).isin(positive, negative)))
    return (long.groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col(label) == positive, 1).otherwise(0)).alias("n_pos")))


def mann_whitney(df: DataFrame, label: str, features: list[str], positive=1, negative=0,
                 with_p: bool = False) -> DataFrame:
    """Mann-Whitney U of the positive class per feature, with mid-ranks for ties.

    Output (one row per feature): n_pos, n_neg, mean_pos, mean_neg (4 dp),
    u_stat and u_z, the tie- and continuity-corrected normal score of
    max(U1, U2); with ``with_p`` also u_p (two-sided).
    """
    counts = _value_counts(df, label, features, positive, negative)
    ranked = mid_ranks(counts, ["feature"], "value", "n")
    n_neg = F.col("n") - F.col("n_pos")
    per = (ranked.groupBy("feature").agg(
        F.sum("n_pos").alias("n1"),
        F.sum(n_neg).alias("n0"),
        F.sum(F.col("mid_rank") * F.col("n_pos")).alias("r1"),
        F.sum(F.pow(dbl("n"), 3) - dbl("n")).alias("ties"),
        F.sum(F.col("value") * F.col("n_pos")).alias("s1"),
        F.sum(F.col("value") * n_neg).alias("s0")))
    n1, n0 = dbl("n1"), dbl("n0")
    n = n1 + n0
    u1 = F.col("r1") - n1 * (n1 + 1.0) / 2.0
    mu = n1 * n0 / 2.0
    sigma = F.sqrt(n1 * n0 / 12.0 * ((n + 1.0) - F.try_divide(F.col("ties"), n * (n - 1.0))))
    z = F.try_divide(F.greatest(u1, n1 * n0 - u1) - mu - 0.5, sigma)
    out = per.select("feature", F.col("n1").cast("long").alias("n_pos"), F.col("n0").cast("long").alias("n_neg"),
                     F.round(sdiv("s1", "n1"), 4).alias("mean_pos"), F.round(sdiv("s0", "n0"), 4).alias("mean_neg"),
                     F.round(u1, 4).alias("u_stat"), F.round(z, 4).alias("u_z"), z.alias("_z"))
    if with_p:
        out = out.withColumn("u_p", F.round(pvalues.normal_p(F.greatest(F.col("_z"), F.lit(0.0))), 6))
    return out.drop("_z")


def t_test(df: DataFrame, label: str, features: list[str], positive=1, negative=0, with_p: bool = False) -> DataFrame:
    """Equal-variance two-sample t per feature: one partial aggregate per (feature, class).

    Output (one row per feature): n_pos, n_neg, mean_pos, mean_neg (4 dp),
    t_stat (4 dp), dof = n_pos + n_neg - 2; with ``with_p`` also t_p.
    """
    long = (unpivot_numeric(df.select(label, *features), [label], features)
            .where(F.col("value").isNotNull() & F.col(label).isin(positive, negative)))

    def of(cls, name: str):
        v = F.when(F.col(label) == cls, F.col("value"))
        return [F.count(v).alias(f"n{name}"), F.avg(v).alias(f"m{name}"), F.var_pop(v).alias(f"v{name}")]

    r = long.groupBy("feature").agg(*of(positive, "1"), *of(negative, "0"))
    n1, n0 = dbl("n1"), dbl("n0")
    dof = n1 + n0 - 2.0
    pooled = F.try_divide(F.col("v1") * n1 + F.col("v0") * n0, dof)
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0))))
    out = r.select("feature", F.col("n1").alias("n_pos"), F.col("n0").alias("n_neg"), F.round("m1", 4).alias("mean_pos"),
                   F.round("m0", 4).alias("mean_neg"), F.round(t, 4).alias("t_stat"), dof.cast("long").alias("dof"),
                   t.alias("_t"))
    if with_p:
        out = out.withColumn("t_p", F.round(pvalues.t_p(F.abs(F.col("_t")), F.col("dof")), 6))
    return out.drop("_t")


def chi_square(df: DataFrame, label: str, features: list[str], with_p: bool = False) -> DataFrame:
    """Pearson chi-square of independence between each feature and the label.

    Contingency cells are counts per (feature, value, label) over rows where
    both are non-null; expected = row total x column total / n. With one
    degree of freedom the Yates correction min(0.5, |O-E|) is applied. Output: feature, chi2 (4 dp), dof.
    """
    long = (unpivot_string(df.select(label, *features), [label], features)
            .where(F.col("value").isNotNull() & F.col(label).isNotNull())
            .withColumn("lab", F.col(label).cast("string")))
    cells = long.groupBy("feature", "value", "lab").agg(F.count(F.lit(1)).alias("o"))
    # Row and column totals are joined to the cells that occur; empty cells need no row:
    # sum((o - e)^2 / e) = n (sum(o^2 / (rt ct)) - 1).
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("rt"))
    cols = cells.groupBy("feature", "lab").agg(F.sum("o").alias("ct"))
    nr = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("nr"))
    nc = cols.groupBy("feature").agg(F.count(F.lit(1)).alias("nc"), F.sum("ct").alias("nt"))
    s = (cells.join(rows, ["feature", "value"]).join(cols, ["feature", "lab"]).groupBy("feature")
         .agg(F.sum(dbl("o") * dbl("o") / (dbl("rt") * dbl("ct"))).alias("q"),
              F.max(F.struct(F.col("o"), F.col("rt"), F.col("ct"))).alias("_cell"))
         .join(nr, "feature").join(nc, "feature"))
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    # In a 2 x 2 table every cell is equally far from its expectation, so one cell gives the corrected sum:
    # (|o - e| - min(0.5, |o - e|))^2 (1/e11 + ... + 1/e22) = d^2 n^3 / (r1 r2 c1 c2).
    n, o, rt, ct = dbl("nt"), dbl("_cell.o"), dbl("_cell.rt"), dbl("_cell.ct")
    far = F.abs(o - rt * ct / n)
    d = F.greatest(far - 0.5, F.lit(0.0))
    yates = F.try_divide(d * d * n * n * n, rt * (n - rt) * ct * (n - ct))
    plain = F.greatest(n * (F.col("q") - 1.0), F.lit(0.0))
    chi2 = F.when(dof == 1, yates).otherwise(plain)
    res = s.select("feature", F.round(chi2, 4).alias("chi2"), dof.cast("long").alias("dof"), chi2.alias("_chi2"))
    if with_p:
        res = res.withColumn("p_value", F.round(pvalues.chi2_p(F.col("_chi2"), F.col("dof")), 6))
    return res.drop("_chi2")


def anova_f(df: DataFrame, group: str, features: list[str], with_p: bool = False) -> DataFrame:
    """One-way ANOVA F of each feature across the groups of ``group``.

    Between/within sums of squares from per-group count, mean and centred
    sum of squares. Output: feature, k groups, n, f_stat (4 dp), df_between,
    df_within.
    """
    long = (unpivot_numeric(df.select(group, *features), [group], features)
            .where(F.col("value").isNotNull() & F.col(group).isNotNull()))
    g = long.groupBy("feature", group).agg(F.count(F.lit(1)).alias("ng"), F.avg("value").alias("mg"),
                                           (F.var_pop("value") * F.count(F.lit(1))).alias("ssw_g"))
    tot = g.groupBy("feature").agg(F.sum("ng").alias("n"), F.count(F.lit(1)).alias("k"),
                                   F.try_divide(F.sum(F.col("mg") * F.col("ng")), F.sum("ng")).alias("gm"))
    j = g.join(tot, "feature")
    res = j.groupBy("feature", "n", "k").agg(
        F.sum(F.col("ng") * F.pow(F.col("mg") - F.col("gm"), 2)).alias("ssb"),
        F.sum("ssw_g").alias("ssw"))
    dfb = F.col("k") - 1
    dfw = F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("ssb"), dfb), F.try_divide(F.col("ssw"), dfw))
    out = res.select("feature", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"),
                     F.round(f, 4).alias("f_stat"), dfb.cast("long").alias("df_between"),
                     dfw.cast("long").alias("df_within"), f.alias("_f"))
    if with_p:
        out = out.withColumn("p_value", F.round(pvalues.f_p(F.col("_f"), F.col("df_between"), F.col("df_within")), 6))
    return out.drop("_f")


def kruskal_wallis(df: DataFrame, group: str, features: list[str],
                   with_p: bool = False) -> DataFrame:
    """Kruskal-Wallis H with tie correction, per feature, across ``group``.

    H = (12 / (n (n+1)) * sum_g R_g^2 / n_g - 3 (n+1)) / (1 - sum(t^3 - t) / (n^3 - n)).
    Output: feature, k, n, h_stat (4 dp), dof = k - 1.
    """
    long = (unpivot_numeric(df.select(group, *features), [group], features)
            .where(F.col("value").isNotNull() & F.col(group).isNotNull()))
    cells = long.groupBy("feature", "value", group).agg(F.count(F.lit(1)).alias("ng"))
    counts = cells.groupBy("feature", "value").agg(F.sum("ng").alias("n"))
    ranked = mid_ranks(counts, ["feature"], "value", "n")
    ties = ranked.groupBy("feature").agg(F.sum("n").alias("nt"),
                                         F.sum(F.pow(dbl("n"), 3) - dbl("n")).alias("tt"))
    rg = (cells.join(ranked.select("feature", "value", "mid_rank"), ["feature", "value"])
          .groupBy("feature", group).agg(F.sum(F.col("mid_rank") * F.col("ng")).alias("rg"),
                                         F.sum("ng").alias("ng")))
    s = rg.groupBy("feature").agg(F.sum(F.pow("rg", 2) / dbl("ng")).alias("srn"),
                                  F.count(F.lit(1)).alias("k")).join(ties, "feature")
    n = dbl("nt")
    h0 = 12.0 / (n * (n + 1.0)) * F.col("srn") - 3.0 * (n + 1.0)
    h = F.try_divide(h0, 1.0 - F.try_divide(F.col("tt"), F.pow(n, 3) - n))
    out = s.select("feature", F.col("k").cast("long").alias("k"), F.col("nt").cast("long").alias("n"),
                   F.round(h, 4).alias("h_stat"), F.greatest(F.col("k") - 1, F.lit(0)).cast("long").alias("dof"), h.alias("_h"))
    if with_p:
        out = out.withColumn("p_value", F.round(pvalues.chi2_p(F.col("_h"), F.col("dof")), 6))
    return out.drop("_h")


def mcnemar(pairs: DataFrame, a: str, b: str, label: str, with_p: bool = False) -> DataFrame:
    """McNemar test between two classifiers' 0/1 predictions ``a`` and ``b``.

    Discordant counts: b01 = a right & b wrong, b10 = a wrong & b right;
    chi2 = (|b01 - b10| - 1)^2 / (b01 + b10) (continuity corrected).
    """
    ra = F.col(a) == F.col(label)
    rb = F.col(b) == F.col(label)
    r = pairs.agg(F.count_if(ra & ~rb).alias("b01"), F.count_if(~ra & rb).alias("b10"),
                  F.count(F.lit(1)).alias("n"))
    stat = F.try_divide(F.pow(F.greatest(F.abs(F.col("b01") - F.col("b10")) - 1, F.lit(0)), 2),
                        dbl("b01") + dbl("b10"))
    out = r.select(F.col("n").cast("long").alias("n"), F.col("b01").cast("long").alias("b01"),
                   F.col("b10").cast("long").alias("b10"), F.round(stat, 4).alias("chi2"), stat.alias("_s"))
    if with_p:
        out = out.withColumn("p_value", F.round(pvalues.chi2_p(F.col("_s"), F.lit(1.0)), 6))
    return out.drop("_s")


def wilcoxon_signed_rank(pairs: DataFrame, group: str, x: str, y: str,
                         with_p: bool = False) -> DataFrame:
    """Wilcoxon signed-rank per ``group`` for paired columns x, y.

    Zero differences are dropped (Wilcox rule); |d| gets mid-ranks; W+ and W-
    are the rank sums of positive / negative differences; statistic =
    min(W+, W-); z uses the tie-corrected variance
    n(n+1)(2n+1)/24 - sum(t^3 - t)/48.
    """
    d = (pairs.select(group, (dbl(x) - dbl(y)).alias("d")).where(F.col("d").isNotNull() & (F.col("d") != 0)))
    counts = (d.groupBy(group, F.abs("d").alias("value"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_plus")))
    ranked = mid_ranks(counts, [group], "value", "n")
    s = ranked.groupBy(group).agg(
        F.sum("n").alias("nn"),
        F.sum(F.col("mid_rank") * F.col("n_plus")).alias("wp"),
        F.sum(F.col("mid_rank") * (F.col("n") - F.col("n_plus"))).alias("wm"),
        F.sum(F.pow(dbl("n"), 3) - dbl("n")).alias("tt"))
    n = dbl("nn")
    mu = n * (n + 1.0) / 4.0
    var = n * (n + 1.0) * (2.0 * n + 1.0) / 24.0 - F.col("tt") / 48.0
    w = F.least("wp", "wm")
    z = F.try_divide(F.abs(w - mu), F.sqrt(var))
    out = s.select(group, F.col("nn").cast("long").alias("n"), F.round("wp", 4).alias("w_plus"),
                   F.round("wm", 4).alias("w_minus"), F.round(w, 4).alias("w_stat"),
                   F.round(z, 4).alias("z"), z.alias("_z"))
    if with_p:
        out = out.withColumn("p_value", F.round(pvalues.normal_p(F.col("_z")), 6))
    return out.drop("_z")


def friedman(long: DataFrame, block: str, treatment: str, value: str, with_p: bool = False) -> DataFrame:
    """Friedman chi-square over blocks (rows) x treatments (columns).

    ``long`` has one row per (block, treatment) with a ``value``. Ranks are
    taken within each block by a window per block (a block holds one row per
    treatment, so tasks stay small). Blocks missing a treatment are dropped.
    Tie correction divides by 1 - sum(t^3 - t) / (b k (k^2 - 1)). Without a
    complete block there is no statistic.
    """
    v = long.where(F.col(value).isNotNull())
    k = v.agg(F.count_distinct(treatment).alias("k"))
    per_block = v.groupBy(block).agg(F.count(F.lit(1)).alias("kb"))
    complete = attach_scalars(per_block, k).where(F.col("kb") == F.col("k")).select(block)
    v = v.join(complete, block, "left_semi")
    ranked = (v.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(block, value)))
              .withColumn("_r", F.rank().over(Window.partitionBy(block).orderBy(value)).cast("double"))
              .withColumn("mid", F.col("_r") + (dbl("_t") - 1.0) / 2.0))
    blocks = (ranked.groupBy(block, value).agg(F.count(F.lit(1)).alias("t"))
              .groupBy(block).agg(F.sum(F.pow(dbl("t"), 3) - dbl("t")).alias("tt_b"))
              .agg(F.count(F.lit(1)).alias("b"), F.sum("tt_b").alias("tt")))
    rs = (ranked.groupBy(treatment).agg(F.sum("mid").alias("rj"))
          .agg(F.sum(F.pow("rj", 2)).alias("srj"), F.count(F.lit(1)).alias("k")))
    s = attach_scalars(rs, blocks)
    bb, kk = dbl("b"), dbl("k")
    q = 12.0 / (bb * kk * (kk + 1.0)) * F.col("srj") - 3.0 * bb * (kk + 1.0)
    q = F.try_divide(q, 1.0 - F.try_divide(F.col("tt"), bb * kk * (kk * kk - 1.0)))
    out = s.select(F.col("b").cast("long").alias("blocks"), F.col("k").cast("long").alias("k"),
                   F.round(q, 4).alias("q_stat"), F.greatest(F.col("k") - 1, F.lit(0)).cast("long").alias("dof"), q.alias("_q"))
    if with_p:
        out = out.withColumn("p_value", F.round(pvalues.chi2_p(F.col("_q"), F.col("dof")), 6))
    return out.drop("_q")


def rank_by_p(results: DataFrame, p: str, out: str = "p_rank") -> DataFrame:
    """Add the rank by ascending p-value, then feature name (one row per feature)."""
    return results.withColumn(out, F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last(), "feature")))


def significance_label(p) -> "F.Column":
    """p < .01 highly significant, p < .05 significant, else not significant."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p < 0.01, "highly significant").when(p < 0.05, "significant")
            .otherwise("not significant"))
