import math

from riskframe.functions import pvalues
from riskframe.operators import stats


def test_pvalue_special_functions():
    # two-sided normal, chi-square, t and F tail values from standard tables
    assert abs(pvalues.norm_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(pvalues.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(pvalues.chi2_sf(5.991465, 2) - 0.05) < 1e-6
    assert abs(pvalues.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(pvalues.f_sf(4.964603, 1, 10) - 0.05) < 1e-6
    assert math.isnan(pvalues.t_two_sided(float("nan"), 3))


def test_mann_whitney_ties_tiny(spark):
    # pos = [1, 2, 2], neg = [2, 3]; mid-ranks 1, 3, 3 | 3, 5 -> R1 = 7, U1 = 7 - 6 = 1
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (0, 2.0), (0, 3.0), (2, 9.0), (1, None)],
                               "label int, x double")
    r = stats.mann_whitney(df, "label", ["x"], with_p=True).collect()[0]
    t = stats.t_test(df, "label", ["x"], with_p=True).collect()[0]
    assert r["n_pos"] == 3 and r["n_neg"] == 2
    assert r["u_stat"] == 1.0
    assert abs(r["mean_pos"] - 5 / 3) < 1e-4 and r["mean_neg"] == 2.5
    assert 0 <= r["u_p"] <= 1 and 0 <= t["t_p"] <= 1 and t["dof"] == 3
    # ss = 2/3 + 1/2, pooled variance 0.38889, t = -0.83333 / 0.56928
    assert abs(t["t_stat"] + 1.4639) < 1e-4


def test_chi_square_yates(spark):
    # 2x2 table [[10, 20], [30, 5]]: Yates-corrected chi2 = 19.0257 (hand computed)
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 5
    df = spark.createDataFrame(rows, "g string, label int")
    r = stats.chi_square(df, "label", ["g"], with_p=True).collect()[0]
    o = [[10, 20], [30, 5]]
    n = 65
    rt = [30, 35]
    ct = [40, 25]
    chi = sum((max(abs(o[i][j] - rt[i] * ct[j] / n) - 0.5, 0)) ** 2 / (rt[i] * ct[j] / n)
              for i in range(2) for j in range(2))
    assert r["dof"] == 1 and abs(r["chi2"] - round(chi, 4)) < 1e-4
    assert r["p_value"] < 0.001


def test_kruskal_and_anova_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 5.0), ("c", 6.0)],
                               "g string, x double")
    h = stats.kruskal_wallis(df, "g", ["x"]).collect()[0]
    # ranks 1..6, R = 3, 7, 11 -> H = 12/42 * (9+49+121)/2 - 21 = 4.5714
    assert abs(h["h_stat"] - 4.5714) < 1e-4 and h["dof"] == 2
    f = stats.anova_f(df, "g", ["x"]).collect()[0]
    # group means 1.5, 3.5, 5.5; ssb = 16, ssw = 1.5 -> F = (16/2) / (1.5/3) = 16
    assert abs(f["f_stat"] - 16.0) < 1e-6
