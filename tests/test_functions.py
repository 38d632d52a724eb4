"""Text rules, lenient numerics and fills on hand-written edge rows."""
from pyspark.sql import functions as F

from hazardlake.functions import aml_rule_flags, cyto_features, to_number
from hazardlake.operators.tables import fill_all


def test_cyto_features_edge_rows(spark):
    rows = [(1, "46,XX"), (2, " 46,XY\t"), (3, "46,XX[20]"), (4, "45,XY,-70"), (5, None), (6, "47,XX,+8,t(9;22)"),
            (7, "46,xy,del(5q),inv(3)(q21q26),+21,-7")]
    df = spark.createDataFrame(rows, "ID int, CYTOGENETICS string")
    out = {r["ID"]: r for r in df.select("ID", *[v.alias(k) for k, v in cyto_features("CYTOGENETICS").items()]).collect()}
    assert out[1]["cyto_is_normal_karyotype"] == 1
    assert out[2]["cyto_is_normal_karyotype"] == 1          # any whitespace stripped
    assert out[3]["cyto_is_normal_karyotype"] == 0          # exact form only
    assert out[4]["cyto_has_monosomy_7"] == 1               # substring: -7 hits -70
    assert out[5]["cyto_n_abnormalities"] == 0 and out[5]["cyto_is_normal_karyotype"] == 0
    assert out[6]["cyto_has_trisomy_8"] == 1 and out[6]["cyto_has_translocation"] == 1
    assert out[7]["cyto_n_abnormalities"] == 4              # del( inv( +21 -7


def test_rule_flags_remove_spaces(spark):
    df = spark.createDataFrame([(1, "46,XX, t(15; 17)"), (2, "Complex karyotype"), (3, "13q")], "ID int, c string")
    out = {r["ID"]: r for r in df.select("ID", *[v.alias(k) for k, v in aml_rule_flags("c").items()]).collect()}
    assert out[1]["cyto_has_t15_17"] == 1
    assert out[2]["cyto_has_complex"] == 1
    assert out[3]["cyto_has_3q_abn"] == 1                   # "3q" is a substring of "13q"


def test_to_number_is_lenient(spark):
    df = spark.createDataFrame([("0.5",), ("abc",), ("1.5d",), (" 2 ",), ("1e-3",), (None,), ("NaN",)], "v string")
    got = [r[0] for r in df.select(to_number("v")).collect()]
    assert got == [0.5, None, None, 2.0, 0.001, None, None]


def test_fill_all_fills_strings_with_zero_text(spark):
    df = spark.createDataFrame([(1, None, None, float("nan"))], "ID int, s string, x double, y double")
    r = fill_all(df).collect()[0]
    assert r["s"] == "0" and r["x"] == 0.0 and r["y"] == 0.0


def test_tfidf_by_text_equals_per_document(spark):
    from hazardlake.operators.textvec import char_ngrams, tfidf, tfidf_by_text
    rows = [(1, "46,XX"), (2, "46,XX"), (3, "45,xy,-7  del(5q)"), (4, "complex"), (5, "46,XX"), (6, "ab")]
    docs = spark.createDataFrame(rows, "ID int, txt string")
    a = {(r["ID"], r["term"]): r["weight"] for r in tfidf(char_ngrams(docs, "ID", "txt"), docs, "ID", 20).collect()}
    b = {(r["ID"], r["term"]): r["weight"] for r in tfidf_by_text(docs, "ID", "txt", 20).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_csv_loaders_schema_and_nulls(spark, tmp_path):
    import pandas as pd

    from hazardlake.operators.aggregates import entity_features
    from hazardlake.sources import load_all

    d = tmp_path
    pd.DataFrame({"ID": ["P1", "P2"], "CENTER": ["A", None], "BM_BLAST": [1.0, float("nan")], "WBC": [2.0, 3.0],
                  "ANC": [1.0, 1.0], "MONOCYTES": [0.1, 0.2], "HB": [9.0, 10.0], "PLT": [100.0, None],
                  "CYTOGENETICS": ["46,XX", None]}).to_csv(d / "clinical_train.csv", index=False)
    pd.DataFrame({"ID": ["P3"], "CENTER": ["B"], "BM_BLAST": [0.5], "WBC": [1.0], "ANC": [1.0], "MONOCYTES": [0.1],
                  "HB": [11.0], "PLT": [90.0], "CYTOGENETICS": ["complex"]}).to_csv(d / "clinical_test.csv", index=False)
    mol = pd.DataFrame({"ID": ["P1", "P1", "P2"], "CHR": ["1", "2", "3"], "START": [1, 2, 3], "END": [2, 3, 4],
                        "REF": ["A", "C", "G"], "ALT": ["T", "G", "A"], "GENE": ["TP53", "TET2", "TP53"],
                        "PROTEIN_CHANGE": ["x", "y", "z"], "EFFECT": ["stop", "missense", "stop"],
                        "VAF": ["0.4", "abc", "0.05"], "DEPTH": ["100", "200", ""]})
    mol.to_csv(d / "molecular_train.csv", index=False)
    mol.iloc[:0].to_csv(d / "molecular_test.csv", index=False)
    pd.DataFrame({"ID": ["P1", "P2"], "OS_YEARS": [1.5, None], "OS_STATUS": [1.0, 0.0]}).to_csv(
        d / "target_train.csv", index=False)
    t = load_all(spark, str(d))
    clin = {r["ID"]: r for r in t["clinical_train"].collect()}
    assert clin["P2"]["BM_BLAST"] is None and clin["P2"]["PLT"] is None and clin["P1"]["HB"] == 9.0
    assert t["clinical_test"].count() == 1 and t["target_train"].count() == 2
    f = {r["ID"]: r for r in entity_features(t["molecular_train"], gene_list=["TP53"], effect_list=[]).collect()}
    assert f["P1"]["vaf_mean"] == 0.4 and f["P1"]["n_mut"] == 2 and f["P2"]["depth_max"] == 0.0
