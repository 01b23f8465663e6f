from pyspark.sql import functions as F

from canonspark.operators import profile as PF


def test_profile_edge_rows(spark):
    rows = [(i, v, b) for i, (v, b) in enumerate(
        [("-5", None), ("1.5", ""), ("1.2.3", " "), ("5.", None), ("1e5", None), (".", None)])]
    df = spark.createDataFrame(rows, "row_id long, v string, blank string")
    got = {r.name: r for r in PF.profile_columns(df).collect()}
    # 2 of 6 numeric -> not numeric; 6 distinct of 6 -> text; one word each -> short text
    assert got["v"].type == "text" and got["v"].isShortText
    assert got["v"].sampleValues == ["-5", "1.5", "1.2.3", "5.", "1e5"]
    b = got["blank"]
    assert b.type == "categorical" and not b.important and b.missingCount == 6
    assert b.sampleValues == []


def test_preview_and_limit(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "row_id long, v string")
    out = PF.preview_rows(df, "abc").collect()
    assert [(r.row_id, r.v) for r in out] == [(1, "x"), (2, "")]
    assert PF.parse_limit("all") is None and PF.parse_limit("7") == 7


def test_analyze_csv(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("brand,,n\nAcme,x,1\nNA,y,2\nacme,,3\n")
    prof, prev, shape = PF.analyze_csv(spark, str(p), limit="2")
    rows = {r.col_ord: r for r in prof.collect()}
    assert [rows[i].name for i in range(3)] == ["brand", "", "n"]
    assert rows[0].missingCount == 1 and rows[1].missingCount == 1
    assert rows[2].type == "numeric"
    assert prev.count() == 2
    s = shape.first()
    assert (s.rows, s.columns) == (3, 3)


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, `a.b` string, n int")
    got = {r.name: r for r in PF.profile_columns(df).collect()}
    assert set(got) == {"a.b", "n"}
    assert (got["n"].type, got["n"].missingCount, got["n"].sampleValues, got["n"].important) == ("categorical", 0, [], False)


def test_spellings_of_a_type_are_one_value(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("whole,gaps,num,flag,text,none\n"
                 "1,1,1,True,1,\n01,,1.0,false,x,NA\n+1,01,01,TRUE,1.0,\n 2,2,1e0,true,01,\n")
    prof, prev, _ = PF.analyze_csv(spark, str(p))
    got = {r.name: (r.uniqueCount, r.sampleValues, r.type) for r in prof.collect()}
    assert got["whole"] == (2, ["1", "2"], "numeric") and got["gaps"][:2] == (2, ["1.0", "2.0"])
    assert got["num"][:2] == (1, ["1.0"]) and got["flag"][:2] == (2, ["True", "False"])
    assert got["text"][0] == 4 and got["none"][0] == 0
    assert [r.gaps for r in prev.collect()] == ["1.0", "", "1.0", "2.0"]
    assert PF.analyze_csv(spark, str(p), infer=False)[0].where("name = 'num'").first().uniqueCount == 4


def test_float_texts(spark):
    """As the shortest text of a double that reads back equal."""
    values = [0.0, 1.0, -2.5, 0.001, 0.00012, 1e-05, 1.5e-07, 9999999.0, 1e7, 12345678.0, 12345678.5, 123456789012345.0,
              1e15, 1e16, 1.5e16, 1e22, 1.25e300, float("inf"), float("-inf"), 0.1, 1234567.891]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(PF._float_text(F.col("v"))).collect()]
    assert got == [str(v) for v in values]


def test_sketches_of_parts_combine(spark):
    """Parts in any order, merged step by step, against the exact profile; the estimate within
    five standard errors."""
    rows = [(i, f"v{i % 7}" if i % 11 else None, str(i), f"two words {i % 19}", "x" if i % 2 else " ", None) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id long, few string, num string, cats string, blank string, none string")
    parts = [PF.sketch_columns(df.where(f"row_id >= {a} and row_id < {a + 2000}"), k) for k, a in enumerate((0, 2000, 4000))]
    merged = PF.merge_sketches(PF.merge_sketches(parts[2].unionByName(parts[0])).unionByName(parts[1]))
    got = {r.name: r.asDict() for r in PF.profile_from_sketch(merged).collect()}
    want = {r.name: r.asDict() for r in PF.profile_columns(df).collect()}
    assert abs(got["num"].pop("uniqueCount") - want["num"].pop("uniqueCount")) <= 5 * 0.013 * 6000
    assert got == want
