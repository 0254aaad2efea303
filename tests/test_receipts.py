"""Receipt text: golden cases."""

import pytest
from pyspark.sql import functions as F

from leafwright.functions import receipts
from leafwright.operators import merge, ordering

SAMPLE = """みどり商店 駅前店
〒100-0001 東京都
TEL 03-1234-5678
登録番号 T7000012050002
2024年6月3日 12:34
レジ01 担当:佐藤
お茶 ¥220
弁当 ¥480
小計 ¥700
(10%対象 ¥220)
(8%対象 ¥480)
(内消費税等 ¥55)
合計 ¥700
お預り ¥1,000
お釣り ¥300"""


def ev(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(lines):
    return F.array(*map(F.lit, lines))


def text(t):
    return receipts.lines_of(F.lit(t))


def test_sample(spark):
    r = ev(spark, receipts.parse_column(F.lit(SAMPLE), 2026))
    assert (r["date"], r["payee"], r["total"], r["base10"], r["base8"], r["tax"], r["registration_no"]) == ("2024-06-03", "みどり商店 駅前店", 700, 220, 480, 55, "T7000012050002")
    assert r["evidence"]["total"] == "合計 ¥700" and r["evidence"]["base8"] == "(8%対象 ¥480)" and r["candidates"][0] == "みどり商店 駅前店" and len(r["candidates"]) <= 3


def test_lines(spark):
    assert ev(spark, text("ａ　 b\t c \r\n\n \u3000\nｶﾞ\x0b㈱\x85x")) == ["a b c", "ガ", "(株)", "x"]
    assert ev(spark, receipts.lines_of(F.lit(None).cast("string"))) == []


def test_dates(spark):
    for t in ("令和6年1月2日", "R6.1.2 12:00", "2024/1/2", "24/01/02", "２０２４年１月２日"):
        assert ev(spark, receipts.find_date(text(t), 2026))["value"] == "2024-01-02"


def test_date_rules(spark):
    find = lambda x: ev(spark, receipts.find_date(arr(x), 2026))["value"]
    assert find(["令和元年5月1日"]) == "2019-05-01"
    assert find(["2024/13/1", "24/2/30", "R6.2.3"]) == "2024-02-03"
    assert find(["2031/1/1"]) is None and find(["24/1/1", "2023/5/6"]) == "2023-05-06" and find(["x"]) is None


def test_totals(spark):
    find = lambda x: ev(spark, receipts.find_total(x))["value"]
    assert find(text("合計 \\1,234")) == 1234 and find(text("合計 Y980")) == 980
    assert find(text("小計 ¥500\nお預り ¥1,000")) is None
    assert find(arr(["合計", "¥77"])) == 77 and find(arr(["合計", "釣銭 77"])) is None and find(arr(["合計"])) is None
    assert find(arr(["計 5", "合計 9", "総額 7"])) == 9 and find(arr(["合計 1 2 3", "合計 9"])) == 3


def test_amounts(spark):
    # only what follows a number rules it out, and a number is read to its end first
    assert ev(spark, receipts.amounts(F.lit("10% 8:30 3点 1,234円 -5 99999999"))) == [30, 1234, -5]
    assert ev(spark, receipts.amounts(F.lit("1234年 1,234,567月 0 12,3456日 5-3個"))) == [12345, 5]


def test_tax(spark):
    x = arr(["(10%対象 ¥220) 55", "8% 課税 ¥3", "10%対象 9", "内消費税等 10% ¥5 ¥7", "税額 対象 8"])
    assert [ev(spark, receipts.find_tax(x, k))["value"] for k in ("base10", "base8", "tax")] == [220, 3, 7]


def test_payees(spark):
    x = arr(["A", "領収書", "本 12", "ABC DEF", "山川書店", "海の家です", "みどり薬局", "x" * 9 + " 12"])
    assert ev(spark, receipts.payee_candidates(x)) == ["山川書店", "みどり薬局", "ABC DEF"]


def test_registration(spark):
    ok = lambda n: ev(spark, receipts.check_digit(F.lit(n)))
    assert ok("T7000012050002") and ok("T1180301018771") and ok("T7000012050003") is False and ok("T1") is None
    find = lambda x: ev(spark, receipts.find_registration_no(arr(x)))["value"]
    assert find(["登録番号「17000012050002"]) == "T7000012050002" and find(["登録 12345678901234"]) == "T1234567890123"
    assert find(["登録 1", "番号 丁:1234-5678 90123"]) == "T1234567890123" and find(["T12345678901234"]) is None


def test_check_digit_column(spark):
    df = spark.createDataFrame([("T7000012050002",), ("T1180301018771",), ("T7000012050003",), ("T123",), (None,)], "no string")
    assert [r[0] for r in df.select(receipts.check_digit(F.col("no"))).collect()] == [True, True, False, None, None]


def test_coerce(spark):
    to = lambda k, v: tuple(ev(spark, receipts.coerce_column(k, F.lit(v).cast("string"), 2026)))
    assert to("total", "¥1,234円") == ("1234", None) and to("date", "2024/6/3") == ("2024-06-03", None) == to("date", "２０２４-6-3")
    assert to("registration_no", "T7000-0120-50002") == ("T7000012050002", None) and to("payee", "  ") == (None, None) == to("total", None)
    assert to("payee", " ㈱あ ") == ("(株)あ", None)
    for key, bad in (("registration_no", "T123"), ("total", "x"), ("date", "soon")):
        value, error = to(key, bad)
        assert value is None and error.endswith(bad)


def test_parse_column_survives_odd_rows(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, None), (3, ""), (4, "\x0b合計 5\x85"), (5, "合計 9" * 5000), (6, "合計\n" * 2000)], "id long, text string")
    got = {r.id: r.r for r in df.select("id", receipts.parse_column(F.col("text"), 2026).alias("r")).collect()}
    assert got[1].total == 700 and got[2].total is None and got[3].payee is None and got[4].total == 5


def test_wrong_is_flagged(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 700, "A", 220, 480, "T7000012050002"), (2, "", 0, " ", 1, 1, None), (3, None, 700, None, 100, 480, "T7000012050003")], "id long, date string, total long, payee string, a long, b long, no string")
    codes = {r.id: r.c for r in df.select("id", receipts.missing_codes(*map(F.col, ["date", "total", "payee", "a", "b", "no"])).alias("c")).collect()}
    assert codes[1] == [] and codes[2] == ["receipt_no_date", "receipt_no_total"] and codes[3] == ["receipt_no_date", "receipt_no_payee", "receipt_amount_mismatch", "receipt_regno_suspect"]


def test_overlay_and_merge(spark):
    rec = spark.createDataFrame([("p1", {"total": "700", "payee": "A"}, {"payee": "B"}), ("p2", {"total": "5"}, None)], "id string, auto map<string,string>, manual map<string,string>")
    got = {r.id: (r.total, r.payee) for r in merge.effective(rec).collect()}
    assert got == {"p1": ("700", "B"), "p2": ("5", None)}
    cols = "id string, state string, " + ", ".join(f"{k} string" for k in receipts.FIELDS)
    row = lambda i, state, **x: (i, state, *[x.get(k) for k in receipts.FIELDS])
    cells = spark.createDataFrame([row("p1", "AI確認", total="700", payee=""), row("p2", "", total="なし", note="読めない"), row("p9", "")], cols)
    m = {r.id: r for r in merge.merge_list(rec, cells, 2026).collect()}
    assert m["p1"].status == "changed" and m["p1"].manual == {} and m["p1"].manual_source is None and len(m["p1"].acks) == 4
    assert m["p2"].manual == {"note": "読めない"} and m["p2"].errors and m["p2"].acks == ["receipt_no_date", "receipt_no_payee"] and m["p2"].manual_source == "import"
    assert m["p9"].status == "error"


def test_preset(spark):
    got = dict(merge.settings(spark, {"layout": "spread", "margins": "content_box"}, {"layout": "single", "margins": "detect"}, {"margins": "content_box", "x": None}).collect())
    assert got == {"layout": "single", "margins": "detect"}


def test_sort(spark):
    df = spark.createDataFrame([("a", "b b", "2024-02-01", 0), ("b", None, "2024-01-01", 1), ("c", "bb", "2024-01-05", 2), ("d", "", None, 3)], "id string, payee string, date string, pos int")
    order = lambda by: [r.id for r in ordering.receipt_sort(df, by).orderBy("pos").collect()]
    assert order("date") == ["b", "c", "a", "d"] and order("payee") == ["c", "a", "b", "d"] == order("payee_date") and order("shot") == list("abcd")
    with pytest.raises(ValueError):
        order("size")


def test_a_carriage_return_ends_no_latin_word(spark):
    from leafwright.operators import words

    w = spark.createDataFrame([(1, 0, 1, 0, 0, 0, 0, 90, 12, "ab\r"), (1, 0, 1, 0, 1, 100, 1, 90, 12, "cd"), (1, 0, 1, 0, 2, 200, 2, 90, 12, "éx"), (1, 0, 1, 0, 3, 300, 2, 90, 12, "9")],
                              "page_id long, block long, par int, line long, word int, left int, top long, width int, height int, text string")
    p = words.placed(w, 800, 4000, 595.0, 842.0)
    assert [r.token for r in p.orderBy("word").collect()] == ["ab\r", "cd", "éx ", "9"]
    assert p._jdf.queryExecution().executedPlan().toString().count("Window [") == 1


def test_names_are_looked_for_once(spark):
    assert all(any(x in cue for x in receipts.CUE_LETTERS) for cue in receipts.TOTAL_CUES)
    plan = spark.range(1).select(receipts.parse_column(F.lit("x"), 2026).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("レシート") == 1


def test_numbers_of_many_stretches(spark):
    """Half of the rows have one key, the others one each: stretches are of like size all the same."""
    rows = spark.range(5_000).selectExpr("id * 7919 % 5000 AS was", "CASE WHEN id % 2 = 0 THEN 'same' WHEN id % 31 = 0 THEN NULL ELSE concat('n', id % 997, 'é') END AS name").cache()
    got = ordering.numbered(rows, [F.col("name").isNull(), F.col("name")], ["was"], start=1, some=100)
    want = sorted(map(tuple, rows.select("was", "name").collect()), key=lambda r: (r[1] is None, r[1] or "", r[0]))
    assert [(r.was, r.name, r.pos) for r in got.orderBy("pos").collect()] == [(*r, i) for i, r in enumerate(want, 1)]
    bounds = ordering._bounds(rows.select(F.struct(F.col("name").isNull().alias("k0"), F.col("name").alias("k1"), F.col("was").alias("k2")).alias("__key")), 256, 100)
    sizes = [r[1] for r in rows.groupBy(ordering._stretch(F.struct(F.col("name").isNull().alias("k0"), F.col("name").alias("k1"), F.col("was").alias("k2")), [F.struct(F.lit(b[0]).alias("k0"), F.lit(b[1]).cast("string").alias("k1"), F.lit(b[2]).cast("long").alias("k2")) for b in bounds])).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 300


def test_the_row_before_where_most_rows_have_one_key(spark):
    rows = spark.range(3_000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 7 > 0 THEN concat('k', id % 11) END AS k", "concat('v', id) AS v").cache()
    got = ordering.with_previous(rows, "k", "id", "v", "was", some=100)
    want, seen = {}, {}
    for r in sorted(rows.collect()):
        want[r.id] = (seen.get(r.k), r.k in seen)
        seen[r.k] = r.v
    assert {r.id: (r.was, r.has_was) for r in got.collect()} == want
    assert "windowspecdefinition(k#" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_that_are_nowhere(spark):
    from leafwright.functions import scalars

    row = spark.createDataFrame([("ab cde\nfg  hij", ["ab", "d", "bc", "hij", "fgh", "e\r"])], "text string, terms array<string>")
    assert row.select(scalars.not_found(F.col("text"), F.col("terms"))).first()[0] == [2, 4, 5]
