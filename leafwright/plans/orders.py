"""Queries of the receipt operators over orders, lineitem, customer and part. A receipt is rendered from each order in SQL
and read back by the parser; the oracle takes the truth straight from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import receipts
from ..operators import merge, ordering

YEAR = 2030


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _registration(key):
    """T, a check digit and twelve digits of the key."""
    body = F.lpad(key.cast("string"), 12, "0")
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2)), F.lit(0), lambda a, x: a + x)
    return F.concat(F.lit("T"), (F.lit(9) - total % 9).cast("string"), body)


def truth(spark, sf_dir) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    total = F.floor("o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 360), "yyyy-MM-dd").alias("date"), F.concat("c_name", F.lit(" 商店")).alias("payee"), total.alias("total"),
                    (total - F.floor(total / 3)).alias("base10"), F.floor(total / 3).alias("base8"), F.floor(total / 11).alias("tax"), _registration(F.col("c_custkey")).alias("registration_no"))


TRUTH = """tr AS (SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR, '%Y-%m-%d') AS date, c_name || ' 商店' AS payee, CAST(floor(o_totalprice) AS BIGINT) AS total,
  CAST(floor(o_totalprice) - floor(floor(o_totalprice) / 3) AS BIGINT) AS base10, CAST(floor(floor(o_totalprice) / 3) AS BIGINT) AS base8, CAST(floor(floor(o_totalprice) / 11) AS BIGINT) AS tax,
  'T' || CAST(9 - list_sum(list_transform(range(12), lambda i: CAST(substr(lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 12 - CAST(i AS INTEGER), 1) AS INTEGER) * (1 + i % 2))) % 9 AS INTEGER) || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS registration_no
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def rendered(spark, sf_dir, tasks: int | None = None) -> DataFrame:
    """(id, text): full-width digits, eras and slashes take turns, as does an amount that has gone to the next line."""
    t = truth(spark, sf_dir)
    t = t.repartition(tasks, "id") if tasks else t
    y, m, d = (F.substring("date", a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    day = (F.when(F.col("id") % 4 == 0, F.concat_ws("/", y, m, d)).when(F.col("id") % 4 == 1, F.concat(F.lit("令和"), (y - 2018).cast("string"), F.lit("年"), m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日")))
           .when(F.col("id") % 4 == 2, F.concat(F.translate(y.cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("年"), m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日"))).otherwise(F.concat(F.lit("R"), F.concat_ws(".", y - 2018, m, d), F.lit(" 12:00"))))
    yen = lambda c: F.concat(F.lit("￥"), F.format_number(c, 0))
    total = F.when(F.col("id") % 3 == 0, F.concat(F.lit("合計\n"), yen(F.col("total")))).otherwise(F.concat(F.lit("合 計　"), yen(F.col("total")), F.lit("円")))
    lines = ["payee", F.lit("領収書"), day, F.lit(""), F.concat(F.lit("小計 "), yen(F.col("total") + 99)), F.concat(F.lit("(10%対象 "), yen(F.col("base10")), F.lit(")")), F.concat(F.lit("(8%対象 "), yen(F.col("base8")), F.lit(")")),
             F.concat(F.lit("内消費税等 "), yen(F.col("tax"))), total, F.concat(F.lit("お預り "), yen(F.col("total") + 500)), F.concat(F.lit("登録番号: "), "registration_no")]
    return t.select("id", F.concat_ws("\n", *lines).alias("text"))


def receipt_roundtrip(spark, sf_dir):
    """Receipts rendered from orders and parsed again."""
    # reading a text takes far longer than its bytes tell, so rows are dealt out by number before they are rendered
    tasks = max(8, -(-_t(spark, sf_dir, "orders").count() // 50_000))
    r = rendered(spark, sf_dir, tasks).select("id", receipts.parse_column(F.col("text"), YEAR).alias("r"))
    return r.select("id", *[F.col(f"r.{k}").alias(k) for k in ("date", "payee", "total", "base10", "base8", "tax", "registration_no")])


RECEIPT_ROUNDTRIP = f"WITH {TRUTH} SELECT * FROM tr"


def check_digit(spark, sf_dir):
    """The check digit of made-up numbers, in built-in functions; three-valued."""
    c = _t(spark, sf_dir, "customer")
    no = F.when(F.col("c_custkey") % 7 == 0, F.lit("T123")).otherwise(F.concat(F.lit("T"), (F.col("c_custkey") % 10).cast("string"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "0")))
    return c.select("c_custkey", no.alias("no"), receipts.check_digit(no).alias("ok"))


CHECK_DIGIT = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'T123' ELSE 'T' || (c_custkey % 10) || b END AS no,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 10 = 9 - list_sum(list_transform(range(12), lambda i: CAST(substr(b, 12 - CAST(i AS INTEGER), 1) AS INTEGER) * (1 + i % 2))) % 9 END AS ok
FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS b FROM customer)"""


def missing_codes(spark, sf_dir):
    """What a receipt lacks or contradicts, where fields are blanked by id."""
    t = truth(spark, sf_dir)
    i = F.col("id")
    codes = receipts.missing_codes(F.when(i % 5 != 0, F.col("date")), F.when(i % 6 != 0, F.col("total")).otherwise(F.lit(0)), F.when(i % 7 != 0, F.col("payee")).otherwise(F.lit("")), F.col("base10") + i % 4, F.when(i % 9 != 0, F.col("base8")), F.when(i % 8 != 0, F.col("registration_no")).otherwise(F.lit("T7000012050003")))
    return t.select("id", F.array_join(codes, ",").alias("codes"))


MISSING_CODES = f"""WITH {TRUTH}, z AS (SELECT *, CASE WHEN id % 6 <> 0 THEN total ELSE 0 END AS t, base10 + id % 4 AS a, CASE WHEN id % 9 <> 0 THEN base8 ELSE 0 END AS b FROM tr)
SELECT id, array_to_string(list_filter([CASE WHEN id % 5 = 0 THEN 'receipt_no_date' END, CASE WHEN t = 0 THEN 'receipt_no_total' END, CASE WHEN id % 7 = 0 THEN 'receipt_no_payee' END,
  CASE WHEN t <> 0 AND (a <> 0 OR b <> 0) AND abs(a + b - t) > 2 THEN 'receipt_amount_mismatch' END, CASE WHEN id % 8 = 0 THEN 'receipt_regno_suspect' END], lambda x: x IS NOT NULL), ',') AS codes FROM z"""


def _records(spark, sf_dir):
    t = truth(spark, sf_dir)
    fields = [x for k in ("date", "payee", "total", "base10", "base8", "tax", "registration_no") for x in (F.lit(k), F.col(k).cast("string"))]
    manual = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("payee"), F.lit("A"))).when(F.col("id") % 4 == 1, F.create_map(F.lit("total"), F.lit(None).cast("string")))
    return t.select("id", F.create_map(*fields).alias("auto"), manual.alias("manual"))


def receipt_fields(spark, sf_dir):
    """Values in force; a manual null hides the automatic value."""
    return merge.effective(_records(spark, sf_dir)).select("id", "payee", "total", "date")


RECEIPT_FIELDS = f"WITH {TRUTH} SELECT id, CASE WHEN id % 4 = 0 THEN 'A' ELSE payee END AS payee, CASE WHEN id % 4 = 1 THEN NULL ELSE CAST(total AS VARCHAR) END AS total, date FROM tr"


def receipt_import(spark, sf_dir):
    """An edited list comes back: new payees, blanks, untypable totals, unknown ids, states."""
    rec, t = _records(spark, sf_dir), truth(spark, sf_dir)
    i = F.col("id")
    cells = t.select(F.when(i % 50 == 0, -i - 1).otherwise(i).alias("id"), F.when(i % 3 == 0, F.lit("AI確認")).when(i % 3 == 1, F.lit("確認済み")).otherwise(F.lit("自動")).alias("state"), "date",
                     F.when(i % 4 == 0, F.when(i % 8 == 0, F.lit("")).otherwise("A")).when(i % 5 == 0, F.lit(" 新しい店 ")).otherwise(F.col("payee")).alias("payee"), F.when(i % 4 == 1, F.lit("")).when(i % 6 == 0, F.lit("なし")).otherwise(F.concat(F.lit("¥"), F.format_number("total", 0), F.lit("円"))).alias("total"),
                     F.col("base10").cast("string").alias("base10"), F.col("base8").cast("string").alias("base8"), F.col("tax").cast("string").alias("tax"), "registration_no", F.lit("").alias("note"))
    m = merge.merge_list(rec, cells, YEAR)
    return m.select("id", "status", F.try_element_at("manual", F.lit("payee")).alias("payee"), "manual_source", F.size("errors").alias("n_errors"), F.size("acks").alias("n_acks"))


RECEIPT_IMPORT = f"""WITH {TRUTH}, c AS (SELECT id AS i, CASE WHEN id % 50 = 0 THEN -id - 1 ELSE id END AS id, id % 50 <> 0 AS known, id % 4 <> 0 AND id % 5 = 0 AND id % 50 <> 0 AS renamed, id % 8 = 0 AND id % 50 <> 0 AS blanked FROM tr)
SELECT id, CASE WHEN NOT known THEN 'error' WHEN renamed OR blanked THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN known THEN CASE WHEN renamed THEN '新しい店' WHEN i % 4 = 0 AND NOT blanked THEN 'A' END END AS payee,
  CASE WHEN known AND renamed THEN CASE WHEN i % 3 = 0 THEN 'ai' ELSE 'import' END END AS manual_source, CASE WHEN NOT known THEN 1 WHEN i % 4 <> 1 AND i % 6 = 0 THEN 1 ELSE 0 END::INTEGER AS n_errors,
  CASE WHEN known AND i % 3 <> 2 THEN 4 ELSE 0 END::INTEGER AS n_acks FROM c"""


def receipt_arbitration(spark, sf_dir):
    """C20: two readings of a receipt; which counts, and where they disagree."""
    t = truth(spark, sf_dir)
    i = F.col("id")
    two = t.select("id", F.when(i % 9 != 0, F.col("total")).alias("total1"), F.when(i % 5 != 0, F.col("total") + (i % 7 == 0).cast("int")).alias("total2"), F.col("date").alias("date1"), F.when(i % 4 == 0, F.lit(None)).otherwise(F.col("date")).alias("date2"), (i % 2 == 0).alias("reread"))
    a = merge.arbitrate(two)
    return a.select("id", "total", "date", F.array_join("total_disagree", ",").alias("total_disagree"), F.array_join("date_disagree", ",").alias("date_disagree"))


RECEIPT_ARBITRATION = f"""WITH {TRUTH}, z AS (SELECT *, CASE WHEN id % 9 <> 0 THEN total END AS t1, CASE WHEN id % 5 <> 0 THEN total + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END END AS t2 FROM tr)
SELECT id, coalesce(t2, t1) AS total, date, CASE WHEN t1 <> t2 THEN t1 || ',' || t2 END AS total_disagree, CASE WHEN id % 4 = 0 THEN date || ',' END AS date_disagree FROM z"""


def receipt_sort(spark, sf_dir):
    """O3: receipts by payee, blanks last, then by date."""
    t = truth(spark, sf_dir)
    i = F.col("id")
    return ordering.receipt_sort(t.select("id", F.when(i % 10 != 0, F.col("payee")).alias("payee"), F.when(i % 7 != 0, F.col("date")).alias("date"), i.alias("pos")), "payee_date")


RECEIPT_SORT = f"""WITH {TRUTH}, z AS (SELECT id, CASE WHEN id % 10 <> 0 THEN replace(payee, ' ', '') ELSE '' END AS p, CASE WHEN id % 7 <> 0 THEN date END AS d FROM tr)
SELECT id, row_number() OVER (ORDER BY p = '', p, d IS NULL, coalesce(d, ''), id) - 1 AS pos FROM z"""


def receipt_sort_date(spark, sf_dir):
    """O3: receipts by date, unknown last."""
    t = truth(spark, sf_dir)
    return ordering.receipt_sort(t.select("id", "payee", F.when(F.col("id") % 7 != 0, F.col("date")).alias("date"), F.col("id").alias("pos")), "date")


RECEIPT_SORT_DATE = f"WITH {TRUTH} SELECT id, row_number() OVER (ORDER BY id % 7 = 0, CASE WHEN id % 7 <> 0 THEN date ELSE '' END, id) - 1 AS pos FROM tr"


def resource_peaks(spark, sf_dir):
    """Line items of an order stand for samples of its processes; the sum per ship date, its peak and the last."""
    li = _t(spark, sf_dir, "lineitem")
    per = li.groupBy("l_orderkey", "l_shipdate").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return per.groupBy("l_orderkey").agg(F.max("total").alias("peak"), F.max_by("total", "l_shipdate").alias("last"), F.count("*").alias("samples"))


RESOURCE_PEAKS = """WITH p AS (SELECT l_orderkey, l_shipdate, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, max(total) AS peak, arg_max(total, l_shipdate) AS "last", count(*) AS samples FROM p GROUP BY 1"""


def foreign_keys(spark, sf_dir):
    """Page -> segment -> video by way of line item -> order -> customer -> nation; small sides are for Spark to broadcast."""
    li, o, c, n = (_t(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("items"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


FOREIGN_KEYS = """SELECT n_name, count(*) AS items, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


def positional_zip(spark, sf_dir):
    """The i-th order of a customer against the i-th of the next customer."""
    from pyspark.sql import Window

    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("i"))
    b = o.select((F.col("o_custkey") - 1).alias("c"), F.col("i").alias("j"), F.col("o_orderkey").alias("other"))
    return o.join(b, (F.col("o_custkey") == F.col("c")) & (F.col("i") == F.col("j"))).select("o_custkey", "i", "o_orderkey", "other")


POSITIONAL_ZIP = """WITH o AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS i FROM orders)
SELECT a.o_custkey, a.i, a.o_orderkey, b.o_orderkey AS other FROM o a JOIN o b ON b.o_custkey = a.o_custkey + 1 AND a.i = b.i"""


def settings_merge(spark, sf_dir):
    """Defaults, explicit values that are not null, and a preset that cannot be overridden."""
    return merge.settings(spark, {"layout": "spread", "enhance": "none", "dewarp": "auto", "direction": "ltr"}, {"layout": "single", "dewarp": "off"}, {"direction": "rtl", "enhance": None, "dewarp": "auto"})


SETTINGS_MERGE = "SELECT * FROM (VALUES ('layout', 'single'), ('enhance', 'none'), ('dewarp', 'off'), ('direction', 'rtl')) AS v(key, value)"

QUERIES = {f.__name__: f for f in (receipt_roundtrip, check_digit, missing_codes, receipt_fields, receipt_import, receipt_arbitration, receipt_sort, receipt_sort_date, resource_peaks, foreign_keys, positional_zip, settings_merge)}
SQL = {name: globals()[name.upper()] for name in QUERIES}


def edited_segments(spark, sf_dir):
    """Orders as segments, their line items as edits; what is chosen, included and acknowledged afterwards."""
    from ..operators import edits

    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    seg = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("f0"), F.lit("f1"))).alias("candidates"), F.lit("f0").alias("chosen"), (F.col("o_orderkey") % 3 == 0).alias("include"),
                   F.when(F.col("o_orderkey") % 2 == 0, F.lit("s1")).alias("duplicate_of"), F.array(F.lit("blur"), F.lit("short_still")).alias("warnings"))
    kind = F.col("l_partkey") % 4
    e = li.select((F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"), F.col("l_orderkey").alias("id"), F.when(kind == 0, "choose").when(kind == 1, "include").when(kind == 2, "ack").otherwise("unack").alias("field"),
                  F.when(kind == 0, F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string"))).when(kind == 1, F.when(F.col("l_suppkey") % 2 == 0, "true").otherwise("false")).otherwise(F.when(F.col("l_suppkey") % 3 == 0, "*").otherwise("blur")).alias("value"))
    s = edits.apply_segment_edits(seg, e)
    return s.select("id", "chosen", "include", "duplicate_of", F.array_join("acknowledged", ",").alias("acknowledged"), "error")


EDITED_SEGMENTS = """WITH e AS (SELECT CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, l_orderkey AS id, l_partkey % 4 AS kind, l_suppkey AS v FROM lineitem),
c AS (SELECT id, arg_max('f' || (v % 3), seq) AS ch FROM e WHERE kind = 0 GROUP BY 1), i AS (SELECT id, arg_max(v % 2 = 0, seq) AS inc FROM e WHERE kind = 1 GROUP BY 1),
a AS (SELECT id, max(seq) FILTER (kind = 2) AS blur_on, max(seq) FILTER (kind = 3) AS blur_off, max(seq) FILTER (kind = 2 AND v % 3 = 0) AS all_on, max(seq) FILTER (kind = 3 AND v % 3 = 0) AS all_off FROM e WHERE kind >= 2 GROUP BY 1),
s AS (SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS bare, o_orderkey % 3 = 0 AS was, CASE WHEN o_orderkey % 2 = 0 THEN 's1' END AS dup, ch, inc, coalesce(blur_on, -1) > coalesce(blur_off, -1) AS blur, coalesce(all_on, -1) > coalesce(all_off, -1) AS alls
  FROM orders LEFT JOIN c ON c.id = o_orderkey LEFT JOIN i ON i.id = o_orderkey LEFT JOIN a ON a.id = o_orderkey)
SELECT id, CASE WHEN ch IS NOT NULL AND NOT bare AND ch <> 'f2' THEN ch ELSE 'f0' END AS chosen, CASE WHEN inc IS NULL OR (inc AND bare) THEN was ELSE inc END AS include, CASE WHEN NOT coalesce(inc AND NOT bare, false) THEN dup END AS duplicate_of,
  CASE WHEN coalesce(inc AND NOT bare, false) OR (blur AND alls) THEN 'blur,short_still' WHEN blur THEN 'blur' WHEN alls THEN 'short_still' ELSE '' END AS acknowledged,
  concat_ws(',', CASE WHEN ch IS NOT NULL AND (bare OR ch = 'f2') THEN 'no such candidate' END, CASE WHEN inc AND bare THEN 'no candidates' END) AS error FROM s"""


def rotated_frames(spark, sf_dir):
    """Parts as frames; a turn of some videos swaps sides and makes their segments anew."""
    from ..operators import edits

    p = _t(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("video_id"), F.lit(1920).alias("width"), (F.col("p_size") + 1000).alias("height"))
    s = f.select("id", "video_id", (F.col("id") % 2).cast("int").alias("rotation_rev"), F.lit("g").alias("geometry"), F.array(F.lit("blur"), F.lit("orientation_uncertain")).alias("warnings"))
    turns = spark.createDataFrame([(1, 1), (2, 2), (3, -1), (4, 4)], "video_id long, k int")
    f, s = edits.rotate(f, s, turns)
    s = s.withColumnRenamed("id", "sid").drop("video_id")
    return f.join(s, F.col("id") == F.col("sid")).select("id", "width", "height", "rotation_rev", "geometry", F.array_join("warnings", ",").alias("warnings"))


ROTATED_FRAMES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 10 IN (1, 3) THEN p_size + 1000 ELSE 1920 END AS width, CASE WHEN p_partkey % 10 IN (1, 3) THEN 1920 ELSE p_size + 1000 END AS height,
  CAST(p_partkey % 2 + CASE WHEN p_partkey % 10 IN (1, 2, 3) THEN 1 ELSE 0 END AS INTEGER) AS rotation_rev, CASE WHEN p_partkey % 10 NOT IN (1, 2, 3) THEN 'g' END AS geometry, CASE WHEN p_partkey % 10 IN (1, 2, 3) THEN 'blur' ELSE 'blur,orientation_uncertain' END AS warnings FROM part"""


def photo_places(spark, sf_dir):
    """Photos go after the segment named, else behind the last video."""
    from ..operators import edits

    o = _t(spark, sf_dir, "orders")
    seg = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), F.col("o_orderkey").cast("double").alias("start"), (F.col("o_orderkey") + 0.5).alias("end"))
    photos = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("after")).unionByName(o.where("o_orderkey % 97 = 0").select((F.col("o_orderkey") + 10_000_000_000).alias("seq"), F.lit(-1).cast("long").alias("after")))
    return edits.place_photos(seg, photos)


PHOTO_PLACES = """WITH p AS (SELECT o_orderkey AS seq, o_orderkey - o_orderkey % 4 AS after FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey + 10000000000, -1 FROM orders WHERE o_orderkey % 97 = 0),
s AS (SELECT o_orderkey AS id, o_custkey AS v, o_orderkey + 0.5::DOUBLE AS e FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT max(v) AS lv FROM s),
j AS (SELECT seq, v, e, lv, row_number() OVER (PARTITION BY CASE WHEN e IS NOT NULL THEN after END ORDER BY seq) AS n FROM p LEFT JOIN s ON after = id, l)
SELECT seq, CASE WHEN e IS NOT NULL THEN v ELSE lv END AS video_id, CASE WHEN e IS NOT NULL THEN e + n * 0.001::DOUBLE ELSE 1e9::DOUBLE + n END AS start FROM j"""


def augmented_lines(spark, sf_dir):
    """Amount lines with the digits that were read again; other lines as they were."""
    from ..functions import scalars

    o = _t(spark, sf_dir, "orders")
    digits = F.when(F.col("o_orderkey") % 3 == 0, scalars.trailing_number(F.concat(F.lit("x "), F.format_number(F.floor("o_totalprice"), 0), F.lit(")"))))
    return o.select("o_orderkey", scalars.augmented(F.lit("合計 "), F.concat(F.lit("合計 "), F.col("o_orderkey").cast("string")), digits).alias("line"))


AUGMENTED_LINES = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '合計 ¥' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) ELSE '合計 ' || o_orderkey END AS line FROM orders"

for _f in (edited_segments, rotated_frames, photo_places, augmented_lines):
    QUERIES[_f.__name__] = _f
    SQL[_f.__name__] = globals()[_f.__name__.upper()]
