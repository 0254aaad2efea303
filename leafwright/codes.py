"""Warning codes: label and whether an open one blocks the export. Codes that are not listed block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, label, blocking.
CODES = [
    ("blur", "ぼけ", True),
    ("exposure_dark", "露出不足", True),
    ("exposure_bright", "白飛び", True),
    ("page_cut", "紙面の欠け（文字が画面端に掛かる）", True),
    ("page_touches_frame", "紙面が画面端に接触（文字は範囲内）", False),
    ("page_region_uncertain", "紙面の範囲を判定できない", True),
    ("gutter_uncertain", "綴じ目の位置が不確か", True),
    ("edge_content_top", "上端で文字切れの疑い", True),
    ("edge_content_bottom", "下端で文字切れの疑い", True),
    ("edge_content_left", "左端で文字切れの疑い", True),
    ("edge_content_right", "右端で文字切れの疑い", True),
    ("empty_crop", "ページ画像が空", True),
    ("frame_mismatch", "取り出した画像が解析時と一致しない", True),
    ("frame_missing", "候補フレームを取り出せない", True),
    ("no_candidate", "候補なし", True),
    ("short_still", "静止が短い", True),
    ("duplicate_suspect", "重複の疑い（同じものを続けて撮った、または白紙など）", True),
    ("unreadable", "解析できない区間", True),
    ("ocr_failed", "OCR失敗", True),
    ("ocr_low_conf", "OCRの信頼度が低い", True),
    ("ocr_no_text", "文字が認識されない", True),
    ("page_number_gap", "ページ番号の飛び", True),
    ("orientation_uncertain", "紙面の向きを判定できない", True),
    ("hand_in_content", "本文の範囲に手が重なっている疑い", True),
    ("hdr_pq", "PQ方式のHDR（色変換未検証）", True),
    ("hdr_hlg", "HLG方式のHDR（SDRとして処理）", False),
    ("duplicate", "重複候補として統合", False),
    ("blank_page", "白紙ページ", False),
    ("no_paper", "紙が写っていない（何も置いていない場面）", False),
    ("receipt_hand", "手で押さえたまま（よいフレームがない）", False),
    ("receipt_blur", "ぶれている（よいフレームがない）", False),
    ("low_resolution", "解像度が200dpi相当に届かない（電子帳簿保存法の目安）", True),
    ("receipt_no_date", "取引日を読み取れない", True),
    ("receipt_no_total", "金額を読み取れない", True),
    ("receipt_no_payee", "取引先を読み取れない", True),
    ("receipt_regno_suspect", "登録番号の検査用の数字が合わない（読み誤りの疑い）", True),
    ("receipt_total_disagree", "金額の読み直しで結果が分かれた", True),
    ("receipt_date_disagree", "取引日の読み直しで結果が分かれた", True),
    ("receipt_amount_mismatch", "税率ごとの対象額の合計が金額と合わない（読み誤りの疑い）", True),
]
PASSING = [code for code, _, blocking in CODES if not blocking]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "code string, label string, blocking boolean")


def open_blocking(codes: Column, acknowledged: Column) -> Column:
    """The distinct codes that block and are not acknowledged, in order of first occurrence."""
    passing = F.array(*[F.lit(c) for c in PASSING])
    done = F.coalesce(acknowledged, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: ~F.array_contains(passing, c) & ~F.array_contains(done, c)))


def labels(codes: Column) -> Column:
    names = F.create_map(*[F.lit(x) for code, label, _ in CODES for x in (code, label)])
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(names, c), c))
