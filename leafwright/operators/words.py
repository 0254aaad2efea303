"""Recognised words: tables of words with confidences and boxes, made into lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNRELIABLE_PAGE, UNRELIABLE_WORD = 35.0, 60.0  # fixed values
GLYPH_WIDTH = 0.5


def confidence(conf: Column) -> Column:
    """A blank confidence is -1; 0 stays."""
    return F.coalesce(F.nullif(F.trim(conf.cast("string")), F.lit("")).try_cast("double"), F.lit(-1.0))


def read_words(table: DataFrame) -> DataFrame:
    """The word rows (level 5 with text) of a word table: page_id, block, par, line, left, top, width, height, conf, text."""
    w = table.where("level = 5").withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")
    return w.select("page_id", F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line"), "left", "top", "width", "height", confidence(F.col("conf")).alias("conf"), "text")


def page_min_conf(words: DataFrame) -> DataFrame:
    """(page_id, mean_conf, min_conf): on pages whose character-weighted confidence is low only sure words count."""
    n = F.length("text")
    s = words.groupBy("page_id").agg((F.sum(F.col("conf") * n) / F.sum(n)).alias("mean_conf"))
    return s.withColumn("min_conf", F.when(F.col("mean_conf") < UNRELIABLE_PAGE, UNRELIABLE_WORD).otherwise(0.0))


def word_stats(words: DataFrame) -> DataFrame:
    """(page_id, chars, mean_conf, sure_chars) over words of confidence 0 or more; mean to one place, half to even."""
    n = F.length("text")
    s = words.where("conf >= 0").groupBy("page_id").agg(F.sum(n).alias("chars"), F.sum(F.col("conf") * n).alias("s"), F.sum(F.when(F.col("conf") >= 70, n).otherwise(0)).alias("sure_chars"))
    return s.select("page_id", "chars", F.bround(F.col("s") / F.col("chars"), 1).alias("mean_conf"), "sure_chars")


def _latin(c: Column) -> Column:
    """Whether a character is a Latin letter or digit."""
    return c.between("0", "9") | c.between("A", "Z") | c.between("a", "z")


def _token(text: Column, nxt: Column) -> Column:
    """text, and a space where it ends and the next word starts with a Latin letter or digit."""
    return F.when(_latin(F.substring(text, -1, 1)) & _latin(F.substring(nxt, 1, 1)), F.concat(text, F.lit(" "))).otherwise(text)


def spaced(words: DataFrame) -> DataFrame:
    """words with token: a space follows only between a word that ends and one that starts with a Latin letter or digit."""
    nxt = F.lead("text").over(Window.partitionBy("page_id", "block", "par", "line").orderBy("left", "word"))
    return words.withColumn("token", _token(F.col("text"), nxt))


def line_texts(words: DataFrame) -> DataFrame:
    """(page_id, block, par, line, text, top, bottom) in reading rule of spaced()."""
    s = spaced(words)
    return s.groupBy("page_id", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word", "token"))), lambda x: x["token"]), "").alias("text"),
        F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"))


def receipt_lines(words: DataFrame) -> DataFrame:
    """Lines joined without spaces, numbered by top: (page_id, no, text, top, bottom)."""
    g = words.groupBy("page_id", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"))
    return g.withColumn("no", F.row_number().over(Window.partitionBy("page_id").orderBy("top", "block", "par", "line")))


def placed(words: DataFrame, page_w: int, page_h: int, pt_w: float, pt_h: float) -> DataFrame:
    """Words with size, x, base_y (points) and stretch (percent): each reaches to the start of the next of its line."""
    order = Window.partitionBy("page_id", "block", "par", "line").orderBy("left", "word")
    line, sx, sy = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), pt_w / page_w, pt_h / page_h
    # of one order, so that Spark goes through the lines once
    w = words.withColumn("__low", F.col("top") + F.col("height")).withColumns({"__next": F.lead("text").over(order), "__end": F.lead("left").over(order), "__top": F.min("top").over(line), "__bottom": F.max("__low").over(line)})
    w = w.withColumns({"token": _token(F.col("text"), F.col("__next")), "size": F.greatest(F.lit(1.0), (F.col("__bottom") - F.col("__top")) * sy), "x": F.col("left") * sx})
    w = w.withColumns({"base_y": pt_h - F.col("__bottom") * sy + 0.12 * F.col("size"), "hex": F.upper(F.hex(F.encode("token", "UTF-16BE")))})
    end = F.coalesce("__end", F.col("left") + F.col("width")) * sx
    natural = F.length("hex") / 4 * GLYPH_WIDTH * F.col("size")
    return w.withColumn("stretch", F.greatest(F.lit(1.0), (end - F.col("x")) / natural * 100)).drop("__low", "__next", "__end", "__top", "__bottom")
