"""Page quality: issues of translated pages, in the order in which they are judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: The message of each kind of issue, and the category it is reported under.
MESSAGES = {"failed": "翻译失败", "missing": "没有译文", "untranslated": "疑似整页未翻译", "incomplete": "疑似译文截断", "english_residue": "英文残留较多"}
CATEGORIES = {
    "failed": "翻译失败",
    "missing": "无译文",
    "untranslated": "疑似未翻页",
    "incomplete": "疑似截断",
    "english_residue": "英文残留",
    "glossary_miss": "术语冲突",
    "rule_symbol": "规则符号",
}
OTHER_CATEGORY = "质量问题"


def joined_pages(pages: DataFrame, translations: DataFrame, failures: DataFrame) -> DataFrame:
    """Every page of any side: page_index, source, translation, layout, failed_reason."""
    df = pages.join(translations, "page_index", "full_outer").join(failures, "page_index", "full_outer")
    return df.select("page_index", *(T.some(F.col(c)).alias(c) for c in ("source", "translation", "layout", "failed_reason")))


def issue_kinds(source: Column, target: Column, layout: Column, reason: Column) -> Column:
    """Kinds of a page's issues: a failure or a gap hides the rest, and an untranslated page is not also cut short."""
    many = F.array(
        F.when(T.untranslated(source, target, layout), F.lit("untranslated")).when(T.incomplete(source, target, layout), F.lit("incomplete")),
        F.when(T.residue(target) != "", F.lit("english_residue")),
    )
    one = F.when(reason != "", "failed").when(T.stripped(target) == "", "missing").when(T.failed(target), "failed")
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.filter(many, lambda x: x.isNotNull()))


def page_issues(joined: DataFrame) -> DataFrame:
    """One row per issue: page_num, kind, message, detail."""
    cols = (F.col(c) for c in ("source", "translation", "layout", "failed_reason"))
    message = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    df = joined.withColumn("kind", F.explode(issue_kinds(*cols)))
    failed_detail = F.when(F.col("failed_reason") != "", F.col("failed_reason")).otherwise(F.col("translation"))
    detail = F.when(F.col("kind") == "failed", failed_detail).when(F.col("kind") == "english_residue", T.residue(F.col("translation"))).otherwise("")
    return df.select((F.col("page_index") + 1).alias("page_num"), "kind", message[F.col("kind")].alias("message"), detail.alias("detail"))


def roll_up(joined: DataFrame) -> DataFrame:
    """Counts of pages, translated and failed pages and issues of each kind, in one row."""
    cols = [F.col(c) for c in ("source", "translation", "layout", "failed_reason")]
    df = joined.withColumn("kinds", issue_kinds(*cols))
    count = lambda kind: F.count_if(F.array_contains("kinds", kind)).alias(f"n_{kind}")
    return df.agg(
        F.count("*").alias("total_pages"),
        F.count_if(T.stripped(F.col("translation")) != "").alias("translated_pages"),
        F.count_if(F.col("failed_reason") != "").alias("failed_pages"),
        *(count(k) for k in MESSAGES),
    )


def category(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(known[kind], F.lit(OTHER_CATEGORY))


def risk_items(issues: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Issues and extraction risks together: page_num, category, title, detail, retryable; pages from 1 on."""
    mine = issues.select("page_num", category(F.col("kind")).alias("category"), F.col("message").alias("title"), "detail", F.lit(True).alias("retryable"))
    risks = F.filter("risks", lambda x: T.stripped(x) != "")
    text = F.concat(F.lit("版面："), F.col("layout"), F.lit("；文本量："), F.col("text_length").cast("string"), F.lit("；图片："), F.col("image_count").cast("string"))
    theirs = diagnostics.where(F.size(risks) > 0).select(
        (F.col("page") + 1).alias("page_num"), F.lit("提取风险").alias("category"), F.array_join(risks, "；").alias("title"), text.alias("detail"),
        (~F.exists(risks, lambda x: x.contains("未提取到正文"))).alias("retryable"),
    )
    return mine.unionByName(theirs).where("page_num > 0")


def text_risks(c: Column) -> Column:
    """Risks that the text alone shows."""
    t = T.some(c)
    count = lambda mark: (F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)
    risks = F.array(
        F.when(T.stripped(t) == "", F.lit("未提取到正文")),
        F.when(count("[CARD]") != count("[/CARD]"), F.lit("卡片标记不成对")),
        F.when(count("[STAT_BLOCK]") != count("[/STAT_BLOCK]"), F.lit("属性块标记不成对")),
        F.when((count("|") >= 6) & ~t.contains("| ---") & ~t.contains("|---"), F.lit("疑似表格未结构化")),
        F.when(t.contains("�") | (count("?") >= 20), F.lit("疑似乱码或 OCR 损坏")),
    )
    return F.filter(risks, lambda x: x.isNotNull())
