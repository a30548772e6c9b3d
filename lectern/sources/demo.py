"""A small book of our own to try the library with, as the tables that ingestion gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import lifecycle, structure

TITLE = "观测入门"
TEXT = """## 第一章 看见
### 1.1 光
光度是指天体在单位时间里发出的能量。
星等称为亮度的标尺，数值越小越亮。
### 1.2 望远镜
口径的意思是望远镜能收集光的宽度。
口径越大，能看见的天体越暗。
## 第二章 记录
### 2.1 日志
观测日志是指按时间写下的条件和结果。
每条记录都要写明时间、地点和天气。
### 2.2 误差
误差称为测量值与真值之差。
误差 = 测量值 - 真值
"""


def demo_book(spark: SparkSession, book: str = "demo") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(books, chapters, sections, anchors)."""
    rows = structure.outline_rows(structure.lines(spark.createDataFrame([(book, TEXT)], "book string, text string")))
    chapters, sections, anchors = lifecycle.bundle(structure.assemble(structure.blocks(rows)))
    return spark.createDataFrame([(book, TITLE, "", "")], "id string, title string, note string, content_warning string"), chapters, sections, anchors


def seeded(books: DataFrame, demo: DataFrame) -> DataFrame:
    """books, or the demo book where there is none yet."""
    return demo if books.isEmpty() else books
