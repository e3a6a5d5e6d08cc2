"""Bounded labelled samples for the fitted scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm import common


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, *, per_class: int, learn) -> DataFrame:
    """(id, text, y): about ``per_class`` labelled documents of each class 0 and 1 at most, chosen by hash.

    ``learn`` says of the id which rows may be learned from. Null ids and
    labels are left out; an id labelled more than once counts as 1 if any
    of its labels is 1. Each class keeps the share of its ids that gives
    ``per_class`` of them on average, a choice that needs no sorting. The
    ids that come to the tasks are bounded by it, so the documents are not
    shuffled.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    once = marked.filter(learn(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).join(known, "id", "left_semi")
    once = common.staged(once)
    sizes = {r.y: r.n for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = once.filter(F.coalesce(*[F.when(F.col("y") == y, common.part_of("id", per_class / n)) for y, n in sizes.items()], F.lit(False)))
    chosen = chosen.select(F.col("id").alias("chosen_id"), "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id")).select("id", "text", "y")
