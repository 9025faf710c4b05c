"""Queries of the text problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesoflow.llm.leakage import item_report, leaked_items
from mesoflow.llm.mixing import mix, share_report, token_counts
from mesoflow.llm.stuffing import stuffed_pages
from mesoflow.session import ensure_checkpoint_dir, table

#: The course of the weights: notes and reviews come late, pasted snippets early.
COURSE = {
    "course_notes": [(0.0, 0.4), (0.5, 1.0), (1.0, 1.6)],
    "review_threads": [(0.0, 0.5), (1.0, 1.5)],
    "paste_board": [(0.0, 1.8), (1.0, 0.2)],
}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items of which they hold at least 20 consecutive words."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how much of them."""
    return item_report(leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ensure_checkpoint_dir(spark)
    tokens = token_counts(table(spark, sf_dir, "documents")).checkpoint()
    targets = table(spark, sf_dir, "mix_targets")
    return mix(tokens, targets, COURSE), targets, tokens


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus in training order."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached, per feed."""
    mixed, targets, tokens = _mixed(spark, sf_dir)
    return share_report(mixed, targets, tokens).withColumn("actual_share", F.round("actual_share", 9))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of repeated keywords, links or tags."""
    return stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p6_found": p6_found, "p6_items": p6_items, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}

# every run of 20 words of an item and of a document, and the equal ones
_GRAMS = """
d as (select doc_id as id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from documents where text is not null),
e as (select item_id as id, list_transform(regexp_extract_all(item_text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from eval_items where item_text is not null),
dg as (select id as doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
eg as (select id as item_id, i as k, array_to_string(w[i:i + 19], ' ') as s from (select id, w, unnest(range(1, len(w) - 18)) as i from e where len(w) >= 20)),
m as (select doc_id, item_id, i, k from dg join eg on dg.s = eg.s)"""

SQL: dict[str, str] = {
    "p6_found": f"with {_GRAMS} select distinct doc_id, item_id from m",
    "p6_items": f"""with {_GRAMS},
r as (select doc_id, item_id, i - k as diagonal, i - row_number() over (partition by doc_id, item_id, i - k order by i) as island from m),
l as (select doc_id, item_id, count(*) + 19 as n from r group by doc_id, item_id, diagonal, island),
b as (select doc_id, item_id, max(n) as n from l group by 1, 2)
select item_id, count(*) as n_docs, cast(max(n) as int) as longest, count(case when n = len(e.w) then 1 end) as whole_docs from b join e on e.id = b.item_id group by 1""",
}
