"""Mixing sources to target weights along a curriculum.

Each source has a target share of the total and a weight schedule over the
course of training. The schedule is integrated to the source's cumulative token
demand; every document copy stands at a place in its source's token order, and
inverting the demand there gives its training position. Sorting by position
gives the mixed stream. Sources too small for their share are repeated up to
their cap, and what they cannot give is spread over the others by weight.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges into which a source's documents are cut for running sums.
BUCKETS = 4096
#: The tokenizer's vocabulary (lines of a base64 token and its rank), by a path that every executor can read.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the public pattern that cuts text for this vocabulary
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
#: Bytes of text handed to the tokenizer at once; longer texts are cut at white space outside of words.
PIECE = 1 << 20


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces whose token counts add up to its own: cut only between a word character and a single space after it."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and not text[cut + 1 : cut + 2].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count(path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [None if t is None else sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, tokens``; a NULL text has NULL tokens, an empty one 0."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(tokenizer, pattern), "doc_id bigint, source string, tokens bigint")


def plan_shares(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, float]:
    """Tokens to take of each source: its share of ``total``, at most ``max_repeats`` times what it has.

    What a capped source cannot give is spread over the others in proportion to
    their shares, until nothing is left to spread or every source is at its cap.
    """
    cap = {s: available.get(s, 0) * max(0, repeats) for s, (_, repeats) in targets.items()}
    take, open_ = dict.fromkeys(targets, 0.0), {s for s in targets if cap[s] > 0 and targets[s][0] > 0}
    left = float(total)
    while open_ and left > 1e-6:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if take[s] + left * targets[s][0] / weight >= cap[s]}
        if not full:
            for s in open_:
                take[s] += left * targets[s][0] / weight
            return take
        for s in full:
            left -= cap[s] - take[s]
            take[s] = float(cap[s])
        # the others start again from what is left for them
        for s in open_ - full:
            left += take[s]
            take[s] = 0.0
        open_ -= full
    return take


def demand_inverse(share_done: Column, knots: list[tuple[float, float]]) -> Column:
    """The training position in [0, 1] at which a source has met ``share_done`` of its demand.

    ``knots``: (position, relative weight), linear between; the integral is
    quadratic between two knots and is inverted there.
    """
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    out, before = F.lit(float(knots[-1][0])), whole
    for (a, b), area in reversed(list(zip(zip(knots, knots[1:], strict=False), areas, strict=True))):
        before -= area
        need = F.greatest(share_done * whole - before, F.lit(0.0))
        slope = (b[1] - a[1]) / (b[0] - a[0])
        # a[1] x + slope x^2 / 2 = need, in the form that is stable for slope 0
        root = F.sqrt(F.greatest(F.lit(a[1] ** 2) + 2 * slope * need, F.lit(0.0)))
        x = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (F.lit(a[1]) + root))
        out = F.when(share_done * whole <= before + area, F.lit(float(a[0])) + x).otherwise(out)
    return out


def mix(tokens: DataFrame, targets: DataFrame, schedules: dict[str, list[tuple[float, float]]] | None = None, total: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, source, copy, tokens, position`` in training order.

    ``tokens`` is ``token_counts`` (read several times: give a checkpointed
    table); ``targets`` has ``source, target_share, max_repeats``, a row per
    source, and is small by its nature (one row per feed; at most 10 000 are
    taken, more raise an error). ``total`` defaults to the tokens of all documents,
    listed or not. Documents of unlisted or NULL sources and documents
    without tokens are not used. A source ends with the document that comes nearest to its demand.
    ``schedules`` gives the weight over the course (default: constant).
    """
    rows = targets.where("source is not null and target_share > 0").select("source", "target_share", "max_repeats").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10 000 target sources")
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"] or 0)) for r in rows}
    sums = tokens.groupBy("source").agg(F.sum("tokens").alias("n"))
    listed = sums.where(F.col("source").isin(list(wanted))).collect() if wanted else []
    have = {r["source"]: int(r["n"] or 0) for r in listed}
    goal = total if total is not None else int(sums.agg(F.sum("n")).first()[0] or 0)
    take = plan_shares(have, wanted, goal)
    spark = tokens.sparkSession
    planned = [(s, float(have[s]), take[s]) for s in have if take.get(s, 0) > 0]
    plan = spark.createDataFrame(planned, "source string, _have double, _take double")
    order = F.xxhash64("doc_id", "source")
    t = tokens.where("tokens > 0").join(F.broadcast(plan), "source").withColumn("_key", order).withColumn("_bucket", F.pmod(F.shiftright("_key", 20), F.lit(buckets)))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_upto", F.sum("tokens").over(inside))
    offsets = t.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_n"))
    line = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("source", "_bucket", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    # one row per source and bucket: at most 10 000 x buckets, in practice a few thousand
    t = t.join(offsets, ["source", "_bucket"]).withColumn("_mid", F.col("_before") + F.col("_upto") - F.col("tokens") / 2)
    # copy c of a document stands c rounds further on; it is used if its middle lies before the demand's end
    t = t.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_take") / F.col("_have")).cast("int") - 1, F.lit(0)))))
    at = F.col("copy") * F.col("_have") + F.col("_mid")
    t = t.withColumn("_at", at).where("_at <= _take")
    done = F.least(F.col("_at") / F.col("_take"), F.lit(1.0))
    position = done
    for source, knots in (schedules or {}).items():
        position = F.when(F.col("source") == source, demand_inverse(done, knots)).otherwise(position)
    t = t.withColumn("position", position)
    return t.select("doc_id", "source", "copy", "tokens", "position").orderBy("position", "source", "doc_id", "copy")


def share_report(mixed: DataFrame, targets: DataFrame, tokens: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, tokens_available, tokens_used, actual_share, docs_used, most_copies`` per listed source."""
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.count_distinct("doc_id").alias("docs_used"), (F.max("copy") + 1).alias("most_copies"))
    there = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
    out = targets.select("source", "target_share", "max_repeats").join(there, "source", "left").join(used, "source", "left").fillna(0, ["tokens_available", "tokens_used", "docs_used", "most_copies"])
    return out.withColumn("actual_share", F.col("tokens_used") / F.sum("tokens_used").over(Window.partitionBy(F.lit(1))))
