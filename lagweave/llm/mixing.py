"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in a keyed order, offered `passes` times. A document's
virtual finish time is its source's words up to and with it, over the source's target. All offers
of all sources are sorted by virtual finish time, and the mix is what comes before the total
budget; the document that crosses the budget is served up to there. Nothing else decides how much
a source gives: at time 1 every source has given its target, and the budget is the targets' sum.

Running sums never gather a source or the corpus in one task: the keyed order is cut into slices
by the key's leading digits, and virtual time into equal steps, which by construction hold about
equal work; slices and steps are summed first, and rows are only ordered within one.

Sizes are words; a null text has none. A null source is a source of its own, sorted last. Rows
that repeat a doc_id are separate queue entries. Documents without words take nothing; if no text
has a word, all targets are 0. An empty table gives an empty result. Extra columns are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import staged, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
SLICES = 4096
STEPS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) by water filling: target = min(passes * size, level * weight)
    with the level at which the targets add up to share of all sizes. Sorted by the ratio at which
    a source fills up, the first k full ones leave one level to the others; the k whose level no
    further source is below is the answer. Rows here are sources, not documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fill", F.col("source").asc_nulls_last())
    upto, after = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    ranked = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * passes).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    leveled = ranked.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))).withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", F.col("level").alias("l")))).over(W.partitionBy()).getField("l")
    return leveled.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"), "budget")


def fair_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 0, slices: int = SLICES, steps: int = STEPS, also=()):
    """(queue, served): queue has a row per document (row, doc_id, source, size, source_size,
    target, and the columns named in also); served has a row per document and pass that the mix
    takes (row, pass, words, virtual_finish, start), start being the words before it in the mix's
    global order. Virtual times are rounded to 12 digits, so that sums of targets in another order
    change nothing."""
    sized = staged(docs.select("doc_id", "source", *also, word_count().alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    goal = staged(targets(sized, weights, share, passes), "targets")
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    queue = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select("row", "doc_id", sized["source"], *also, "size", "source_size", "target", "budget", key.alias("key"))
    queue = queue.withColumn("slice", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(1 << 32)) * slices / F.lit(float(1 << 32))).withColumn("slice", F.col("slice").cast("long"))
    queue = staged(queue, "queue")

    by = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = queue.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(by), F.lit(0)))
    inner = W.partitionBy("source", "slice").orderBy("key", "doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = queue.withColumn("ahead", F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("q").join(before.alias("b"), F.col("q.source").eqNullSafe(F.col("b.source")) & (F.col("q.slice") == F.col("b.slice")))
    placed = placed.select("row", "q.source", "size", "source_size", "target", "budget", "key", (F.col("ahead") + F.col("offset")).alias("ahead"))

    offered = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("ahead", F.col("ahead") + F.col("pass") * F.col("source_size"))
    finish = F.round((F.col("ahead") + F.col("size")) / F.col("target"), 12)
    # a step holds about equal work; what finishes at twice the time or later is one step, mostly never served
    offered = offered.where("size > 0 and target > 0").withColumn("virtual_finish", finish).withColumn("step", F.floor(F.least("virtual_finish", F.lit(2.0)) * steps))
    offered = staged(offered, "offered")
    work = offered.groupBy("step").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    budget = F.floor(F.col("budget") + F.lit(1e-6))
    # steps behind the budget need no order, and don't shuffle for one
    reached = staged(offered.join(work, "step").where(F.col("offset") < budget), "reached", spent=(offered,))
    inside = W.partitionBy("step").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "key", "row", "pass").rowsBetween(W.unboundedPreceding, -1)
    mixed = reached.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("offset"))
    served = mixed.where(F.col("start") < budget).select("row", "pass", F.least(F.col("size"), budget - F.col("start")).cast("long").alias("words"), "virtual_finish", "start")
    return queue.drop("key", "slice", "budget"), served


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix serves it (a part counts as a whole); all columns
    kept. Rows are told apart by doc_id, source and text; rows that repeat all three are numbered
    and take their counts in turn, the largest first."""
    cols = docs.columns
    text = F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text")
    queue, served = fair_mix(docs.withColumn("__text", text), also=("__text",), **options)
    times = queue.select("row", "doc_id", "source", "__text").join(served.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n")), "row", "left")
    by = (F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("__text").alias("__hash"))
    times = times.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), F.sort_array(F.collect_list("n"), False).alias("__counts")).where(F.size("__counts") > 0)
    times = staged(times, "times")
    once, again = staged(times.where("__rows = 1"), "once"), staged(times.where("__rows > 1"), "repeated")

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r"), F.col("doc_id").alias("id"), F.col("source").alias("of"), text)
    same = F.col("id").eqNullSafe(F.col("__id")) & F.col("of").eqNullSafe(F.col("__source")) & (F.col("__text") == F.col("__hash"))
    single = whole.join(once, same).withColumn("n", F.col("__counts")[0])
    turn = F.row_number().over(W.partitionBy("id", "of", "__text").orderBy(F.xxhash64("r")))
    many = whole.join(again, same).withColumn("turn", turn).where(F.col("turn") <= F.size("__counts")).withColumn("n", F.element_at("__counts", F.col("turn")))
    out = single.select("r", "n").unionByName(many.select("r", "n"))
    return out.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).select("r.*")


def op10(spark, sf_dir: str) -> DataFrame:
    """Beside the words taken: the virtual finish time of a document's first serving and the words
    before it in the mix; null for documents that aren't served."""
    queue, served = fair_mix(table(spark, sf_dir, "documents"))
    took = served.groupBy("row").agg(F.sum("words").alias("taken"), F.min("virtual_finish").alias("virtual_finish"), F.min("start").alias("start"))
    return queue.join(took, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "virtual_finish", "start")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat('0/', doc_id)) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS fill, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, budget, least(cap, coalesce((SELECT arg_min(level, fill) FROM l WHERE fill >= level), 'inf'::DOUBLE) * w) AS target FROM l),
q AS (SELECT doc_id, d.source, k, size, source_size, budget, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, round((ahead + pass * source_size + size) / target, 12) AS vf FROM q, (SELECT unnest([0, 1]) AS pass) AS p WHERE size > 0 AND target > 0),
m AS (SELECT *, coalesce(sum(size) OVER (ORDER BY vf, source NULLS LAST, k, doc_id, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM o),
v AS (SELECT doc_id, sum(least(size, floor(budget + 1e-6) - start))::BIGINT AS taken, min(vf) AS virtual_finish, min(start) AS start FROM m WHERE start < floor(budget + 1e-6) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, virtual_finish, v.start FROM q LEFT JOIN v ON v.doc_id = q.doc_id
"""
