"""URL filters: given host and path rules first, then association rules mined from labels.

A URL's tokens are its host's labels, path segments (digits as one 0), and query keys. Tokens that
are on the very same labelled pages are one item, so a long query that many pages share is no more
than one. Spark's FP-growth mines the items of unwanted pages for sets that enough of them have;
these are the rules' left sides. Each is then counted on all labelled pages, and rules that lead to
unwanted pages with enough support, confidence and lift, and more confidence than any rule with
fewer of their items, are kept. An inverted index holds each rule at its rarest item; a page is
joined by its items, and a rule fits if the page has all of its items. A page that some rule fits
is blocked, others are allowed.

FP-growth finds every subset of what pages share, so its time would double with each further item on
a URL. Where a labelled URL has more than WIDTH items, sets are grown item by item instead, by joins,
and only from those that can still lead to a rule: a set on as many pages as one of its subsets, or
one that only unwanted pages have, is not grown, as no larger set of it has more confidence than a
smaller rule. Both ways end with the same rules; nothing is left out.

Given rules fit their host and its subdomains, where the path starts with theirs; the longest
rule wins. They are a parameter and become one expression. A null URL, or one without "://", has
an empty host and path and no tokens, and is allowed. Rows that repeat a page_id are judged each
on its own. Without labelled pages only the given rules block. Extra columns are ignored.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import staged, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.0005, 0.5
#: A rule rests on this many unwanted pages at least.
MIN_PAGES = 20
#: Items of a URL up to which FP-growth mines.
WIDTH = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """url's host, path and tokens."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    out = out.withColumn("host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract("__rest", r"^[^?#]*\?([^#]*)", 1)
    marked = lambda letter, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(letter), x))
    tokens = F.concat(
        marked("h:", F.split("host", r"\.")),
        marked("p:", F.split(F.regexp_replace("path", "[0-9]+", "0"), "[/.]")),
        marked("q:", F.transform(F.split(query, "&"), lambda x: F.element_at(F.split(x, "="), 1))),
    )
    return out.withColumn("tokens", F.array_distinct(tokens)).drop("__rest")


def given_rule(rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def items_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, own): the items, strongest first, of each of rows(row, tokens) that has any."""
    found = rows.select("row", F.explode("tokens").alias("token")).join(items, "token")
    own = F.array_sort(F.collect_set(F.struct((-F.col("share")).alias("a"), (-F.col("unwanted")).alias("b"), "item")))
    return found.groupBy("row").agg(F.transform(own, lambda x: x["item"]).alias("own"))


def matched(own: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (row, id, ...) of each rule that fits, by the rule's key."""
    keyed = own.withColumn("key", F.explode("own")).join(rules, "key")
    return keyed.where(F.size(F.array_intersect("own", "items")) == F.size("items")).drop("own", "key")


def frequent_items(labeled: DataFrame, least: float) -> DataFrame:
    """(token, item, share, unwanted) of the tokens on enough unwanted pages. Tokens whose sets of
    pages have equal sizes and sums (two of 64 bits) are one item, named by the first of them."""
    page = F.xxhash64("row")
    each = labeled.select("row", "unwanted", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("unwanted").alias("unwanted"), F.bit_xor(page).alias("s1"), F.bit_xor(F.xxhash64(page)).alias("s2"))
    same = W.partitionBy("n", "unwanted", "s1", "s2")
    return each.where(F.col("unwanted") >= least).select("token", F.min("token").over(same).alias("item"), (F.col("unwanted") / F.col("n")).alias("share"), "unwanted")


def grown_sets(own: DataFrame, least: float) -> DataFrame:
    """(items): every set of items on least unwanted pages or more that is on fewer pages than each of
    its subsets and has none that only unwanted pages have. own has row, own, unwanted. Pairs come from
    the unwanted pages themselves, larger sets from two that differ in their last item; each is
    counted on all pages that have its rarest item. Staged."""
    size, bad = F.count(F.lit(1)).alias("n"), F.count_if("unwanted").alias("unwanted")
    single = own.select("unwanted", F.explode("own").alias("item")).groupBy("item").agg(size, bad).where(F.col("unwanted") >= least)
    single = staged(single, "single")
    level = single.select(F.array("item").alias("items"), "n", "unwanted")
    found = level.select("items")
    spread = single.where("unwanted < n").select("item")
    # only items that other pages have as well can be in larger sets
    kept = own.where("unwanted").select("row", F.explode("own").alias("item")).join(spread, "item").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("own"))
    pairs = kept.select(F.posexplode("own").alias("at", "a"), "own").select("a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("b"))
    candidates = pairs.groupBy("a", "b").agg(size).where(F.col("n") >= least).select(F.array("a", "b").alias("items"))
    while True:
        candidates = staged(candidates.withColumn("id", F.monotonically_increasing_id()), "candidates")
        rarest = candidates.select("id", F.explode("items").alias("item")).join(single.select("item", F.col("n").alias("freq")), "item").groupBy("id").agg(F.min_by("item", F.struct("freq", "item")).alias("key"))
        hits = matched(own, candidates.join(rarest, "id"))
        counted = candidates.join(hits.groupBy("id").agg(size, bad).where(F.col("unwanted") >= least), "id")
        # each part must have been grown from, and be on more pages
        parts = counted.select("id", "n", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
        above = parts.join(level.where("unwanted < n").select(F.col("items").alias("part"), F.col("n").alias("more")), "part").where("more > n").groupBy("id").agg(size.alias("parts"))
        new = counted.join(above, "id").where(F.col("parts") == F.size("items")).select("items", "n", "unwanted")
        level = staged(new, "level")
        if level.isEmpty():
            return staged(found, "sets")
        found = found.unionByName(level.select("items"))
        a, b = (level.where("unwanted < n").select(F.slice("items", 1, F.size("items") - 1).alias("head"), F.element_at("items", -1).alias(x)) for x in "ab")
        candidates = a.join(b, "head").where("a < b").select(F.concat("head", F.array("a", "b")).alias("items"))


def mined_rules(labeled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, pages: int = MIN_PAGES, width: int = WIDTH):
    """(items, rules): items(token, item, ...) and rules(id, items, key, confidence, support) for
    unwanted pages; labeled has row, tokens and a boolean unwanted. width changes the way, not the rules."""
    spark = labeled.sparkSession
    labeled = staged(labeled.select("row", "tokens", "unwanted"), "labeled")
    total = labeled.agg(F.count(F.lit(1)).alias("n"), F.count_if("unwanted").alias("u")).first()
    least = max(support * total.n, pages)
    items = staged(frequent_items(labeled, least), "items")
    own = staged(items_of(labeled, items).join(labeled.select("row", "unwanted"), "row"), "baskets", spent=(labeled,))
    baskets = own.where("unwanted").select(F.col("own").alias("items"))
    found = baskets.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("items")).alias("widest")).first()
    if found.n < least:
        return items, spark.createDataFrame([], "id long, items array<string>, key string, confidence double, support double")
    if found.widest > width:
        sets = grown_sets(own, least)
    else:
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / found.n)).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"))
    sets = staged(sets.withColumn("id", F.xxhash64("items")), "sets")

    counts = own.select(F.explode("own").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    rarest = sets.select("id", F.explode("items").alias("item")).join(counts, "item").groupBy("id").agg(F.min_by("item", F.struct("freq", "item")).alias("key"))
    keyed = staged(sets.join(rarest, "id"), "keyed", spent=(sets,))
    hits = matched(own.select("row", "own"), keyed.select("id", "items", "key")).join(own.select("row", "unwanted"), "row")
    held = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("unwanted").alias("unwanted"))
    found = keyed.join(held, "id").withColumn("confidence", F.col("unwanted") / F.col("n")).withColumn("support", F.col("unwanted") / float(total.n))
    found = staged(found.where((F.col("unwanted") >= least) & (F.col("confidence") >= confidence) & (F.col("confidence") * total.n > total.u)), "rules", spent=(keyed, own))
    # a rule goes if leaving out one or more of its items gives at least its confidence
    inside = matched(found.select(F.col("id").alias("row"), F.col("items").alias("own"), F.col("confidence").alias("whole")), found.select("id", "items", "key", "confidence"))
    worse = inside.where("row != id and confidence >= whole").select(F.col("row").alias("id")).distinct()
    return items, staged(found.join(worse, "id", "left_anti").select("id", "items", "key", "confidence", "support"), "index", spent=(found,))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) of each row of pages(page_id,
    url). labels(page_id, unwanted) may repeat a page_id: unwanted if any says so."""
    rows = staged(with_parts(pages.select("page_id", "url")).withColumn("given", given_rule(rules)).withColumn("row", F.monotonically_increasing_id()), "urls")
    known = labels.where("page_id is not null and unwanted is not null").groupBy("page_id").agg(F.max("unwanted").alias("unwanted"))
    items, index = mined_rules(rows.join(known, "page_id"), **mining)
    hits = matched(items_of(rows.where("given is null").select("row", "tokens"), items), index)
    best = hits.groupBy("row").agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("rule"))).alias("best"))
    out = rows.join(staged(best, "hits"), "row", "left")
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def op9(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("unwanted"))
    return judged(table(spark, sf_dir, "pages"), labels)
