"""Change destinations from delivery history: frequency, similarity, co-change and a word index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators.cut import cut
from loomgraph.operators.products import products
from loomgraph.operators.search import HANDED_ITEMS, HANDED_WORDS, handed

SEEDS, FACTOR = 256, 0.25
#: Destinations that hand their score on to what they are related with.
STRUCTURE_SEEDS = 20
#: Weight of what paths and structure say beside history.
BASELINE = 0.08
WINDOW, LABEL_FILES, MIN_SUPPORT, KAPPA, STOP_SHARE = 4000, 20, 2, 1.0, 0.3


def eligible(deliveries: DataFrame, before_day=None, exclude: list[int] | None = None) -> DataFrame:
    """Deliveries strictly before a cutoff, without the target's own."""
    out = deliveries if before_day is None else deliveries.where(F.col("day") < F.lit(before_day))
    return out.where(~F.col("delivery_id").isin(exclude)) if exclude else out


def prevalence(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("file").agg(F.countDistinct("delivery_id").alias("prevalence"))


def frequency(deliveries: DataFrame) -> DataFrame:
    """(file, score): the share of deliveries that change each file."""
    total = deliveries.agg(F.countDistinct("delivery_id").alias("total"))  # one row
    return prevalence(deliveries).join(F.broadcast(total)).select("file", (F.col("prevalence") / F.col("total")).alias("score"))


def similarities(tasks: DataFrame, queries: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, task, similarity) of query and task texts that share a token, and (delivery_id, task).

    tasks: delivery_id, text, equal texts being one task; or, with ``texts`` (task, text; one row each), delivery_id, task. The latter
    reads a text once however many deliveries have it.
    """
    if texts is None:
        keyed = tasks.select("delivery_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("task"))
        tasks, told = keyed, keyed.select("task", F.explode_outer(S.tokens(F.col("text"))).alias("token"))
    else:
        told = texts.select("task", F.explode_outer(S.tokens(F.col("text"))).alias("token"))
    asked = cut(queries.select("query", S.tokens(F.col("text")).alias("asked")).select("query", F.size("asked").alias("n"), F.explode("asked").alias("token")))
    small = handed(asked, HANDED_WORDS)
    told = told.join(small(asked.select("token").distinct()), "token", "left_semi").repartition("task").distinct()
    shared = told.join(small(asked), "token").groupBy("query", "task").agg((F.count(F.lit(1)) / F.max("n")).alias("similarity"))
    return shared, tasks.select("delivery_id", "task")


def one_task(shared: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shared`` and ``told`` with one row a delivery. The tasks of a delivery that has several become one task, as similar to a query as the most similar of them, and ``tasks`` is their number."""
    rows = told.groupBy("delivery_id").agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("task")).alias("members"))
    many = cut(rows.where("rows > 1").select("delivery_id", "members"))
    if many.isEmpty():
        return shared, told.withColumn("tasks", F.lit(1))
    alone = F.to_json(F.array("task")).alias("task")
    joint = many.select("delivery_id", F.to_json("members").alias("task"), F.size("members").alias("tasks"), "members")
    whole = told.join(many, "delivery_id", "left_anti").select("delivery_id", alone, F.lit(1).alias("tasks")).unionByName(joint.drop("members"))
    parts = joint.where("tasks > 1").select(F.col("task").alias("joint"), F.explode("members").alias("task")).distinct()
    best = shared.join(parts, "task").groupBy("query", "joint").agg(F.max("similarity").alias("similarity")).withColumnRenamed("joint", "task")
    return shared.select("query", alone, "similarity").unionByName(best), whole


def delivery_weights(deliveries: DataFrame, *carried: str) -> DataFrame:
    """(delivery_id, file, weight, and the columns ``carried``): recency, breadth, ubiquity, evidence and artifact factors of one delivery's change of a file."""
    nth = F.row_number().over(Window.partitionBy("delivery_id").orderBy("file"))
    pairs = deliveries.select("delivery_id", "file").distinct().withColumn("nth", nth)
    files = cut(pairs.groupBy("file").agg(F.count(F.lit(1)).alias("prevalence"), F.count(F.when(F.col("nth") == 1, 1)).alias("firsts")))
    total = files.agg(F.sum("firsts").alias("total"))  # one row: each delivery counts at its first file
    breadth = F.count(F.lit(1)).over(Window.partitionBy("delivery_id"))
    met = deliveries.withColumn("breadth", breadth).join(handed(files, HANDED_ITEMS)(files.select("file", "prevalence")), "file").join(F.broadcast(total))
    weight = (
        S.recency(F.col("distance")) * S.ambiguity(F.col("breadth")) * S.ubiquity(F.col("prevalence"), F.col("total")) * S.evidence_weight(F.col("verified"))
        * S.artifact_discount(F.col("file"))
    )
    return met.select("delivery_id", "file", weight.alias("weight"), *carried)


def history_scores(deliveries: DataFrame, tasks: DataFrame, queries: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(query, file, score, deliveries, strongest): similarity of query and task text times each delivery's weight, over deliveries (one row per delivery and file).

    queries: query, text; tasks and texts as in ``similarities``. Only tasks that share a token with the query are met. All that depends on deliveries alone
    is folded into one row per task and file, and tasks meet in shares that are multiplied as blocks, so no row per query, task and file is formed.
    A delivery of several tasks counts once, with the most similar of them, and less by their number. ``accumulated`` has what the sums are made of.
    """
    shared, told = one_task(*similarities(tasks, queries, texts))
    weighed = delivery_weights(deliveries).join(told, "delivery_id").withColumn("weight", F.col("weight") * S.ambiguity(F.col("tasks")))
    folded = weighed.groupBy("task", "file").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("most"))
    met = products(shared, folded)
    return met.groupBy("query", "file").agg(F.sum("score").alias("score"), F.sum("n").alias("deliveries"), F.max("strongest").alias("strongest"))


def accumulated(deliveries: DataFrame, tasks: DataFrame, queries: DataFrame, texts: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(query, file, score, tasks, deliveries, reasons, file_fallback, fallback, strongest): what ``history_scores`` sums, with all that supports each destination.

    tasks: those that share a token with the query, of the deliveries that change the file; deliveries: their ids. reasons: (contribution, kind, delivery_id,
    explanation) of each delivery, the greatest contribution first, then by kind and delivery. ``deliveries`` may have a column fallback (null: none); fallback is
    the first by delivery_id. A row per query, delivery and file is formed: ``only`` (query, file) asks for some destinations, as ranked ones.
    """
    carried = ["verified", "distance", *(["fallback"] if "fallback" in deliveries.columns else [])]
    shared, told = similarities(tasks, queries, texts)
    told = told.distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("delivery_id")))
    rows = delivery_weights(deliveries, *carried)
    if only is not None:
        rows = rows.join(only.select("query", "file").distinct(), "file")
    met = rows.join(told, "delivery_id").join(shared, ["task"] if only is None else ["query", "task"])
    if "fallback" not in carried:
        met = met.withColumn("fallback", F.lit(None).cast("string"))
    by = ["query", "file", "delivery_id"]
    each = met.groupBy(*by).agg(F.collect_set("task").alias("tasks"), F.max("similarity").alias("similarity"), *(F.first(c).alias(c) for c in ("weight", "n", "verified", "distance", "fallback")))
    each = each.withColumn("contribution", F.col("similarity") * F.col("weight") * S.ambiguity(F.col("n")))
    told_as = F.format_string(
        "task similarity %.3f, actual-change evidence %.2f, recency %.3f, broad/ambiguous/ubiquity/artifact discounts applied; source ID: %s",
        F.col("similarity").cast("double"), S.evidence_weight(F.col("verified")).cast("double"), S.recency(F.col("distance")).cast("double"), F.col("delivery_id").cast("string"),
    )
    reason = F.struct((-F.col("contribution")).alias("less"), F.lit("historical_change").alias("kind"), "delivery_id", "contribution", told_as.alias("explanation"))
    out = each.groupBy("query", "file").agg(
        F.sum("contribution").alias("score"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("tasks")))).alias("tasks"),
        F.sort_array(F.collect_set("delivery_id")).alias("deliveries"),
        F.sort_array(F.collect_list(reason)).alias("reasons"),
        F.max(F.col("fallback").isNotNull()).alias("file_fallback"),
        F.min_by("fallback", F.when(F.col("fallback").isNotNull(), F.col("delivery_id"))).alias("fallback"),
        F.max("contribution").alias("strongest"),
    )
    plain = F.transform("reasons", lambda r: F.struct(r["contribution"].alias("contribution"), r["kind"].alias("kind"), r["delivery_id"].alias("delivery_id"), r["explanation"].alias("explanation")))
    return out.withColumn("reasons", plain)


def cochange_rules(deliveries: DataFrame, min_support: int = 1) -> DataFrame:
    """(src, dst, support, confidence, lift) of files that deliveries change together.

    The pairs of one delivery are those of its own files, so their number follows the deliveries' breadth.
    """
    rows = deliveries.select("delivery_id", "file").distinct()
    pairs = rows.select("delivery_id", F.col("file").alias("src")).join(rows.select("delivery_id", F.col("file").alias("dst")), "delivery_id").where("src <> dst")
    support = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    p = prevalence(deliveries)
    total = deliveries.agg(F.countDistinct("delivery_id").alias("total"))  # one row
    joined = support.join(p.select(F.col("file").alias("src"), F.col("prevalence").alias("src_n")), "src").join(p.select(F.col("file").alias("dst"), F.col("prevalence").alias("dst_n")), "dst")
    confidence = F.col("support") / F.col("src_n")
    return joined.join(F.broadcast(total)).select("src", "dst", "support", confidence.alias("confidence"), (confidence / (F.col("dst_n") / F.col("total"))).alias("lift"))


def cochange_scores(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """(query, file, score, seed): each destination's best contribution from the query's 256 strongest seeds (ties: the smaller seed)."""
    order = Window.partitionBy("query").orderBy(F.desc(S.round6(F.col("strongest"))), "file")
    seeds = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEEDS).select("query", F.col("file").alias("src"), "strongest")
    gained = seeds.join(rules, "src").select("query", "src", F.col("dst").alias("file"), (F.col("strongest") * F.col("confidence") * F.log(1 + F.col("lift")) * FACTOR).alias("gain"))
    best = gained.groupBy("query", "file").agg(F.max("gain").alias("score"), F.min_by("src", F.struct(-F.col("gain"), F.col("src"))).alias("seed"))
    return best


def finalize(scores: DataFrame, limit: int = 10) -> DataFrame:
    """(query, file, score, rank): positive scores rounded to six places, best first, ties by file."""
    rounded = scores.where("score > 0").withColumn("score", S.round6(F.col("score")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "file")
    return rounded.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select("query", "file", "score", "rank")


def recommend(deliveries: DataFrame, tasks: DataFrame, queries: DataFrame, limit: int = 10, variant: str = "combined", texts: DataFrame | None = None) -> DataFrame:
    """Ranked destinations of each query. Variants: combined, task_search_only, frequency, word_index; the first two take ``texts`` as ``history_scores`` does."""
    if variant == "frequency":
        return finalize(queries.select("query").distinct().join(F.broadcast(frequency(deliveries).orderBy(F.desc("score"), "file").limit(limit))), limit)  # limit rows
    if variant == "word_index":
        return finalize(word_index_scores(word_index(deliveries, tasks), queries), limit)
    if variant not in ("combined", "task_search_only"):
        raise ValueError(f"unknown variant {variant!r}")
    history = cut(history_scores(deliveries, tasks, queries, texts))
    scores = history.select("query", "file", "score")
    if variant == "combined":
        scores = scores.unionByName(cochange_scores(history, cochange_rules(deliveries)).select("query", "file", "score"))
    return finalize(scores.groupBy("query", "file").agg(F.sum("score").alias("score")), limit)


def equivalent_boundaries(deliveries: DataFrame) -> DataFrame:
    """(day, distance, verified_id, first_id, n): the deliveries of one boundary, and the first verified of them."""
    verified = F.when(F.col("verified"), F.col("delivery_id"))
    return deliveries.groupBy("day", "distance").agg(F.min(verified).alias("verified_id"), F.min("delivery_id").alias("first_id"), F.countDistinct("delivery_id").alias("n"))


def lexical_baseline(files: DataFrame, queries: DataFrame, weight: float = BASELINE) -> DataFrame:
    """(query, file, score): the share of a query's tokens that a file's path has, times ``weight``, less for generated and minor files."""
    parts = files.select("file", F.explode(S.tokens(F.col("file"))).alias("token"))
    asked = queries.select("query", S.tokens(F.col("text")).alias("ts")).select("query", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    share = asked.join(parts, "token").groupBy("query", "file").agg((F.count(F.lit(1)) / F.max("n")).alias("share"))
    return share.select("query", "file", (F.col("share") * weight * S.artifact_discount(F.col("file"))).alias("score"))


def structure_scores(neighbors: DataFrame, seeds: DataFrame, weight: float = BASELINE, limit: int = STRUCTURE_SEEDS) -> DataFrame:
    """(query, neighbor, score): each seed's score times ``weight`` to each of its neighbours (seed, neighbor).

    seeds: query, seed, score. A query's first ``limit`` seeds of a positive score, in the order of their names, hand on.
    """
    place = F.row_number().over(Window.partitionBy("query").orderBy("seed"))
    chosen = seeds.where("score > 0").withColumn("place", place).where(F.col("place") <= limit).select("query", "seed", "score")
    return chosen.join(neighbors.select("seed", "neighbor"), "seed").groupBy("query", "neighbor").agg(F.sum(F.col("score") * weight).alias("score"))


def label_reasons(deliveries: DataFrame, max_files: int = LABEL_FILES) -> DataFrame:
    """(reason, deliveries): how many deliveries are used as labels, and how many change too many files for one."""
    sized = deliveries.groupBy("delivery_id").agg(F.countDistinct("file").alias("n"))
    return sized.groupBy(F.when(F.col("n") > max_files, "label_over_max_files").otherwise("used").alias("reason")).agg(F.count(F.lit(1)).alias("deliveries"))


def freshness(deliveries: DataFrame) -> DataFrame:
    """(scope, freshness): current if the scope's last delivery (scope, at) is as new as the newest of all."""
    newest = deliveries.agg(F.max("at").alias("newest"))  # one row
    last = deliveries.groupBy("scope").agg(F.max("at").alias("last"))
    return last.join(F.broadcast(newest)).select("scope", F.when(F.col("last") >= F.col("newest"), "current").otherwise("stale").alias("freshness"))


def index_window(deliveries: DataFrame, window: int = WINDOW, max_files: int = LABEL_FILES) -> DataFrame:
    """The newest ``window`` deliveries of 1 to ``max_files`` files, by distance, then id; broader ones take no slot."""
    sized = deliveries.groupBy("delivery_id").agg(F.min("distance").alias("distance"), F.countDistinct("file").alias("n")).where(F.col("n") <= max_files)
    chosen = sized.orderBy("distance", "delivery_id").limit(window).select("delivery_id")
    return deliveries.join(chosen, "delivery_id", "left_semi")


def word_index(deliveries: DataFrame, tasks: DataFrame, min_support: int = MIN_SUPPORT, stop_share: float = STOP_SHARE) -> DataFrame:
    """(term, file, assoc): smoothed positive association of task terms and changed files."""
    rows = index_window(deliveries).select("delivery_id", "file").distinct()
    ids = rows.select("delivery_id").distinct()
    told = tasks.join(ids, "delivery_id", "left_semi").select("delivery_id", F.explode(S.tokens(F.col("text"))).alias("term"))
    total = ids.agg(F.count(F.lit(1)).alias("n"))  # one row
    df = told.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).where(F.col("df") <= stop_share * F.col("n"))
    mass = rows.groupBy("file").agg(F.count(F.lit(1)).alias("mass"))
    observed = told.join(df.select("term"), "term", "left_semi").join(rows, "delivery_id").groupBy("term", "file").agg(F.count(F.lit(1)).alias("obs")).where(F.col("obs") >= min_support)
    weighed = observed.join(df, "term").join(mass, "file")
    return weighed.select("term", "file", S.association(F.col("obs"), F.col("df") * F.col("mass") / F.col("n"), KAPPA).alias("assoc")).where("assoc > 0")


def word_index_scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    asked = queries.select("query", F.explode(S.tokens(F.col("text"))).alias("term"))
    return asked.join(index, "term").groupBy("query", "file").agg(F.sum("assoc").alias("score"))
