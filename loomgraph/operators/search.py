"""Full-text search and BM25 ranking over postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.cut import cut

K1, B = 1.2, 0.75
#: Words of queries, and items with their texts, that are handed to all tasks; more meet the documents' words by shuffles.
HANDED_WORDS, HANDED_ITEMS = 200_000, 20_000


def handed(df: DataFrame, bound: int) -> Callable[[DataFrame], DataFrame]:
    """How sides that grow with ``df`` alone are joined: handed to all tasks if it has at most ``bound`` rows, which are counted, else left to Spark."""
    return F.broadcast if df.limit(bound + 1).count() <= bound else lambda side: side


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` once, so that what groups by them and more needs no further shuffle; in as many parts as shuffles have, for rows that grow after it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, text: str = "text", key: str = "doc", among: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, length): term counts, of the terms (term) ``among`` if given; combined per document before the shuffle."""
    split = docs.select(F.col(key).alias("doc"), terms(F.col(text)).alias("ts"))
    exploded = split.select("doc", F.size("ts").alias("length"), F.explode_outer("ts").alias("term")).where("term is not null")  # no filter on the array's size, which would split texts twice
    exploded = exploded if among is None else exploded.join(among, "term", "left_semi")
    return exploded.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents, and their mean length in terms."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(terms(F.col(text)))).alias("avg_length"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query, term) of queries (query, text)."""
    return queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc", all_terms: bool = False) -> DataFrame:
    """(query, doc, score, met): Okapi BM25 of every document that has a term of the query (``all_terms``: all of them), and how many of its terms it has.

    queries: query, text. Document frequencies and postings are needed for the queries' terms only. Documents are dealt
    once and scored where they are: terms of queries and their frequencies come to them, and no term's gain is shuffled.
    """
    asked = cut(asked_terms(queries))
    small = handed(asked, HANDED_WORDS)
    here = dealt(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc")
    wanted = postings(here, among=small(asked.select("term").distinct()))
    df = cut(wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    weighed = wanted.join(small(df), "term").join(F.broadcast(statistics(docs, text)))  # statistics: one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = weighed.select("term", "doc", gain.alias("gain")).join(small(asked), "term")
    out = scored.groupBy("query", "doc").agg(F.sum("gain").alias("score"), F.count(F.lit(1)).alias("met"))
    if all_terms:
        sizes = asked.groupBy("query").agg(F.count(F.lit(1)).alias("n_terms"))
        out = out.join(small(sizes), "query").where("met = n_terms")
    return out.select("query", "doc", "score", "met")


def top_k(scored: DataFrame, k: int, group: str | list[str] = "query", tie: str = "doc") -> DataFrame:
    """The ``k`` best of each group by the score rounded to six places, ranked from 1."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round("score", 6)), tie)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def reciprocal_rank_fusion(runs: DataFrame, k: int = 60) -> DataFrame:
    """(query, doc, score) of runs (query, run, doc, rank)."""
    return runs.groupBy("query", "doc").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def prepend(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query, doc, rank): the first ranking, then what the second adds."""
    both = first.select("query", "doc", "rank", F.lit(0).alias("run")).unionByName(second.select("query", "doc", "rank", F.lit(1).alias("run")))
    best = both.groupBy("query", "doc").agg(F.min(F.struct("run", "rank")).alias("at"))
    order = Window.partitionBy("query").orderBy("at", "doc")
    return best.select("query", "doc", F.row_number().over(order).cast("long").alias("rank"))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query, doc): the documents (doc, text) that hold an item's (query, text) whole text. Items without a word hold nothing.

    Whole words of an item, all but its first and last, are whole words of each such
    document: the one in the fewest documents finds the candidates. Items of one or
    two words have none; their longest word is sought inside the documents'
    distinct words, of which all stretches of such lengths are listed. No pair is formed but by an equal key. Up to
    ``HANDED_ITEMS`` items come to the documents, whose texts stay where they are; more meet them by shuffles.
    """
    texts = docs.where("text is not null").select("doc", "text")
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    asked = items.where("text is not null").select("query", F.col("text").alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    holding = texts.select("doc", "text", F.explode_outer(F.array_distinct(words(F.col("text")))).alias("word")).where("word is not null")

    inner = cut(asked.where(F.size("ws") > 2).select("query", F.explode(F.slice("ws", 2, F.size("ws") - 2)).alias("word")).distinct())
    counts = holding.join(handed(inner, HANDED_WORDS)(inner.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keys = inner.join(counts, "word").groupBy("query").agg(F.min_by("word", F.struct("n", "word")).alias("word"))

    longest = F.array_max(F.transform("ws", lambda w: F.struct(F.length(w).alias("size"), w.alias("part"))))
    short = asked.where(F.size("ws") < 3).select("query", longest.alias("key")).select("query", "key.part", "key.size")
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())  # lengths of words, whatever the number of items
    if sizes:
        stretches = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda k: F.substring("word", k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        parts = holding.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*map(stretches, sizes)))).alias("part"))
        keys = keys.unionByName(parts.join(short.select("query", "part"), "part").select("query", "word"))
    keys = cut(keys)
    if keys.limit(HANDED_ITEMS + 1).count() <= HANDED_ITEMS:
        met = holding.join(F.broadcast(keys.join(asked.select("query", "item"), "query")), "word")
        return met.where(F.contains("text", "item")).select("query", "doc").distinct()
    met = keys.join(holding.select("doc", "word"), "word").select("query", "doc").distinct()
    return met.join(asked.select("query", "item"), "query").join(texts, "doc").where(F.contains("text", "item")).select("query", "doc").distinct()


#: Distance between the places of two fields of a row: no phrase crosses it.
FIELD_GAP = 1 << 32


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrases_of(queries: DataFrame) -> DataFrame:
    """(query, phrase, words) of queries (query, text): what stands between double quotes is a phrase, and so is each other run without white space; those without a word are left out."""
    parts = F.regexp_extract_all("text", F.lit(r'("[^"]*"|[^\s"]+)'), F.lit(1))
    split = queries.where("text is not null").select("query", F.posexplode(parts).alias("phrase", "part"))
    return split.select("query", "phrase", words_of(F.col("part")).alias("words")).where(F.size("words") > 0)


def phrase_search(rows: DataFrame, queries: DataFrame, limit: int = 20, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best ``limit`` rows that hold all phrases of a query, and per query (query, total, truncated).

    rows: kind, doc, fields (array of texts), one row each; each kind is an index of its own with its own statistics. Where the queries' words
    come to the rows, each phrase is sought at the places of its longest word. More words meet the rows' by an equal word and, shifted by a word's place in its phrase, count at
    the phrase's start: where all words of a phrase count, it stands. Phrases may lie in any field and never across two.
    Scores are BM25 over phrases (a phrase in half of the rows or more weighs next to nothing). Hits: query, rank, kind, doc, score; ties by kind, then
    doc. ``among`` (kind, doc) filters the hits, not the statistics. total is null where more rows match than are returned. Queries without a word match nothing; null texts are empty.
    """
    asked = cut(phrases_of(queries))
    small = handed(asked.select(F.explode("words")), HANDED_WORDS)
    placed = rows.select("kind", "doc", F.posexplode("fields").alias("field", "text")).select("kind", "doc", "field", words_of(F.coalesce("text", F.lit(""))).alias("ws"))
    lengths = dealt(placed.select("kind", "doc", F.size("ws").alias("size")), "kind", "doc").groupBy("kind", "doc").agg(F.sum("size").alias("length"))
    statistics = lengths.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"))  # a row per kind
    if small is F.broadcast:
        longest = F.array_max(F.transform("words", lambda w, k: F.struct(F.length(w).alias("size"), (-k).alias("k"))))
        wanted = asked.select("query", "phrase", "words", (-longest["k"]).alias("k")).withColumn("word", F.get("words", F.col("k")))
        met = placed.select("kind", "doc", "ws", F.posexplode_outer("ws").alias("at", "word")).join(F.broadcast(wanted), "word")
        starts = met.where((F.col("at") >= F.col("k")) & (F.slice("ws", F.greatest(F.col("at") - F.col("k") + 1, F.lit(1)), F.size("words")) == F.col("words")))
        starts = dealt(starts.select("query", "phrase", "kind", "doc"), "kind", "doc")
    else:
        wanted = asked.select("query", "phrase", F.size("words").alias("m"), F.posexplode("words").alias("k", "word"))
        places = placed.select("kind", "doc", "field", F.posexplode_outer("ws").alias("at", "word")).join(wanted.select("word").distinct(), "word", "left_semi")
        start = F.col("field") * F.lit(FIELD_GAP) + F.col("at") - F.col("k")
        starts = places.join(wanted, "word").groupBy("query", "phrase", "m", "kind", "doc", start.alias("start")).agg(F.count(F.lit(1)).alias("n")).where("n = m")
    said = cut(starts.groupBy("query", "phrase", "kind", "doc").agg(F.count(F.lit(1)).alias("f")))
    df = cut(said.groupBy("query", "phrase", "kind").agg(F.count(F.lit(1)).alias("df")))  # at most a row per phrase and kind
    weighed = said.join(small(df), ["query", "phrase", "kind"]).join(F.broadcast(statistics), "kind").join(lengths, ["kind", "doc"])
    rarity = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.greatest(rarity, F.lit(1e-6)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = weighed.groupBy("query", "kind", "doc").agg(F.sum(gain).alias("score"), F.count(F.lit(1)).alias("met"))
    sizes = asked.groupBy("query").agg(F.count(F.lit(1)).alias("phrases"))
    whole = scored.join(small(sizes), "query").where("met = phrases")
    whole = whole if among is None else whole.join(among, ["kind", "doc"], "left_semi")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "kind", "doc")
    ranked = cut(whole.select("query", "kind", "doc", "score", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= limit + 1))  # one more shows whether there are more
    found = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    state = queries.select("query").distinct().join(found, "query", "left").select(
        "query", F.when(F.coalesce("n", F.lit(0)) <= limit, F.coalesce("n", F.lit(0)).cast("long")).alias("total"), (F.coalesce("n", F.lit(0)) > limit).alias("truncated")
    )
    return ranked.where(F.col("rank") <= limit).select("query", "rank", "kind", "doc", "score"), state
