"""Best-of, first-of and latest-of choices; upserts; verbatim tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.align import RANK, rank_of
from attestor.operators.staging import staged


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Ranks up to 1 are cut before the shuffle, so hot keys move one row for each task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_latest(table: DataFrame, changes: DataFrame, keys: list[str], at: str, tie: str | None = None) -> DataFrame:
    """Replaces rows by key; the latest wins."""
    return first_of(table.unionByName(changes), keys, [F.desc(at), *([F.desc(tie)] if tie else [])])


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds rows whose key isn't there; among new rows of one key the first wins."""
    return table.unionByName(first_of(rows.join(table.select(*keys), keys, "left_anti"), keys, order))


def primary_over_secondary(best: DataFrame, keys: list[str], secondary: Column) -> DataFrame:
    """Best match of each key by (class, coverage, span similarity, confidence), but the best of the primary sources
    where it is identical or partial and the overall best is secondary. best: match_type, coverage, span_sim,
    confidence, rank, doc_id."""
    order = [F.desc(rank_of(F.col("match_type"))), F.desc(F.bround("coverage", 2)), F.desc(F.bround("span_sim", 3)), F.desc("confidence"), F.col("rank"), F.col("doc_id")]
    marked = best.withColumn("__s", secondary)
    exact = (~F.col("__s")) & F.col("match_type").isin("identical", "partial")
    return first_of(marked.withColumn("__e", exact), keys, [F.desc("__e"), *order]).drop("__s", "__e")


def best_class(matches: DataFrame, keys: list[str]) -> DataFrame:
    """All matches of each key's best class, if that is altered or better, best first."""
    r = rank_of(F.col("match_type"))
    top = F.max(r).over(Window.partitionBy(*keys))
    return matches.withColumn("__top", top).where((F.col("__top") >= RANK["altered"]) & (r == F.col("__top"))).drop("__top")


def distinct_ratings(ratings: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First rating of each (rater, label, work) for each key, without empty labels."""
    return first_of(ratings.where("coalesce(label, '') <> ''"), [*keys, "rater", "label", "work"], [order])


def verbatim_exists(segments: DataFrame, sources: DataFrame, text: str = "text") -> DataFrame:
    """segments with ``exists``: their text is a substring of a source text.

    A segment of three words or more has an inner word, whole as it has neighbours on both sides: the longest one must
    be a word of the source. The first word of a shorter segment must be a part of a word of the source, which is looked
    up among the distinct words. Sources are named by two hashes until the few that hold such a word are known; only
    those are fetched and compared. Null segments exist nowhere; blank ones are compared with all sources."""
    key = [F.xxhash64("__text").alias("__k1"), F.xxhash64("__text", F.lit("second")).alias("__k2")]
    src = sources.select(F.col(text).alias("__text")).where(F.col("__text").isNotNull()).select(*key, "__text")
    longest = lambda a: F.get(F.sort_array(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))), asc=False), 0)["w"]
    asked = segments.select(F.col(text).alias("__seg")).where(F.col("__seg").isNotNull()).distinct()
    split = F.split("__seg", r"\s+")
    inner = F.filter(F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0))), lambda x: x != "")
    w = F.filter(split, lambda x: x != "")
    s = staged(asked.select("__seg", longest(inner).alias("__key"), F.get(w, 0).alias("__part")), "segments")
    words = src.select("__k1", "__k2", F.explode(F.array_distinct(F.split("__text", r"\s+"))).alias("__key"))
    keyed = s.where("__key is not null").select("__seg", "__key")
    if not (short := s.where("__key is null and __part is not null")).isEmpty():
        # every stretch of a word that is as long as some short segment's first word
        sizes = short.agg(F.collect_set(F.length("__part")).alias("__sizes"))
        parts = words.select("__key").distinct().crossJoin(F.broadcast(sizes)).select("__key", F.explode("__sizes").alias("__n")).where(F.length("__key") >= F.col("__n"))
        parts = parts.select("__key", F.explode(F.transform(F.sequence(F.lit(1), F.length("__key") - F.col("__n") + 1), lambda i: F.substr("__key", i, F.col("__n")))).alias("__part")).distinct()
        keyed = keyed.unionByName(parts.join(short.select("__seg", "__part"), "__part").select("__seg", "__key"))
    keyed = staged(keyed, "segment-words")
    pairs = staged(words.join(keyed, "__key").select("__k1", "__k2", "__seg").distinct(), "segment-sources")
    met = src.join(pairs.select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_semi").join(pairs, ["__k1", "__k2"])
    hit = met.where(F.col("__text").contains(F.col("__seg"))).select("__seg").distinct()
    if not (blank := s.where("__part is null").select("__seg")).isEmpty():
        hit = hit.unionByName(blank.join(src.select("__text"), F.col("__text").contains(F.col("__seg")), "left_semi"))
    return segments.join(hit.withColumn("__hit", F.lit(True)), segments[text] == F.col("__seg"), "left").withColumn("exists", F.coalesce("__hit", F.lit(False))).drop("__hit", "__seg")


def equal_exists(segments: DataFrame, sources: DataFrame, text: str = "text") -> DataFrame:
    """segments with ``exists``: a source text is equal to theirs."""
    known = sources.select(F.col(text).alias("__t")).distinct().withColumn("__hit", F.lit(True))
    return segments.join(known, segments[text] == F.col("__t"), "left").withColumn("exists", F.coalesce("__hit", F.lit(False))).drop("__t", "__hit")
