"""Joins of names of which one contains, or ends with, the other.

A name can only lie in texts that have each of its grams, so it is looked up by the one of its grams
that the fewest texts have, and what is found is verified: no pair without a common rare gram is
made. A gram that no text has settles a name at once. Ends are looked up by equality with every end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.sources.shared import written

#: Characters of a gram; shorter names are looked up whole.
GRAM = 4


def plain_name(name: Column) -> Column:
    """Letters and digits of a name in lower case; empty for none."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]", ""))


def _grams(text: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size)))


def contained(needles: DataFrame, needle: str, texts: DataFrame, text: str, least: int = 1) -> DataFrame:
    """``needle``, ``text``: the distinct pairs in which the text contains the needle, both of ``least``
    characters or more; null and empty ones are in no pair."""
    short = min(least, GRAM)
    asked = needles.select(F.col(needle).alias("x")).where(F.char_length("x") >= max(1, least)).distinct()
    held = written(texts.select(F.col(text).alias("y")).where(F.char_length("y") >= max(1, least)).distinct(), "texts")
    sizes = [n for n in range(max(1, short), GRAM + 1)]
    each = F.flatten(F.array(*[F.when(F.char_length("y") >= n, _grams(F.col("y"), n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
    index = written(held.select(F.explode(each).alias("gram"), "y"), "grams")
    counts = index.groupBy("gram").agg(F.count("*").alias("texts"))
    own = asked.select("x", F.explode(_grams(F.col("x"), F.least(F.char_length("x"), F.lit(GRAM)))).alias("gram"))
    known = own.join(counts, "gram", "left").groupBy("x").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest"))
    rarest = known.where(F.col("rarest.texts") > 0).select("x", F.col("rarest.gram").alias("gram"))
    met = rarest.join(index, "gram").where(F.contains("y", F.col("x")))
    return met.select(F.col("x").alias(needle), F.col("y").alias(text))


def either_contains(a: DataFrame, left: str, b: DataFrame, right: str, least: int = 1) -> DataFrame:
    """``left``, ``right``: distinct pairs of which one contains the other."""
    down = contained(a, left, b, right, least)
    up = contained(b, right, a, left, least).select(left, right)
    return down.unionByName(up).distinct()


def either_ends(a: DataFrame, left: str, b: DataFrame, right: str) -> DataFrame:
    """``left``, ``right``: distinct pairs of which one ends with the other; empty names are in no pair."""
    names = lambda rows, c, out: rows.select(F.col(c).alias(out)).where(F.char_length(c) > 0).distinct()
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.right(F.col(c), i))
    down = names(a, left, left).join(names(b, right, right).withColumn(left, F.explode(ends(right))), left)
    up = names(b, right, right).join(names(a, left, left).withColumn(right, F.explode(ends(left))), right)
    return down.select(left, right).unionByName(up.select(left, right)).distinct()


def find_hints(libraries: DataFrame, hints: DataFrame, least: int = 4) -> DataFrame:
    """id, hint, how: for libraries (id, name, key) the first of the hints (hint, name) by hint whose plain
    name is that of the library or of its key; else the first of which one contains the other, both of
    ``least`` characters or more."""
    own = libraries.select("id", F.explode(F.array(plain_name(F.col("name")), plain_name(F.col("key")))).alias("own")).where("own <> ''").distinct()
    named = hints.select("hint", plain_name(F.col("name")).alias("other")).where("other <> ''").groupBy("other").agg(F.min("hint").alias("hint"))
    own, named = written(own, "own-names"), written(named, "hint-names")
    equal = own.join(named, F.col("own") == F.col("other")).select("id", "hint", F.lit(0).alias("tier"))
    pairs = either_contains(own, "own", named, "other", least)
    near = own.join(pairs, "own").join(named, "other").select("id", "hint", F.lit(1).alias("tier"))
    best = equal.union(near).groupBy("id").agg(F.min(F.struct("tier", "hint")).alias("best"))
    return best.select("id", "best.hint", F.when(F.col("best.tier") == 0, "equal").otherwise("contains").alias("how"))


def product_keys(libraries: DataFrame, products: DataFrame, containers: DataFrame, vendors: list[str], least: int = 8, sep: str = "/") -> DataFrame:
    """id, reg_key, how: the product keys of libraries (id, name, path) from products (reg_key, content_dir).

    By path where a product's content is the library's folder or below it; only where there is none, by
    names of which one ends with the other, the key's of ``least`` characters or more; and the keys of the
    library's containers (id, key) besides. A key counts once, by its first way.
    """
    from sonaria.functions.scalars import normalize_name
    from sonaria.operators.relational import longest_prefix

    owned = longest_prefix(products.select("reg_key", "content_dir").distinct(), "content_dir", libraries.select("id", "path"), "path", sep)
    by_path = written(owned.select("id", "reg_key", F.lit(0).alias("way")), "keys-by-path")
    left = libraries.join(by_path.select("id"), "id", "left_anti").select("id", normalize_name(F.col("name"), vendors).alias("plain"))
    keys = products.select("reg_key", normalize_name(F.col("reg_key"), vendors).alias("key")).distinct().where(F.char_length("key") >= least)
    left, keys = written(left, "names-left"), written(keys, "key-names")
    pairs = either_ends(left, "plain", keys, "key")
    by_name = left.join(pairs, "plain").join(keys, "key").select("id", "reg_key", F.lit(1).alias("way"))
    held = containers.where(F.coalesce("key", F.lit("")) != "").select("id", F.col("key").alias("reg_key"), F.lit(2).alias("way"))
    every = by_path.union(by_name).union(held).groupBy("id", F.lower("reg_key").alias("low")).agg(F.min(F.struct("way", "reg_key")).alias("best"))
    how = F.element_at(F.array(F.lit("path"), F.lit("name"), F.lit("container")), F.col("best.way") + 1)
    return every.select("id", "best.reg_key", how.alias("how"))


def related_terms(terms: DataFrame, families: DataFrame) -> DataFrame:
    """term, related: for each distinct term (trimmed, lower case) the words of the first of the families
    (rank, word, related array) whose word it is, contains, or lies in; without the words it contains."""
    asked = written(terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct(), "terms")
    words = written(families.select("rank", F.lower("word").alias("word"), "related"), "families")
    pairs = either_contains(asked, "term", words, "word")
    first = pairs.join(words, "word").groupBy("term").agg(F.min_by("related", "rank").alias("related"))
    return first.select("term", F.array_distinct(F.filter("related", lambda w: ~F.contains(F.col("term"), w))).alias("related"))
