"""Text as vectors without a trained model: hashed term counts, and similarity search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a vector; words share one by chance once in so many.
BUCKETS = 65_536


def bucket_of(word: Column) -> Column:
    """Place of a word: the first four hexadecimal digits of its MD5, the same in every engine."""
    return F.conv(F.left(F.md5(word), F.lit(4)), 16, 10).cast("int")


def embed_terms(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Sparse vectors of texts: ``key``, ``terms``: the places of a text's words in order, repeated as often as
    the text has them, less 32,768 each (two bytes); words of three letters or more.

    A text without words has no row; texts of one key are one vector.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    terms = F.transform(words, lambda w: (bucket_of(w) - BUCKETS // 2).cast("smallint"))
    rows = texts.select(*key, terms.alias("terms")).where(F.size("terms") > 0)
    return rows.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))


def _norm(terms: Column) -> Column:
    """Root of the summed squares of the weights: the n-th copy of a term adds 2n - 1 to its square."""
    start = F.struct(F.lit(None).cast("smallint").alias("term"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("sum"))

    def step(s: Column, t: Column) -> Column:
        n = F.when(s["term"] == t, s["n"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(t.alias("term"), n.alias("n"), (s["sum"] + 2 * n - 1).alias("sum"))

    return F.aggregate(terms, start, step, lambda s: F.sqrt(s["sum"]))


def _weights(terms: Column) -> Column:
    """``(term, weight)`` of the different terms, from where in the order each begins."""
    places = F.sequence(F.lit(0), F.size(terms) - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    ends = F.concat(F.slice(begins, 2, F.size(terms)), F.array(F.size(terms)))
    return F.zip_with(begins, ends, lambda i, j: F.struct(F.get(terms, i).alias("term"), (j - i).cast("bigint").alias("weight")))


#: Words of queries up to which a group's stored texts are compared with all its queries; larger groups join by place.
FEW_TERMS = 256


def similar_texts(queries: DataFrame, stored: DataFrame, group: list[str], query_id: str, item_id: list[str], k: int, few: int = FEW_TERMS) -> DataFrame:
    """The ``k`` stored texts of a query's group most like it by cosine; ties go to the smaller id.

    Both sides are sparse vectors (see ``embed_terms``).  A group whose queries have up to ``few`` words brings
    them as one row to each of its texts; the others meet by group and place, so texts without a common
    word are never compared there.
    """
    known = lambda rows, ids: rows.dropna(subset=[*group, *ids]).withColumn("__norm", _norm(F.col("terms")))
    asked, items = known(queries, [query_id]), known(stored, item_id)
    sizes = asked.groupBy(*group).agg(F.sum(F.size("terms")).alias("__n"))
    listed = asked.join(sizes.where(F.col("__n") <= few), group, "left_semi").groupBy(*group)
    listed = listed.agg(F.collect_list(F.struct(query_id, "terms", F.col("__norm").alias("norm"))).alias("__asked"))

    def dot(terms: Column) -> Column:
        copies = lambda t: F.size("terms") - F.size(F.array_remove("terms", t))
        return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, t: s + copies(t))

    met = F.transform("__asked", lambda q: F.struct(q[query_id].alias(query_id), q["norm"].alias("__left"), dot(q["terms"]).alias("dot")))
    near = items.join(listed, group).select(*group, *item_id, F.col("__norm").alias("__right"), F.inline(met)).where(F.col("dot") > 0)

    many = sizes.where(F.col("__n") > few)
    spread = lambda rows, ids, norm, weight: rows.join(many, group, "left_semi").select(
        *group, *ids, F.col("__norm").alias(norm), F.inline(_weights(F.col("terms"))).alias("term", weight)
    )
    far = spread(asked, [query_id], "__left", "__w").join(spread(items, item_id, "__right", "__v"), [*group, "term"])
    far = far.groupBy(*group, query_id, *item_id, "__left", "__right").agg(F.sum(F.col("__w") * F.col("__v")).alias("dot"))
    scored = near.unionByName(far).withColumn("score", F.round(F.col("dot") / (F.col("__left") * F.col("__right")), 6))
    best = Window.partitionBy(*group, query_id).orderBy(F.desc("score"), *item_id)
    ranked = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return ranked.select(*group, query_id, *item_id, "score", "place")
