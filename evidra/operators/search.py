"""Full-text ranking by BM25 over an inverted index kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import question_tokens, search_tokens
from evidra.session import materialize

#: The ranking's parameters and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, length, words): the words of every document, cut once and written, at ``path`` or in the shared folder. Null texts have length 0 and no words."""
    words = F.coalesce(search_tokens(F.col(text_col)), F.array().cast("array<string>"))
    t = docs.select(F.col(id_col).alias("id"), words.alias("words")).select("id", F.size("words").alias("length"), "words")
    if path is None:
        return materialize(t, "index")[0]
    t.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(t.schema).parquet(path)


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id, tf, length) of the ``terms``(term): words meet the terms where they are read, so only what was asked for is shuffled."""
    asked = terms.select("term").distinct()
    return index.select("id", "length", F.explode("words").alias("term")).join(asked, "term").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def top_documents(docs: DataFrame, id_col: str, text_col: str, questions: DataFrame, most: int = 5, eligible: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, place): the ``most`` best documents of each of ``questions``(qid, question), best first, ties by id.

    Statistics are over all documents; ``eligible``(id) only decides what is shown. ``index``: of ``build_index``, if there is one.
    """
    q = questions.select("qid", F.explode(question_tokens(F.col("question"))).alias("term"))
    index = build_index(docs, id_col, text_col) if index is None else index
    post = postings(index, q)
    stats = index.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(stats.avg or 1))))
    if eligible is not None:
        post = post.join(eligible.select(F.col(id_col).alias("id")), "id", "left_semi")
    scored = q.join(post.join(df, "term").withColumn("part", part), "term").groupBy("qid", "id").agg(F.sum("part").alias("s")).withColumn("score", F.round("s", 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("qid", "id", "score", "place")


#: So many characters of a phrase are looked up in the texts; shorter phrases with all they have.
ANCHOR = 8


def phrases_in(phrases: DataFrame, phrase: str, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(phrase) of those that stand in some text, anywhere and as written. Ids of texts are unique.

    Every phrase is looked up by its first ``ANCHOR`` characters among the runs of so many characters of each
    text, by a join; the few texts so met are then searched for the whole phrase. Neither side is collected.
    """
    p = phrases.where(F.length(phrase) > 0).select(F.col(phrase).alias("phrase")).distinct()
    p = p.withColumn("anchor", F.substring("phrase", 1, ANCHOR)).withColumn("size", F.least(F.length("phrase"), F.lit(ANCHOR)))
    sizes = [r["size"] for r in p.select("size").distinct().collect()]  # at most ANCHOR rows
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    runs = F.array_union(F.array().cast("array<string>"), F.flatten(F.array(*(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))) for n in sorted(sizes))))) if sizes else F.array().cast("array<string>")
    met = t.select("id", F.explode(runs).alias("anchor")).join(p.select("phrase", "anchor"), "anchor").select("id", "phrase").distinct()
    return met.join(t, "id").where(F.contains("text", F.col("phrase"))).select(F.col("phrase").alias(phrase)).distinct()
