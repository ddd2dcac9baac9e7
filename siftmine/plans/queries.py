"""Named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmine.operators import cluster, graph, itemsets, recommend, relational, similarity, sketches
from siftmine.streaming import jobs

from . import testdata as T


def review_stats(spark, d) -> DataFrame:
    return relational.review_stats(T.reviews(spark, d), year="2024-01-1")


def top10_users(spark, d) -> DataFrame:
    return relational.top_counts(T.reviews(spark, d), "user_id")


def top10_items(spark, d) -> DataFrame:
    return relational.top_counts(T.ratings(spark, d), "i")


def nation_means(spark, d) -> DataFrame:
    c = T.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(T.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return relational.grouped_mean(T.table(spark, d, "orders"), c, "o_custkey", "n_name", "o_totalprice", "stars").withColumn("stars", F.round("stars", 4))


def grouped_mean_topk(spark, d) -> DataFrame:
    return relational.top_means(nation_means(spark, d), "n_name", "stars")


def partition_layout(spark, d) -> DataFrame:
    return relational.partition_layout(T.table(spark, d, "lineitem").repartition(8, "l_orderkey"), 5)


def _sets(df: DataFrame) -> DataFrame:
    return df.select(F.array_join(F.col("items").cast("array<string>"), "|").alias("items"), "n")


def frequent_pairs(spark, d) -> DataFrame:
    return _sets(itemsets.frequent(itemsets.baskets(T.order_brands(spark, d), "l_orderkey", "p_brand"), 350, 2))


def frequent_triples(spark, d) -> DataFrame:
    return _sets(itemsets.frequent(itemsets.baskets(T.order_brands(spark, d), "l_orderkey", "p_brand"), 60, 3).where(F.size("items") == 3))


def frequent_large_baskets(spark, d) -> DataFrame:
    return _sets(itemsets.frequent(itemsets.baskets(T.order_brands(spark, d), "l_orderkey", "p_brand", larger_than=5), 100))


def frequent_swapped(spark, d) -> DataFrame:
    return _sets(itemsets.frequent(itemsets.baskets(T.ratings(spark, d), "i", "u"), 33))


def frequent_fp_growth(spark, d) -> DataFrame:
    return _sets(itemsets.fp_growth(itemsets.baskets(T.order_brands(spark, d), "l_orderkey", "p_brand"), 350))


def son_frequent(spark, d) -> DataFrame:
    return _sets(itemsets.son(itemsets.baskets(T.order_brands(spark, d), "l_orderkey", "p_brand"), 350)[1])


def son_candidates(spark, d) -> DataFrame:
    found = itemsets.son(itemsets.baskets(T.order_brands(spark, d), "l_orderkey", "p_brand"), 350)[0]
    return found.select(F.array_join("items", "|").alias("items"), "parts")


def sorted_baskets(spark, d) -> DataFrame:
    found = itemsets.sorted_baskets(itemsets.baskets(T.order_brands(spark, d), "l_orderkey", "p_brand", larger_than=5))
    return found.select("basket", F.array_join("items", "|").alias("items"))


def minhash_signatures(spark, d) -> DataFrame:
    members, m = similarity.elements(T.doc_words(spark, d), "doc_id", "word")
    return similarity.signatures(members, m).withColumnRenamed("set_id", "doc_id")


def lsh_candidates(spark, d) -> DataFrame:
    members, m = similarity.elements(T.doc_words(spark, d), "doc_id", "word")
    return similarity.candidate_pairs(similarity.signatures(members, m))


def lsh_similar_pairs(spark, d) -> DataFrame:
    return similarity.similar_pairs(T.doc_words(spark, d), "doc_id", "word").withColumn("similarity", F.round("similarity", 6))


def user_pearson(spark, d) -> DataFrame:
    train, _ = T.split(T.ratings(spark, d))
    return similarity.correlations(train, "u", "i", "stars", digits=6)


def user_cf(spark, d) -> DataFrame:
    return recommend.user_cf(*T.split(T.ratings(spark, d))).withColumn("prediction", F.round("prediction", 5))


def item_cf(spark, d) -> DataFrame:
    return recommend.item_cf(*T.split(T.ratings(spark, d))).withColumn("prediction", F.round("prediction", 5))


def lsh_item_cf(spark, d) -> DataFrame:
    return recommend.lsh_item_cf(*T.split(T.brand_ratings(spark, d))).withColumn("prediction", F.round("prediction", 5))


def cf_rmse(spark, d) -> DataFrame:
    train, test = T.split(T.ratings(spark, d))
    return recommend.rmse(test, recommend.item_cf(train, test)).withColumn("rmse", F.round("rmse", 5))


def als_predictions(spark, d) -> DataFrame:
    return recommend.als(*T.split(T.ratings(spark, d)))


def overlap_graph(spark, d) -> DataFrame:
    return graph.overlap_graph(T.ratings(spark, d), "u", "i", 33)


def label_propagation(spark, d) -> DataFrame:
    return graph.label_propagation_by_class(*graph.overlap_classes(T.ratings(spark, d), "u", "i", 33)).select("id", "label")


def connected_components(spark, d) -> DataFrame:
    pairs = similarity.similar_pairs(T.doc_words(spark, d), "doc_id", "word")
    return graph.connected_components(graph.both_directions(pairs, "id1", "id2"))


def edge_betweenness(spark, d) -> DataFrame:
    members, links = graph.overlap_classes(T.ratings(spark, d), "u", "i", 35)
    return graph.spread_edges(members, graph.betweenness_by_class(members, links)).withColumn("value", F.round("value", 6))


def modularity(spark, d) -> DataFrame:
    members, links = graph.overlap_classes(T.ratings(spark, d), "u", "i", 33)
    return graph.modularity_by_class(graph.label_propagation_by_class(members, links), links).withColumn("modularity", F.round("modularity", 8))


def communities(spark, d) -> DataFrame:
    return graph.communities_by_class(*graph.overlap_classes(T.ratings(spark, d), "u", "i", 35))


def mahalanobis_assign(spark, d) -> DataFrame:
    p = T.points(spark, d)
    return cluster.nearest(p, cluster.summaries(p), 2 * 64**0.5).withColumn("distance", F.round("distance", 6))


def bfr_rounds(spark, d) -> DataFrame:
    return cluster.bfr(T.points(spark, d).select("id", "features"), 10)[0]


def bfr_clusters(spark, d) -> DataFrame:
    return cluster.bfr(T.points(spark, d).select("id", "features"), 10)[1]


def bloom_fpr(spark, d) -> DataFrame:
    return sketches.bloom_fpr(T.city_stream(spark, d), "event_id", "city", "day").withColumn("fpr", F.round("fpr", 9))


def fm_estimate(spark, d) -> DataFrame:
    out = sketches.fm_estimate(T.city_stream(spark, d), "ts", "city", "3 days", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "truth", "estimate")


def reservoir_sample(spark, d) -> DataFrame:
    return sketches.reservoir(T.tweets(spark, d), "event_id")


def trending_tags(spark, d) -> DataFrame:
    return sketches.trending(T.tweets(spark, d), "event_id", "text")


def stream_fm(spark, d) -> DataFrame:
    return jobs.run_fm(spark, d)


def stream_bloom(spark, d) -> DataFrame:
    return jobs.run_bloom(spark, d)


def stream_reservoir(spark, d) -> DataFrame:
    return jobs.run_reservoir(spark, d)


def stream_trending(spark, d) -> DataFrame:
    return jobs.run_trending(spark, d)


NAMES = "review_stats top10_users top10_items grouped_mean_topk partition_layout frequent_pairs frequent_triples frequent_large_baskets frequent_swapped frequent_fp_growth son_frequent son_candidates sorted_baskets minhash_signatures lsh_candidates lsh_similar_pairs user_pearson user_cf item_cf lsh_item_cf cf_rmse als_predictions overlap_graph label_propagation connected_components edge_betweenness modularity communities mahalanobis_assign bfr_rounds bfr_clusters bloom_fpr fm_estimate reservoir_sample trending_tags stream_fm stream_bloom stream_reservoir stream_trending".split()
QUERIES = {n: globals()[n] for n in NAMES}
