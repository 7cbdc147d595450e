"""The queries of this subpackage: every one over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.llm import clusters, distinct, encode, packing, pieces, subjects, terms, topn, varied
from facetry.llm.sql import SQL
from facetry.sources.tables import one_row, stored, table


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_table(table(spark, d, "wikitext"), table(spark, d, "vocab"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark is not null").select("term", "mark")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    texts = pieces.corpora(table(spark, d, "wikitext"), table(spark, d, "bills"))
    return pieces.split_texts(texts, ["corpus", "doc_id"], "text")


def p2_cores(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from the cores of their pieces, as a digest."""
    core = F.substr("piece_text", (F.col("core_start") - F.col("start") + 1).cast("int"))
    rows = p2_pieces(spark, d).select("corpus", "doc_id", F.struct("piece", core.alias("core")).alias("part"), F.length("piece_text").alias("n"))
    whole = rows.groupBy("corpus", "doc_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("n").alias("n"))
    text = F.array_join(F.transform("parts", lambda p: p["core"]), "")
    return whole.select("corpus", "doc_id", F.md5(text).alias("digest"), (F.col("n") > pieces.LIMIT).alias("too_long"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = pieces.corpora(table(spark, d, "wikitext"), table(spark, d, "bills"), over=pieces.LIMIT)
    found = pieces.split_texts(texts, ["corpus", "doc_id"], "text", with_text=False)
    return found.where("piece = 0 and record_cut is not null").select("corpus", "doc_id", F.col("record_cut").alias("cut"))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p2_pieces: every text with a character has pieces, none is too long, none shares too much with the one before or leaves a gap."""
    rows = p2_pieces(spark, d).select("corpus", "doc_id", "piece", "start", F.length("piece_text").alias("n"))
    before = Window.partitionBy("corpus", "doc_id").orderBy("piece")
    shared = F.lag(F.col("start") + F.col("n")).over(before) - F.col("start")
    rows = rows.withColumn("shared", F.coalesce(shared, F.lit(0)))
    wrong = (F.col("n") > pieces.LIMIT) | (F.col("shared") > pieces.OVERLAP) | (F.col("shared") < 0)
    return rows.groupBy("corpus").agg(F.count_distinct("doc_id").alias("texts"), F.count_if(wrong).alias("wrong"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = varied.same_groups(varied.theta_rows(table(spark, d, "theta")))
    return groups.select(F.col("root").alias("group_doc_id"), F.col("node").alias("doc_id"))


def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied.one_of_each(table(spark, d, "theta"), table(spark, d, "topic2doc_dist"), 300)


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p4_subset: as many records as asked for, all active features and topics, no two of a group."""
    picks = p4_subset(spark, d).select("doc_id").join(p4_found(spark, d), "doc_id", "left")
    weights = [rows.select("kind", "doc_id", "feature") for rows in (
        topn.doc_scores(table(spark, d, "theta")).select("kind", F.col("group_id").alias("doc_id"), F.col("item_id").alias("feature")),
        topn.topic_scores(table(spark, d, "topic2doc_dist")).where("score > 0 and not isnan(score)").select("kind", F.col("item_id").alias("doc_id"), F.col("group_id").alias("feature")),
    )]
    active = weights[0].unionByName(weights[1]).join(picks.select("doc_id"), "doc_id").agg(F.count_distinct("kind", "feature").alias("features"))
    doubles = F.count(F.lit(1)) - F.count_distinct(F.coalesce("group_doc_id", "doc_id"))
    return picks.agg(F.count(F.lit(1)).alias("records"), doubles.alias("doubles")).transform(one_row, active)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows, leaves, counts = clusters.prepared(table(spark, d, "wikitext"), table(spark, d, "doc2topic_dist"))
    return clusters.alike_groups(rows, leaves, counts).select(F.col("root").alias("cluster_doc_id"), F.col("node").alias("doc_id"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical(clusters.prepared(table(spark, d, "wikitext"), table(spark, d, "doc2topic_dist"))[1])


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p5_clusters: its sizes sum to the records, no cluster is wider than the limit, there are several."""
    each = p5_clusters(spark, d).where("place = 1")
    wide = F.count_if(F.col("spread") > clusters.RADIUS)
    return each.agg(F.sum("size").alias("records"), wide.alias("wide"), (F.count(F.lit(1)) > 1).alias("several"))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms with score; the model's probability to 4 places."""
    found = distinct.distinctive(table(spark, d, "wikitext"), table(spark, d, "topic2word_dist"), table(spark, d, "vocab"))
    return found.withColumn("probability", F.round("probability", 4))


def p6_mass(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the probabilities: those of every owner sum to 1."""
    found = distinct.distinctive(table(spark, d, "wikitext"), table(spark, d, "topic2word_dist"), table(spark, d, "vocab"))
    each = found.groupBy("owner", "owner_id").agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("p"))
    whole = F.count_if(F.abs(F.col("p") - 1) < 1e-6)
    return each.groupBy("owner").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("terms"), whole.alias("whole"))


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of all terms, which SQL can express."""
    found = distinct.distinctive(table(spark, d, "wikitext"), table(spark, d, "topic2word_dist"), table(spark, d, "vocab"))
    return found.select("owner", "owner_id", "term", "score")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = distinct.distinctive(table(spark, d, "wikitext"), table(spark, d, "topic2word_dist"), table(spark, d, "vocab"), best=True)
    return found.select("owner", "owner_id", "term")


def _strongest(spark: SparkSession, d: str) -> DataFrame:
    return topn.strongest(table(spark, d, "topic2doc_dist"), table(spark, d, "theta"))


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _strongest(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _strongest(spark, d).select("kind", "group_id", "item_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return encode.round_trip(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(encode.token_counts(table(spark, d, "documents")))


def p9_places(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_packed(spark, d))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p9_places: all documents are there, no container is too full, no place is used twice, no small document is split."""
    rows = stored(_packed(spark, d))
    full = packing.containers(rows).agg(F.count_if(F.col("filled") > packing.CAPACITY).alias("overfull"))
    order = Window.partitionBy("container_id").orderBy("offset")
    inside = rows.where("container_id is not null").withColumn("end", F.lag(F.col("offset") + F.col("size")).over(order))
    clash = inside.agg(F.count_if(F.col("end") > F.col("offset")).alias("clashes"))
    each = rows.groupBy("doc_id").agg(F.sum("size").alias("n"), F.max("n_pieces").alias("pieces"))
    split = each.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("split"))
    return one_row(split, full, clash)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1 and piece = 0").select("doc_id")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, d, n) for n in ("documents", "subject_labels", "wikitext", "bills", "subject_areas")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents").count())


def p10_totals(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p10_found and p10_composition: the subjects are those of the list, and the shares follow from the rows."""
    found = stored(_subjects(spark, d))
    shares = subjects.composition(found, n := table(spark, d, "documents").count())
    listed = table(spark, d, "subject_areas").select(F.lower(F.trim("subject")).alias("subject"))
    total = shares.agg(F.sum("documents").alias("a"), F.round(F.sum(F.col("share")) * n).alias("b"))
    rows = found.agg(F.count(F.lit(1)).alias("r"), F.count_distinct("doc_id", "subject").alias("pairs"))
    other = found.join(listed, "subject", "left_anti").agg(F.count(F.lit(1)).alias("unlisted"))
    agree = (F.col("a") == F.col("r")) & (F.abs(F.col("b") - F.col("r")) <= 1) & (F.col("pairs") == F.col("r"))
    return one_row(total, rows, other).select("unlisted", agree.alias("agree"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
