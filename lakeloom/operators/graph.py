"""Citation graph (degrees, PageRank) and co-author graph (edges, author metrics, density) over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.tables import checkpointed

MOST_NAMES = 500_000  # that are broadcast


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges (paper_id, referenced_paper_id) without nulls and self-citations."""
    return edges.where("paper_id <> referenced_paper_id").select("paper_id", "referenced_paper_id").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select("paper_id").union(edges.select("referenced_paper_id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """paper_id, out_degree, in_degree of every vertex; one pass over the edges' ends."""
    ends = edges.select(F.col("paper_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("referenced_paper_id", F.lit(0), F.lit(1)))
    return ends.groupBy("paper_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """paper_id, in_degree, pagerank after a fixed number of iterations; what dangling vertices hold is spread over all.

    Vertices that nothing cites all have the same rank, so only cited ones are followed from step to step: what a vertex
    gets of the uncited is one weight, summed once, and only edges between cited vertices are read in each step.  Degrees
    and weights are written once and ranks after each step, so that the plan of a step does not hold those before it.
    """
    nodes = checkpointed(degrees(edges))
    size = nodes.count()
    if not size:
        return nodes.select("paper_id", "in_degree", F.lit(0.0).alias("pagerank"))
    ends = nodes.where("out_degree > 0").select("paper_id", "out_degree", (F.col("in_degree") > 0).alias("cited"))
    sent = edges.join(ends, "paper_id").groupBy("referenced_paper_id", F.when(F.col("cited"), F.col("paper_id")).alias("source"))
    sent = checkpointed(sent.agg(F.sum(1.0 / F.col("out_degree")).alias("weight")))
    still = sent.where("source is null").select(F.col("referenced_paper_id").alias("paper_id"), F.col("weight").alias("still"))
    moving = sent.where("source is not null")
    ranks = checkpointed(nodes.where("in_degree > 0").join(still, "paper_id", "left").select("paper_id", "out_degree", "in_degree", F.coalesce("still", F.lit(0.0)).alias("still"), F.lit(1.0 / size).alias("pagerank")))
    uncited = 1.0 / size
    for _ in range(iterations):
        lost = ranks.where("out_degree = 0").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
        shares = moving.join(ranks.select(F.col("paper_id").alias("source"), "pagerank"), "source")
        gained = shares.groupBy(F.col("referenced_paper_id").alias("paper_id")).agg(F.sum(F.col("pagerank") * F.col("weight")).alias("gain"))
        base, gain = (1 - damping) / size + damping * lost / size, F.coalesce("gain", F.lit(0.0)) + F.lit(uncited) * F.col("still")
        ranks = checkpointed(ranks.join(gained, "paper_id", "left").select("paper_id", "out_degree", "in_degree", "still", (F.lit(base) + damping * gain).alias("pagerank")))
        uncited = base
    return ranks.select("paper_id", "in_degree", "pagerank").union(nodes.where("in_degree = 0").select("paper_id", "in_degree", F.lit(uncited)))


def induced(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """The distinct edges of the sampled papers (paper_id) that end in one of them; edges start there already."""
    return edges.join(sampled.select(F.col("paper_id").alias("referenced_paper_id")).distinct(), "referenced_paper_id", "left_semi").select("paper_id", "referenced_paper_id").distinct()


def sample_degrees(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """paper_id, out_degree_full, out_degree_in_sample, in_degree_in_sample and in_sample of every sampled or cited paper."""
    inside = induced(edges, sampled)
    one, none = F.lit(1), F.lit(0)
    rows = sampled.select("paper_id", none.alias("f"), none.alias("o"), none.alias("i"), one.alias("s")).distinct()
    for part in ((edges.select("paper_id", one, none, none, none)), edges.select("referenced_paper_id", none, none, none, none), inside.select("paper_id", none, one, none, none), inside.select("referenced_paper_id", none, none, one, none)):
        rows = rows.union(part)
    counts = rows.groupBy("paper_id").agg(F.sum("f").alias("out_degree_full"), F.sum("o").alias("out_degree_in_sample"), F.sum("i").alias("in_degree_in_sample"), F.max("s").alias("s"))
    return counts.withColumn("in_sample", F.col("s") == 1).drop("s")


def graph_summary(edges: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row: vertices, sampled papers, edges, edges in the sample, and external ones."""
    return sample_degrees(edges, sampled).agg(
        F.count("*").alias("vertices"), F.count_if("in_sample").alias("sampled"), F.sum("out_degree_full").alias("edges"), F.sum("out_degree_in_sample").alias("edges_in_sample"),
        (F.sum("out_degree_full") - F.sum("out_degree_in_sample")).alias("external_edges"),
    )


def unusual(ranked: DataFrame, top: int = 25) -> DataFrame:
    """The `top` vertices by PageRank for their in-degree, ties by id."""
    ratio = F.col("pagerank") / (F.col("in_degree") + 1)
    return ranked.withColumn("ratio", ratio).orderBy(F.desc(F.round("ratio", 12)), "paper_id").limit(top)


def coauthor_edges(authorships: DataFrame) -> DataFrame:
    """author_a < author_b, shared_count: papers that both signed."""
    rows = authorships.where("paper_id is not null and author_id is not null").select("paper_id", "author_id").distinct()
    left, right = rows.toDF("paper_id", "author_a"), rows.toDF("paper_id", "author_b")
    return left.join(right, "paper_id").where("author_a < author_b").groupBy("author_a", "author_b").agg(F.count("*").alias("shared_count"))


def collaborations(signed: DataFrame) -> DataFrame:
    """author_id_a < author_id_b, their names, shared_publication_count and shared_publication_ids (sorted); signed has
    paper_id, author_id, author_name.  A pair under two names is two rows, as their names are part of the key."""
    rows = signed.where("paper_id is not null and author_id is not null").select("paper_id", "author_id", "author_name").distinct()
    left, right = (rows.toDF("paper_id", f"author_id_{x}", f"author_name_{x}") for x in "ab")
    pairs = left.join(right, "paper_id").where("author_id_a < author_id_b")
    ids = F.array_sort(F.collect_set("paper_id"))
    return pairs.groupBy("author_id_a", "author_name_a", "author_id_b", "author_name_b").agg(F.countDistinct("paper_id").alias("shared_publication_count"), ids.alias("shared_publication_ids"))


def named_collaborations(authorships: DataFrame, names: DataFrame, n_names: int) -> DataFrame:
    """`collaborations` of authorships (paper_id, author_id) whose names (author_id, author_name) do not vary by paper.

    Only ids are shuffled with the pairs, once; the n_names names are joined to what the pairs come to, by broadcast up to
    MOST_NAMES of them."""
    rows = authorships.where("paper_id is not null and author_id is not null").select("paper_id", "author_id").distinct()
    left, right = (rows.toDF("paper_id", f"author_id_{x}") for x in "ab")
    pairs = left.join(right, "paper_id").where("author_id_a < author_id_b").repartition("author_id_a", "author_id_b")
    found = pairs.groupBy("author_id_a", "author_id_b").agg(F.array_sort(F.collect_list("paper_id")).alias("shared_publication_ids"))
    for x in "ab":
        known = names.select(F.col("author_id").alias(f"author_id_{x}"), F.col("author_name").alias(f"author_name_{x}")).distinct()
        found = found.join(F.broadcast(known) if n_names <= MOST_NAMES else known, f"author_id_{x}")
    return found.select("author_id_a", "author_name_a", "author_id_b", "author_name_b", F.size("shared_publication_ids").cast("bigint").alias("shared_publication_count"), "shared_publication_ids")


def author_metrics(signed: DataFrame, edges: DataFrame) -> DataFrame:
    """Publications, solo publications, average position, collaborators and weighted degree of each author, zeros without
    collaborators; signed has paper_id, author_id, author_position, edges author_a, author_b, shared_count."""
    rows = signed.where("paper_id is not null and author_id is not null")
    sizes = rows.select("paper_id", "author_id").distinct().groupBy("paper_id").agg(F.count("*").alias("n"))
    own = rows.join(sizes, "paper_id").groupBy("author_id", "paper_id", "n").agg(F.sum("author_position").alias("at"), F.count("*").alias("times"))
    own = own.groupBy("author_id").agg(F.count("*").alias("publications"), F.count_if(F.col("n") == 1).alias("solo"), (F.sum("at") / F.sum("times")).alias("avg_position"))
    both = edges.select(F.col("author_a").alias("author_id"), F.col("author_b").alias("other"), "shared_count").unionByName(edges.select(F.col("author_b").alias("author_id"), F.col("author_a").alias("other"), "shared_count"))
    links = both.groupBy("author_id").agg(F.count("*").alias("collaborators"), F.sum("shared_count").alias("weighted_degree"), F.max("shared_count").alias("strongest"))
    out = own.join(links, "author_id", "left").fillna(0, ["collaborators", "weighted_degree", "strongest"])
    return out.withColumn("collaborations_per_publication", F.col("weighted_degree") / F.col("publications"))


def density(authorships: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: authors, edges, and the share of possible edges; 0 for fewer than two authors."""
    n = authorships.agg(F.countDistinct("author_id").alias("authors"))
    rows = n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    return rows.withColumn("density", F.when(F.col("authors") > 1, F.col("edges") / (F.col("authors") * (F.col("authors") - 1) / 2)).otherwise(0.0))
