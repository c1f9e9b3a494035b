"""The property graph as two tables, and its queries.

Nodes are unique by label and key (the last row wins), edges by what they join.  Queries aggregate each
kind of edge before joining.  What several requirements share comes as memberships with a count; pairs
within a shared group are formed only around one chosen requirement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.matrix import latest
from traceloom.operators.store import publish, read_published

LABELS = {"REQUIREMENT": "Requirement", "IMPLEMENTATION": "Implementation", "EVALUATION": "Evaluation"}
PLACEHOLDERS = ("", "(none)", "(unlinked)", "(unknown)")
EDGE = ["rel_type", "src", "dst", "correlation_id"]


def is_chunk_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def source_type_of(name: Column) -> Column:
    """By ending; names with git or commit are GIT, with whatsapp or chat WHATSAPP, the latter above all."""
    low = F.lower(name)
    table = {"pdf": "PDF", "docx": "DOCX", "doc": "DOCX", "py": "PYTHON", "md": "MARKDOWN", "txt": "TEXT", "eml": "EMAIL", "msg": "EMAIL"}
    end = F.regexp_extract(low, r"\.([^.]*)$", 1)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), end)
    return F.when(low.rlike("whatsapp|chat"), "WHATSAPP").when(low.rlike("git|commit"), "GIT").otherwise(F.coalesce(known, F.lit("UNKNOWN")))


def nodes(evidence: DataFrame) -> DataFrame:
    """label, key, text, linked_requirement, source_document, chunk_id, source_type: the last row of each entity; and the documents with their type."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("entity_type"))
    row = F.struct("seq", "text", "linked_requirement", "source_document", "chunk_id")
    entities = evidence.filter("entity_id is not null").groupBy(label.alias("label"), F.col("entity_id").alias("key")).agg(F.max(row).alias("_r")).filter("label is not null")
    documents = evidence.filter("source_document is not null").select("source_document").distinct()
    empty = [F.lit(None).cast("string").alias(c) for c in ("text", "linked_requirement", "source_document", "chunk_id")]
    name = F.col("source_document")
    return entities.select("label", "key", "_r.text", "_r.linked_requirement", "_r.source_document", "_r.chunk_id", F.lit(None).cast("string").alias("source_type")).unionByName(
        documents.select(F.lit("SourceDocument").alias("label"), name.alias("key"), *empty, source_type_of(name).alias("source_type"))
    )


def extracted_from(evidence: DataFrame) -> DataFrame:
    rows = evidence.filter("entity_id is not null and source_document is not null")
    return rows.select(F.lit("EXTRACTED_FROM").alias("rel_type"), F.col("entity_id").alias("src"), F.col("source_document").alias("dst"), F.lit(None).cast("string").alias("correlation_id")).distinct()


def links(evidence: DataFrame, entity_type: str, rel_type: str) -> DataFrame:
    """Entities of a type to the requirements they name, where those exist."""
    known = evidence.filter(F.col("entity_type") == "REQUIREMENT").select(F.col("entity_id").alias("dst")).distinct()
    rows = evidence.filter((F.col("entity_type") == entity_type) & F.col("linked_requirement").isNotNull())
    return rows.select(F.lit(rel_type).alias("rel_type"), F.col("entity_id").alias("src"), F.col("linked_requirement").alias("dst"), F.lit(None).cast("string").alias("correlation_id")).distinct().join(known, "dst", "left_semi").select(*EDGE)


def _resolved(evidence: DataFrame, correlation: DataFrame) -> DataFrame:
    """correlation_id, src, dst of the latest correlations that name evidence; dst is NULL for a chunk that no entity was extracted from.

    A chunk id stands for the entity extracted from it last (evaluations before implementations before requirements)."""
    rank = F.when(F.col("entity_type") == "EVALUATION", 3).when(F.col("entity_type") == "IMPLEMENTATION", 2).otherwise(1)
    owner = evidence.filter("chunk_id is not null").groupBy(F.col("chunk_id").alias("_chunk")).agg(F.max(F.struct(rank.alias("r"), "seq", "entity_id"))["entity_id"].alias("_owner"))
    rows = latest(correlation).select("correlation_id", F.col("requirement_entity_id").alias("src"), "evidence_entity_id").dropDuplicates(["correlation_id"])
    rows = rows.filter(~F.col("evidence_entity_id").isin(*PLACEHOLDERS) & ~F.col("src").isin(*PLACEHOLDERS))
    found = rows.join(owner, F.when(is_chunk_id(F.col("evidence_entity_id")), F.col("evidence_entity_id")) == F.col("_chunk"), "left")
    return found.select("correlation_id", "src", F.when(is_chunk_id(F.col("evidence_entity_id")), F.col("_owner")).otherwise(F.col("evidence_entity_id")).alias("dst"))


def correlates_to(evidence: DataFrame, correlation: DataFrame) -> DataFrame:
    """Requirement to evidence, by each requirement's latest correlations, where both ends exist."""
    keys = evidence.filter("entity_id is not null").select("entity_id").distinct()
    reqs = evidence.filter(F.col("entity_type") == "REQUIREMENT").select(F.col("entity_id").alias("src")).distinct()
    found = _resolved(evidence, correlation)
    there = found.join(keys.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").join(reqs, "src", "left_semi")
    return there.select(F.lit("CORRELATES_TO").alias("rel_type"), "src", "dst", "correlation_id")


def edges(evidence: DataFrame, correlation: DataFrame) -> DataFrame:
    parts = [links(evidence, "IMPLEMENTATION", "EXPLICITLY_LINKS"), links(evidence, "EVALUATION", "EVALUATES"), correlates_to(evidence, correlation)]
    out = extracted_from(evidence)
    for p in parts:
        out = out.unionByName(p)
    return out


def overview(node: DataFrame, edge: DataFrame, correlation: DataFrame) -> DataFrame:
    """Per requirement: distinct evidence, distinct evaluations, status and confidence of the most confident correlation."""
    req = node.filter("label = 'Requirement'").select(F.col("key").alias("requirement_id"))
    to = edge.filter("rel_type = 'CORRELATES_TO'")
    n_ev = to.select("src", "dst").distinct().groupBy(F.col("src").alias("requirement_id")).agg(F.count(F.lit(1)).alias("n_evidence"))
    n_eval = edge.filter("rel_type = 'EVALUATES'").select("src", "dst").distinct().groupBy(F.col("dst").alias("requirement_id")).agg(F.count(F.lit(1)).alias("n_evaluations"))
    about = correlation.select("correlation_id", "status", "confidence").dropDuplicates(["correlation_id"])
    top = to.join(about, "correlation_id").groupBy(F.col("src").alias("requirement_id")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "correlation_id", "status", "confidence")).alias("_t"))
    out = req.join(n_ev, "requirement_id", "left").join(n_eval, "requirement_id", "left").join(top, "requirement_id", "left")
    return out.select("requirement_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_evaluations", F.lit(0)).alias("n_evaluations"), F.col("_t.status").alias("status"), F.col("_t.confidence").alias("confidence"))


def ego_network(edge: DataFrame, requirement: str) -> DataFrame:
    """Edges at a requirement, and the documents of what they join: hop, rel_type, src, dst."""
    first = edge.filter(((F.col("src") == requirement) | (F.col("dst") == requirement))).select(F.lit(1).alias("hop"), "rel_type", "src", "dst").distinct()
    near = first.select(F.when(F.col("src") == requirement, F.col("dst")).otherwise(F.col("src")).alias("src")).distinct()
    second = edge.filter("rel_type = 'EXTRACTED_FROM'").filter(F.col("src") != requirement).join(near, "src", "left_semi").select(F.lit(2).alias("hop"), "rel_type", "src", "dst").distinct()
    return first.unionByName(second)


def shared_artifacts(edge: DataFrame) -> DataFrame:
    """Artifacts that at least two requirements correlate to: artifact, requirement_id, n_requirements (a row per member, no pairs)."""
    members = edge.filter("rel_type = 'CORRELATES_TO'").select(F.col("dst").alias("artifact"), F.col("src").alias("requirement_id")).distinct()
    sizes = members.groupBy("artifact").agg(F.count(F.lit(1)).alias("n_requirements")).filter("n_requirements > 1")
    return members.join(sizes, "artifact")


def shared_with(edge: DataFrame, requirement: str) -> DataFrame:
    """The requirements that share an artifact with one requirement: artifact, other_id."""
    members = edge.filter("rel_type = 'CORRELATES_TO'").select(F.col("dst").alias("artifact"), F.col("src").alias("other_id")).distinct()
    own = members.filter(F.col("other_id") == requirement).select("artifact")
    return members.filter(F.col("other_id") != requirement).join(own, "artifact", "left_semi")


def orphans(node: DataFrame, edge: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Entities without any edge, or without any but the ignored kinds."""
    used = edge.filter(~F.col("rel_type").isin(*ignore)) if ignore else edge
    ends = used.select(F.col("src").alias("key")).unionByName(used.select(F.col("dst").alias("key"))).distinct()
    return node.filter("label <> 'SourceDocument'").select("label", "key").join(ends, "key", "left_anti")


def document_members(edge: DataFrame) -> DataFrame:
    """source_document, entity, requirement_id: each entity of a document with each requirement it links to (NULL: none)."""
    of = edge.filter("rel_type = 'EXTRACTED_FROM'").select(F.col("src").alias("entity"), F.col("dst").alias("source_document"))
    to = edge.filter(F.col("rel_type").isin("EXPLICITLY_LINKS", "EVALUATES")).select(F.col("src").alias("entity"), F.col("dst").alias("requirement_id")).distinct()
    return of.join(to, "entity", "left").select("source_document", "entity", "requirement_id")


def document_coverage(edge: DataFrame) -> DataFrame:
    """Per document how many entities and distinct linked requirements ``document_members`` has."""
    return document_members(edge).groupBy("source_document").agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("requirement_id").alias("n_requirements"))


def full_graph(node: DataFrame, edge: DataFrame, documents: bool = True) -> tuple[DataFrame, DataFrame]:
    return (node, edge) if documents else (node.filter("label <> 'SourceDocument'"), edge.filter("rel_type <> 'EXTRACTED_FROM'"))


def statistics(node: DataFrame, edge: DataFrame) -> DataFrame:
    n = node.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edge.groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def visible(node: DataFrame, edge: DataFrame, labels: list[str]) -> DataFrame:
    """Edges whose two ends both carry a visible label."""
    shown = node.filter(F.col("label").isin(*labels)).select("key").distinct()
    return edge.join(shown.withColumnRenamed("key", "src"), "src", "left_semi").join(shown.withColumnRenamed("key", "dst"), "dst", "left_semi").select(*EDGE)


def build_statistics(evidence: DataFrame, correlation: DataFrame, node: DataFrame, edge: DataFrame) -> DataFrame:
    """``statistics`` with what the build passed over: placeholders, and chunks without an entity."""
    rows = latest(correlation).select("correlation_id", F.col("requirement_entity_id").alias("src"), "evidence_entity_id").dropDuplicates(["correlation_id"])
    gone = F.coalesce(F.col("evidence_entity_id").isin(*PLACEHOLDERS) | F.col("src").isin(*PLACEHOLDERS), F.lit(True))
    skipped = rows.filter(gone).agg(F.lit("skipped").alias("kind"), F.lit("placeholder").alias("name"), F.count(F.lit(1)).alias("n"))
    unresolved = _resolved(evidence, correlation).filter("dst is null").agg(F.lit("skipped").alias("kind"), F.lit("chunk without entity").alias("name"), F.count(F.lit(1)).alias("n"))
    return statistics(node, edge).unionByName(skipped).unionByName(unresolved)


def sync(evidence: DataFrame, correlation: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Rebuilds the stored graph whole and returns it as stored; a reader sees the old or the new graph, and building again changes nothing."""
    spark = evidence.sparkSession
    publish({"nodes": nodes(evidence), "edges": edges(evidence, correlation)}, path)
    return read_published(spark, path, "nodes"), read_published(spark, path, "edges")


def layout(node: DataFrame, edge: DataFrame, correlation: DataFrame, requirement: str) -> DataFrame:
    """What a drawing of ``ego_network`` needs: each edge with the labels of its ends, its status and its width (four times the confidence, 1 at least)."""
    ego = ego_network(edge, requirement)
    about = correlation.select("correlation_id", "status", "confidence").dropDuplicates(["correlation_id"])
    rank = F.when(F.col("label") == "Requirement", 0).when(F.col("label") == "Implementation", 1).when(F.col("label") == "Evaluation", 2).otherwise(3)
    labels = node.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "label"))["label"].alias("label"))
    named = edge.filter(F.col("rel_type") == "CORRELATES_TO").filter(F.col("src") == requirement).join(about, "correlation_id").groupBy("rel_type", "src", "dst").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "correlation_id", "status", "confidence")).alias("_b"))
    out = ego.join(named, ["rel_type", "src", "dst"], "left")
    for end in ("src", "dst"):
        out = out.join(labels.select(F.col("key").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    return out.select("hop", "rel_type", "src", "src_label", "dst", "dst_label", F.col("_b.status").alias("status"), F.greatest(F.lit(1.0), 4 * F.coalesce("_b.confidence", F.lit(0.0))).alias("width"))
