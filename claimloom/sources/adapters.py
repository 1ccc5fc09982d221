"""Sources: foreign files conformed to the claim tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_true
from ..operators.elt import first_delivered

# Names under which foreign files keep the columns.
SYNONYMS = {
    "paper_id": ["paper_id", "paperid", "paper", "work_id", "doc_id", "id"], "year": ["year", "publication_year", "pub_year", "yr"],
    "src_code": ["src_code", "source_code", "src", "source", "cause", "from", "u"], "dst_code": ["dst_code", "target_code", "dst", "target", "effect", "to", "v"],
    "src_label": ["src_label", "source_label", "cause_label"], "dst_label": ["dst_label", "target_label", "effect_label"],
    "relation_type": ["relation_type", "relation", "rel_type"], "evidence_type": ["evidence_type", "evidence", "method"], "is_causal": ["is_causal", "causal", "causal_flag"], "weight": ["weight", "w", "strength"], "stability": ["stability", "confidence", "robustness"],
    "title": ["title", "display_name", "name"], "authors": ["authors", "author"], "venue": ["venue", "journal", "source_display_name"], "code": ["code", "concept", "node", "concept_id"], "label": ["label", "preferred_label"],
}


def resolve(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Rename columns by the first matching synonym, whatever their case; a column serves once."""
    by_lower = {c.lower(): c for c in df.columns}
    taken, cols = set(), []
    for w in wanted:
        hit = next((by_lower[s] for s in SYNONYMS.get(w, [w]) if s in by_lower and by_lower[s] not in taken), None)
        if hit is not None:
            taken.add(hit)
            cols.append(F.col(f"`{hit}`").alias(w))
    return df.select(*cols)


def conform(df: DataFrame, defaults: dict[str, tuple[str, object]], required: list[str]) -> DataFrame:
    """Typed columns in order: missing ones and nulls get their default, unparseable values too; missing required columns raise."""
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    cols = []
    for name, (kind, default) in defaults.items():
        if name not in df.columns:
            cols.append(F.lit(default).cast(kind).alias(name))
        elif kind == "boolean":
            cols.append(is_true(F.col(name)).alias(name))
        else:
            cols.append(F.coalesce(F.col(name).try_cast(kind), F.lit(default).cast(kind)).alias(name))
    return df.select(*cols)


EDGE = {"paper_id": ("string", None), "year": ("int", 0), "src_code": ("string", None), "dst_code": ("string", None), "relation_type": ("string", "unspecified"), "evidence_type": ("string", "unspecified"), "is_causal": ("boolean", False), "weight": ("double", 1.0), "stability": ("double", None)}
PAPER = {"paper_id": ("string", None), "year": ("int", 0), "title": ("string", ""), "authors": ("string", ""), "venue": ("string", ""), "source": ("string", "")}
NODE = {"code": ("string", None), "label": ("string", None)}


def normalize_edges(df: DataFrame) -> DataFrame:
    """Claims with defaults; repeated claims stay."""
    return conform(df, EDGE, ["paper_id", "src_code", "dst_code"]).where("src_code is not null and dst_code is not null")


def normalize_papers(df: DataFrame) -> DataFrame:
    return first_delivered(conform(df, PAPER, ["paper_id"]).where("paper_id is not null"), ["paper_id"], ["year"])


def normalize_nodes(df: DataFrame) -> DataFrame:
    n = conform(df, NODE, ["code"]).where("code is not null")
    return first_delivered(n, ["code"], ["label"]).withColumn("label", F.coalesce("label", "code"))


def modal_labels(edges: DataFrame) -> DataFrame:
    """Most frequent label per code over both ends; ties by label, codes without label by their code."""
    both = edges.select(F.col("src_code").alias("code"), F.col("src_label").alias("label")).unionByName(edges.select(F.col("dst_code").alias("code"), F.col("dst_label").alias("label")))
    n = both.groupBy("code", "label").agg(F.count("label").alias("n"))
    return n.groupBy("code").agg(F.min(F.struct((-F.col("n")).alias("a"), "label")).alias("m")).select("code", F.coalesce("m.label", "code").alias("label"))


def papers_of(edges: DataFrame) -> DataFrame:
    return normalize_papers(edges.select("paper_id", "year").withColumn("source", F.lit("generic")))


@dataclass
class Bundle:
    nodes: DataFrame
    papers: DataFrame
    edges: DataFrame

    def corpus(self) -> DataFrame:
        """The denormalised fact table of fifteen columns: the claim's own year if it has one, else the paper's; labels default to codes."""
        p = self.papers.select("paper_id", F.col("year").alias("paper_year"), "title", "authors", "venue", "source")
        name = lambda c: self.nodes.select(F.col("code").alias(f"{c}_code"), F.col("label").alias(f"{c}_label"))
        j = self.edges.join(p, "paper_id", "left").join(name("src"), "src_code", "left").join(name("dst"), "dst_code", "left")
        year = F.when(F.col("year") > 0, F.col("year")).otherwise(F.coalesce("paper_year", F.lit(0)))
        text = lambda c: F.coalesce(c, F.lit("")).alias(c)
        return j.select("paper_id", year.alias("year"), text("title"), text("authors"), text("venue"), text("source"), "src_code", "dst_code", F.coalesce("src_label", "src_code").alias("src_label"), F.coalesce("dst_label", "dst_code").alias("dst_label"), "relation_type", "evidence_type", "is_causal", "weight", "stability")


class Adapter(ABC):
    """Anything that loads a bundle."""

    @abstractmethod
    def load(self, spark: SparkSession) -> Bundle: ...


class CsvDirectory(Adapter):
    """edges.csv, and papers.csv and nodes.csv where they exist; what is missing is derived from the edges."""

    def __init__(self, path: str, encoding: str = "UTF-8"):
        self.path, self.encoding = path, encoding

    def _read(self, spark, name):
        from pyspark.errors import AnalysisException

        try:
            return spark.read.option("header", True).option("encoding", self.encoding).csv(f"{self.path}/{name}.csv")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # a file that is there but cannot be read is no absent file
                raise
            return None

    def load(self, spark: SparkSession) -> Bundle:
        raw = self._read(spark, "edges")
        if raw is None:
            raise ValueError(f"no edges.csv in {self.path}")
        return _bundle(raw, self._read(spark, "papers"), self._read(spark, "nodes"))


class SingleFile(Adapter):
    """One .csv, .jsonl, .json or .parquet file of claims."""

    def __init__(self, path: str):
        self.path = path

    def load(self, spark: SparkSession) -> Bundle:
        kind = self.path.rsplit(".", 1)[-1].lower()
        if kind == "csv":
            raw = spark.read.option("header", True).csv(self.path)
        elif kind in ("jsonl", "json"):
            raw = spark.read.json(self.path)
        elif kind == "parquet":
            raw = spark.read.parquet(self.path)
        else:
            raise ValueError(f"unknown kind of file: {self.path}")
        return _bundle(raw, None, None)


class ParquetDiscovery(Adapter):
    """The parquet tables of a folder that look like claims, papers and nodes; of several, the one with most rows (footers only)."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def load(self, spark: SparkSession) -> Bundle:
        best: dict[str, tuple[int, DataFrame]] = {}
        for p in self.paths:
            df = spark.read.parquet(p)
            cols = set(resolve(df, ["paper_id", "src_code", "dst_code", "title", "code", "label"]).columns)
            role = "edges" if {"src_code", "dst_code"} <= cols else "papers" if {"paper_id", "title"} <= cols else "nodes" if {"code", "label"} <= cols else None
            if role and (n := df.count()) > best.get(role, (-1, None))[0]:
                best[role] = (n, df)
        if "edges" not in best:
            raise ValueError("no table of claims found")
        return _bundle(*[best.get(r, (0, None))[1] for r in ("edges", "papers", "nodes")])


def _bundle(raw: DataFrame, papers: DataFrame | None, nodes: DataFrame | None) -> Bundle:
    e = resolve(raw, [*EDGE, "src_label", "dst_label"])
    for c in ("src_label", "dst_label"):
        if c not in e.columns:
            e = e.withColumn(c, F.lit(None).cast("string"))
    if "paper_id" not in e.columns:  # a claim without paper is a paper of its own, named by its content
        e = e.withColumn("paper_id", F.concat(F.lit("P"), F.sha2(F.to_json(F.struct(*e.columns)), 256).substr(1, 16)))
    edges = normalize_edges(e)
    return Bundle(normalize_nodes(resolve(nodes, list(NODE))) if nodes is not None else modal_labels(e), normalize_papers(resolve(papers, list(PAPER))) if papers is not None else papers_of(edges), edges)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Lines of JSON, plain or gzip; blank lines are skipped."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path)


PAYLOAD = "nodes array<struct<node_id:string,label:string,surface_forms:array<string>,study_context:struct<unit_of_analysis:array<string>,start_year:array<int>,end_year:array<int>,countries:array<string>,context_note:string>>>, edges array<struct<edge_id:string,source_node_id:string,target_node_id:string,directionality:string,relationship_type:string,causal_presentation:string,edge_role:string,claim_status:string,explicitness:string,claim_text:string,evidence_text:string,sign:string,statistical_significance:string,evidence_method:string,uses_data:boolean,tentativeness:string>>"


def flatten_payload(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extraction responses (custom_id, payload): typed, flat, one row per local id, unparseable payloads without rows."""
    p = responses.select("custom_id", F.from_json("payload", PAYLOAD).alias("p"))
    n = p.select("custom_id", F.posexplode("p.nodes").alias("seq", "n")).where("n.node_id is not null")
    n = n.select("custom_id", "seq", "n.node_id", F.coalesce("n.label", F.lit("NA")).alias("label"), F.to_json("n.surface_forms").alias("surface_forms_json"), *[F.to_json(f"n.study_context.{c}").alias(f"{c}_json") for c in ("unit_of_analysis", "start_year", "end_year", "countries")], F.coalesce("n.study_context.context_note", F.lit("NA")).alias("context_note"))
    e = p.select("custom_id", F.posexplode("p.edges").alias("seq", "e")).where("e.edge_id is not null").select("custom_id", "seq", "e.*")
    return first_delivered(n, ["custom_id", "node_id"], ["seq"]).drop("seq"), first_delivered(e, ["custom_id", "edge_id"], ["seq"]).drop("seq")
