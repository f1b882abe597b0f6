"""The whole way of a batch of incidents: queue, evidence, prompt, fallback, digest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SIMILARITY_THRESHOLD, TOP_K
from ..operators.classify import score_queues
from ..operators.grounding import build_prompts, fallback_resolution, grounding_ids
from ..operators.retrieval import embed_corpus, hits_with_metadata, similar_topk
from ..operators.summarize import extractive_summaries
from ..session import materialize


@dataclass
class JourneyModels:
    """The fitted models an incident passes through."""

    classifier: PipelineModel
    encoder: PipelineModel


def incident_journey(incidents: DataFrame, kb: DataFrame, sops: DataFrame, models: JourneyModels,
                     k: int = TOP_K, threshold: float = SIMILARITY_THRESHOLD,
                     use_retrieval: bool = True, variant: str = "finetuned") -> DataFrame:
    """One row per incident (query_id, incident, style).

    ``kb`` is a vector table with ticket fields and a ``vec_id``, embedded with
    ``models.encoder``.  It is read twice, for its packed vectors and for the fields
    of the tickets found, so it need not be stored: either reading leaves out what
    only the other one needs.  Hits are written once to the shared folder because
    prompt, fallback and evidence list all read them.
    """
    scored = score_queues(incidents, models.classifier, "query_id", "incident", variant)
    routed = incidents.join(scored.select(
        "query_id", F.col("label").alias("category"), "confidence", "variant", "error"), "query_id")
    embedded = embed_corpus(incidents.select("query_id", "incident"), "incident", model=models.encoder)
    found = similar_topk(embedded, kb, k, threshold)
    hits = materialize(hits_with_metadata(found if use_retrieval else found.limit(0), kb), "journey-hits")
    routed = materialize(routed, "journey-routed")
    prompts = build_prompts(routed, hits, sops).select(
        "query_id", "prompt_version", F.col("messages")[1]["content"].alias("prompt"))
    answers = fallback_resolution(routed, hits)
    digests = extractive_summaries(answers, "query_id", "resolution")
    return (routed.join(prompts, "query_id").join(answers, "query_id").join(digests, "query_id")
            .join(grounding_ids(routed, hits), "query_id")
            .select("query_id", "category", "confidence", "variant", "error", "prompt_version",
                    "prompt", "resolution", "summary",
                    F.array_join("grounded_on", ",").alias("grounded_on"), "sop"))
