"""Workflow configuration: one JSON document with the keys that existing configurations use."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

#: Stages in order; a run can stop after any of them.
STAGES = ("SPLIT", "FILTER", "NEIGHBOURS", "COMPONENTS", "CONTRACTION", "ANALYSIS", "MERGE")


@dataclass
class WorkflowConfig:
    unary_filters: list[dict] = field(default_factory=list)
    binary_filters: list[dict] = field(default_factory=list)
    max_distance_meters: float = 500.0
    max_neighbours: int = 5
    neighbouring_predicates: list[dict] = field(default_factory=list)
    contraction_predicates: list[dict] = field(default_factory=list)
    centrality_measures: list[str] = field(default_factory=list)
    visualize_edges: bool = False
    splits: int = 0
    last_job_type: str = "MERGE"
    neighbouring_files_predicate: str = "TILES"
    crs: str = "geographic"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.last_job_type not in STAGES:
            raise ValueError(f"unknown stage {self.last_job_type!r}")

    def reaches(self, stage: str) -> bool:
        return STAGES.index(stage) <= STAGES.index(self.last_job_type)

    @classmethod
    def from_json(cls, text: str) -> WorkflowConfig:
        """Keys as in the documents (kebab case and maxDistanceMeters, maxNeighbours); unknown keys are kept in extra."""
        known = {f.name for f in fields(cls)} - {"extra"}
        out: dict = {"extra": {}}
        for key, value in json.loads(text).items():
            name = "".join("_" + c.lower() if c.isupper() else c for c in key).replace("-", "_")
            if name == "centrality_measures":
                value = [v["name"] if isinstance(v, dict) else v for v in value]
            (out if name in known else out["extra"])[name] = value
        return cls(**out)


#: Fixed values of a preset: areas from 5,000 square metres on that are inside no other, links and merges up to 200 m, five neighbours.
URBAN_CLUSTERS = """{
  "unary-filters": [{"name": "ApproxAreaFilter", "requiredArea": 5000}],
  "binary-filters": [{"name": "InsidePolygonFilter"}],
  "maxDistanceMeters": 200, "maxNeighbours": 5,
  "neighbouring-predicates": [{"name": "DistanceBiPredicate", "distance": 200}],
  "contraction-predicates": [{"name": "DistanceBiPredicate", "distance": 200}],
  "last-job-type": "MERGE"
}"""


def urban_clusters() -> WorkflowConfig:
    return WorkflowConfig.from_json(URBAN_CLUSTERS)
