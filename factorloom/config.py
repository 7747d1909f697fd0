"""Settings of a run. Every key that starts with batch, model or output is read; unknown ones are kept in ``extra``."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

FORWARDED = ("batch", "model", "output")


@dataclass
class Settings:
    features: int = 50
    alpha: float = 1.0
    lam: float = 0.1
    reconstruct_r: bool = False
    loss_ignores_unspecified: bool = False
    iterate: bool = True
    convergence_threshold: float = 0.001
    max_iterations: int = 30
    convergence_modulus: int = 257
    decay_factor: float = 1.0
    zero_threshold: float = 0.0
    user_clusters: int = 100
    item_clusters: int = 100
    generations_to_keep: int = 10
    merge_instance: str | None = None
    writes_between_upload: int = 10_000
    remove_not_updated: bool = True
    recs_count: int = 10
    similar_count: int = 10
    recs_format: str = "brackets"
    similar_format: str = "brackets"
    bad_line_budget: int = 100
    debug: bool = False
    input_path: str | None = None
    input_format: str | None = None
    recs_sink_format: str | None = None
    recs_sink_path: str | None = None
    similar_sink_format: str | None = None
    similar_sink_path: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.features < 1 or self.recs_count < 1 or self.similar_count < 1:
            raise ValueError("features and output counts must be positive")
        if not 0 < self.convergence_threshold < 1:
            raise ValueError("the convergence threshold lies between 0 and 1")
        if self.zero_threshold < 0 or self.generations_to_keep < 2:
            raise ValueError("the zero threshold is at least 0, and 2 generations are kept at least")
        for kind in ("recs", "similar"):
            if bool(getattr(self, f"{kind}_sink_format")) != bool(getattr(self, f"{kind}_sink_path")):
                raise ValueError(f"the format and the path of the {kind} sink are set together")
        if bool(self.input_path) != bool(self.input_format) and self.input_format:
            raise ValueError("a custom input format needs a path")

    @property
    def effective_lambda(self) -> float:
        return self.alpha * self.lam


# Names of the configuration keys.
KEYS = {
    "model.features": "features",
    "model.als.alpha": "alpha",
    "model.als.lambda": "lam",
    "model.reconstructRMatrix": "reconstruct_r",
    "model.lossIgnoresUnspecified": "loss_ignores_unspecified",
    "model.als.iterate": "iterate",
    "model.als.iterations.convergenceThreshold": "convergence_threshold",
    "model.iterations.max": "max_iterations",
    "model.decay.factor": "decay_factor",
    "model.decay.zeroThreshold": "zero_threshold",
    "model.cluster.user.k": "user_clusters",
    "model.cluster.item.k": "item_clusters",
    "model.generations.maxToKeep": "generations_to_keep",
    "model.merge.instanceID": "merge_instance",
    "model.distributed.writesBetweenUpload": "writes_between_upload",
    "model.removeNotUpdatedData": "remove_not_updated",
    "output.recs.count": "recs_count",
    "output.recs.format": "recs_format",
    "output.similar.count": "similar_count",
    "output.similar.format": "similar_format",
    "batch.input.customPath": "input_path",
    "batch.input.customFormatClass": "input_format",
    "batch.output.recommend.customFormat": "recs_sink_format",
    "batch.output.recommend.customPath": "recs_sink_path",
    "batch.output.similar.customFormat": "similar_sink_format",
    "batch.output.similar.customPath": "similar_sink_path",
    "batch.debug": "debug",
}


def _typed(value: Any, kind: str) -> Any:
    if not isinstance(value, str):
        return value
    if kind.startswith("bool"):
        return value.strip().lower() == "true"
    if kind.startswith("int"):
        return int(value)
    return float(value) if kind.startswith("float") else value


def from_properties(properties: dict[str, Any]) -> Settings:
    """Settings of the forwarded properties; other prefixes are ignored."""
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    known, extra = {}, {}
    for key, value in properties.items():
        if key in KEYS:
            known[KEYS[key]] = _typed(value, kinds[KEYS[key]])
        elif key.startswith(FORWARDED):
            extra[key] = str(value)
    return Settings(**known, extra=extra)
