"""Configuration as plain dataclasses, with the checks that guard results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    history_hours: int = 24
    push_times: tuple[str, ...] = ("09:20", "18:20")
    push_count: int = 5
    source_count: int = 3
    rank_threshold: float = 0.75
    trend_window_hours: int = 6
    stale_hours: int = 24
    archive_recall_days: int = 30
    candidate_limit: int = 20
    merge_threshold: float = 0.82
    rule_merge_threshold: float = 0.55
    stale_merge_threshold: float = 0.88
    merge_similarity: float = 0.7
    merge_candidate_limit: int = 15
    merge_confidence: float = 0.6
    min_trend_samples: int = 3
    min_trend_heat: float = 1.5
    repeat_source_add: int = 2
    repeat_rank_improve: float = 0.15
    repeat_score_improve: float = 12.0
    dimensions: int = 768
    embedding_budget: int = 50
    vector_similarity: float = 0.78
    vector_limit: int = 10
    enrichment_budget: int = 5
    min_title_length: int = 14
    retry_cooldown_hours: int = 12
    time_zone: str = "Asia/Shanghai"
    source_weights: dict[str, float] = field(default_factory=dict)
    blacklist: tuple[str, ...] = ()
    embedding_model: str = "model"
    embedding_version: str = "v1"
    #: Model by stage, and its prices of a million tokens (input, output, cached).
    models: dict[str, str] = field(default_factory=dict)
    prices: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    def validate(self) -> list[str]:
        """What is wrong, in words; empty if all is well."""
        bad = []
        ratios = "rank_threshold merge_threshold rule_merge_threshold stale_merge_threshold merge_similarity merge_confidence vector_similarity repeat_rank_improve".split()
        bad += [f"{n} must be from 0 to 1" for n in ratios if not 0 <= getattr(self, n) <= 1]
        positive = "history_hours push_count source_count trend_window_hours stale_hours archive_recall_days candidate_limit merge_candidate_limit min_trend_samples dimensions vector_limit".split()
        bad += [f"{n} must be positive" for n in positive if getattr(self, n) < 1]
        bad += [f"push time {t} must be HH:mm" for t in self.push_times if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", t)]
        bad += [f"weight of {s} must be finite and not negative" for s, w in self.source_weights.items() if not 0 <= w < float("inf")]
        if self.history_hours < self.stale_hours:
            bad.append("history_hours must not be under stale_hours")
        return bad


# The keys of a configuration file.
PATHS = {
    "history_hours": "analysis.historyHours", "push_times": "analysis.push.pushTime", "push_count": "analysis.push.pushCount", "source_count": "analysis.event.sourceCount",
    "rank_threshold": "analysis.event.normalizedRankThreshold", "trend_window_hours": "analysis.event.trendWindowHours", "stale_hours": "analysis.event.staleHours",
    "archive_recall_days": "analysis.event.archiveRecallDays", "candidate_limit": "analysis.event.candidateLimit", "merge_threshold": "analysis.event.mergeThreshold",
    "rule_merge_threshold": "analysis.event.ruleMergeThreshold", "stale_merge_threshold": "analysis.event.staleMergeThreshold", "merge_similarity": "analysis.event.mergeSimilarityThreshold",
    "merge_candidate_limit": "analysis.event.mergeCandidateLimit", "merge_confidence": "analysis.event.mergeLlmConfidenceThreshold", "min_trend_samples": "analysis.event.minTrendSamples",
    "min_trend_heat": "analysis.event.minTrendHeat", "repeat_source_add": "analysis.repeatPush.sourceAddThreshold", "repeat_rank_improve": "analysis.repeatPush.rankScoreImproveThreshold",
    "repeat_score_improve": "analysis.repeatPush.scoreImproveThreshold", "dimensions": "llm.embedding.dimensions", "embedding_budget": "llm.embedding.maxRequestsPerRun",
    "vector_similarity": "llm.embedding.vectorSimilarityThreshold", "vector_limit": "llm.embedding.vectorCandidateLimit", "time_zone": "system.timeZone",
    "enrichment_budget": "enrichment.maxRequestsPerRun", "min_title_length": "enrichment.minTitleLength", "retry_cooldown_hours": "enrichment.retryCooldownHours", "blacklist": "filters.blacklistKeywords",
}
#: Spellings of earlier versions, and keys that are refused with advice.
RENAMED = {"web_extract_url": "webExtractUrl"}
REFUSED = {"maxParallelLlm": "set maxParallel of llm.cluster, llm.judge, llm.tagging and llm.embedding instead"}


def from_tree(tree: dict) -> Config:
    """A configuration from nested keys; unknown ones are ignored, values that break a rule are refused."""
    values: dict = {}
    for f in fields(Config):
        node = tree
        for part in PATHS.get(f.name, "").split("."):
            node = node.get(part) if isinstance(node, dict) else None
        if node is not None:
            values[f.name] = tuple(node) if f.name in ("push_times", "blacklist") else node
    cfg = Config(**values)
    if bad := cfg.validate():
        raise ValueError("; ".join(bad))
    return cfg


def load_config(path: str) -> Config:
    """Reads a YAML file (with PyYAML, where it is installed)."""
    import yaml

    text = Path(path).read_text(encoding="utf-8")
    for line in text.splitlines():
        key = line.strip().split(":", 1)[0]
        if key in REFUSED and ":" in line:
            raise ValueError(f"{key} is no longer supported: {REFUSED[key]}")
    for old, new in RENAMED.items():
        text = re.sub(rf"\b{old}:", f"{new}:", text)
    tree = yaml.safe_load(text)
    if not isinstance(tree, dict):
        raise ValueError(f"{path} is empty")
    return from_tree(tree)
