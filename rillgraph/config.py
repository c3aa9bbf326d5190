"""Options of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: In the order in which the global merge visits them.
SUBJECTS = ("social", "economic", "international", "political", "science_tech", "cultural_art", "sport", "medical")
#: Posts that reach no subject in the published statistics: the target of the calibration.
UNLABELLED_POSTS = 795


@dataclass(frozen=True)
class Options:
    """Every option with its default. Nothing here is a Spark setting. The ``*_client`` options name a function as
    ``module:name`` that gives a model: see :mod:`rillgraph.plans.clients`."""

    data_file: str = "AllData.npy"  # the posts, where the command line names none
    window_hours: float = 12  # 0: the windows of the file
    max_windows: int | None = None
    subject_backend: str = "keyword"
    subject_client: str = ""
    subject_model: str = ""
    thresh_ps: float = 0.5
    subject_score_mode: str = "softmax"
    calibrate_thresh_ps: bool = False
    kg_backend: str = "heuristic"
    kg_client: str = ""
    kg_model: str = ""
    kg_dir: str = "KnowledgeGraphs"  # the store, where the command line names none
    kg_workers: int = 8  # tasks that ask a client at once
    kg_max_retries: int = 5
    kg_temperature: float | None = None
    kg_max_triples_per_post: int = 32
    embed_backend: str = "hashing"
    embed_client: str = ""
    embed_model: str = ""
    embed_batch_size: int = 64
    embed_max_length: int = 32
    embed_dim_hashing: int = 512
    embed_cache: str = "cache/embeddings"
    t_n: float = 0.15
    t_e: float = 0.20
    ts_seconds: int = 60
    weight_min: float = 0.1
    weight_max: float = 1.0
    t_d: float = 1.2
    forget_every: int = 1
    clustering: str = "louvain"
    spectral_clusters: int = 8
    hcluster_distance: float = 0.5
    thresh_ts: float = 2.0
    titles_per_event: int = 3
    min_event_size: int = 2
    out_dir: str = "SystemResults"
    seed: int = 1234
    verbose: bool = True  # print the statistics of a run

    def stamp(self) -> str:
        """``key-value`` pairs joined by ``_`` that tell parameter sets apart in result paths."""
        parts = {"win": self.window_hours, "tn": self.t_n, "te": self.t_e, "td": self.t_d, "ts": self.thresh_ts, "ps": self.thresh_ps, "clu": self.clustering}
        return "_".join(f"{k}-{v}" for k, v in parts.items())


def parse_stamp(stamp: str) -> dict[str, str]:
    """The pairs of a stamp. Only the first ``-`` of a pair separates, so values such as ``1e-05`` survive."""
    return dict(part.split("-", 1) for part in stamp.split("_") if "-" in part)


def stamped_path(out_dir: str, base: str, stamp: str, extension: str = "") -> str:
    """Where a result of one parameter set lies."""
    return f"{out_dir.rstrip('/')}/{base}_{stamp}{extension}"


def options_from(values: dict) -> Options:
    """Options with those of ``values`` that are options and not None."""
    known = {f.name for f in fields(Options)}
    return Options(**{k: v for k, v in values.items() if k in known and v is not None})
