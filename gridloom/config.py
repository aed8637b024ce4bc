"""Run parameters, one dataclass per command."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SegmentConfig:
    """Parameters of the segmentation plan (fixed defaults)."""

    input_directory: str = ""
    output_directory: str = ""
    platform: str | None = None
    cells_representation_mode: str = "pca"
    cells_embedding_size: int = 128
    cells_min_counts: int = 10
    cells_clusters_n_neighbors: int = 10
    cells_clusters_resolution: float = 2.0
    cells_clusters_min_size: int = 100
    genes_min_counts: int = 100
    genes_clusters_n_neighbors: int = 5
    genes_clusters_resolution: float = 2.0
    transcripts_graph_max_k: int = 5
    transcripts_graph_max_dist: float = 5.0
    segmentation_graph_mode: str = "nucleus"
    segmentation_graph_negative_edge_rate: float = 1.0
    prediction_graph_mode: str = "cell"
    prediction_graph_max_k: int = 3
    prediction_graph_buffer_ratio: float = 0.05
    tiling_mode: str = "adaptive"
    tiling_margin_training: float = 20.0
    tiling_margin_prediction: float = 20.0
    tiling_nodes_per_tile: int = 50_000
    tiling_side_length: float = 250.0
    training_fraction: float = 0.75
    edges_per_batch: int = 1_000_000
    gene_corr_reference_path: str | None = None
    gene_missing_strategy: str = "error"
    hidden_channels: int = 64
    out_channels: int = 64
    n_mid_layers: int = 2
    n_heads: int = 2
    in_channels: int = 16
    sg_loss_type: str = "triplet"
    tx_margin: float = 0.3
    sg_margin: float = 0.4
    tx_weight: tuple[float, float] = (1.0, 1.0)
    bd_weight: tuple[float, float] = (1.0, 1.0)
    sg_weight: tuple[float, float] = (0.0, 0.5)
    n_epochs: int = 20
    use_positional_embeddings: bool = True
    normalize_embeddings: bool = True
    save_matrix: bool = True
    debug: bool = False
    scores: str = "train"
    weights: str | None = None

    def __post_init__(self) -> None:
        positive = (
            "cells_embedding_size",
            "cells_clusters_n_neighbors",
            "genes_clusters_n_neighbors",
            "transcripts_graph_max_k",
            "transcripts_graph_max_dist",
            "tiling_nodes_per_tile",
            "tiling_side_length",
            "edges_per_batch",
        )
        for name in positive:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        choices = {
            "segmentation_graph_mode": ("nucleus", "cell"),
            "prediction_graph_mode": ("nucleus", "cell", "uniform"),
            "tiling_mode": ("adaptive", "square"),
            "gene_missing_strategy": ("error", "remove", "fill"),
            "cells_representation_mode": ("pca", "morphology"),
            "sg_loss_type": ("triplet", "bce"),
            "scores": ("train", "weights", "profiles"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if not 0.0 < self.training_fraction <= 1.0:
            raise ValueError("training_fraction must lie in (0, 1]")


@dataclass(frozen=True)
class ExportConfig:
    """Parameters of the export plan (fixed defaults)."""

    segmentation_path: str = ""
    source_path: str = ""
    output_directory: str = ""
    elements: tuple[str, ...] = ("matrix", "boundaries")
    method: str = "delaunay"
    chaikin_iterations: int = 0
    include_all_transcripts: bool = False
    min_similarity: float | None = None
    min_transcripts: int = 10

    def __post_init__(self) -> None:
        unknown = set(self.elements) - {"matrix", "transcripts", "boundaries"}
        if unknown:
            raise ValueError(f"unknown export elements: {', '.join(sorted(unknown))}")
        if self.method not in ("delaunay", "convex_hull"):
            raise ValueError(f"unknown boundary method: {self.method!r}")
        if self.chaikin_iterations < 0 or self.min_transcripts < 0:
            raise ValueError("chaikin_iterations and min_transcripts must not be negative")
