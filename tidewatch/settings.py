"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SplitParams:
    val_size: float = 0.15
    test_size: float = 0.15
    seed: int = 42
    # Hex digits of the hash used as bucket: 16**digits buckets per class.
    bucket_digits: int = 3


@dataclass(frozen=True)
class ForestParams:
    trees: int = 300
    depth: int = 20
    min_leaf: int = 5
    feature_subset: str = "sqrt"
    seed: int = 42
    # Bins of a column, and cells (node, column, bin) that a task adds up at once.
    bins: int = 64
    cells: int = 4_000_000


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 300
    depth: int = 6
    rate: float = 0.1
    row_sample: float = 0.8
    # Columns drawn for each tree.
    column_sample: float = 0.8
    patience: int = 20
    seed: int = 42
    l2: float = 1.0
    # Least sum of Hessians in a child.
    least_hessian: float = 1.0
    # Bins of a column, and trees after which margins are stored.
    bins: int = 128
    refresh: int = 10


@dataclass(frozen=True)
class PanelParams:
    """Quality figures quoted to the reader of a prompt; feed them from the results table."""

    boosted_auc: float = 0.927
    forest_auc: float = 0.921


@dataclass(frozen=True)
class GenerationParams:
    models: tuple[str, ...] = ("qwen", "gemma")
    attempts: int = 4
    # First customers of a batch run, for a dry run.
    limit: int | None = None
    # Prompts per call of the client.
    batch_size: int = 32
    # What a client's exception does: "reply" makes it an unusable reply, "raise" stops the job.
    on_error: str = "reply"
    # Slices of a run that are committed one by one; fixed for the life of a sink.
    buckets: int = 8


@dataclass(frozen=True)
class AttributionParams:
    # Memory of the paths a worker keeps between batches; those of further trees are made anew.
    path_bytes: int = 256 << 20
    # Rows x quadrature points x levels worked on at once.
    cells: int = 2_000_000
    # Nodes of all trees that may be broadcast.
    most_nodes: int = 5_000_000
