"""Preprocessing as an ordered list of (action, parameters)."""

from __future__ import annotations

from cellsail.frame import ExpressionFrame
from cellsail.operators.selection import dropout_by_curve, dropout_genes, dropout_statistics, variable_genes
from cellsail.operators.transforms import binarize, log_scale, normalize_cells, normalize_groups, standardize


def _dropout(frame: ExpressionFrame, n_genes: int | None = 1000, x_offset: float = 5.0, decay: float = 1.0, y_offset: float = 0.02, threshold: float = 0, at_least: int = 0) -> ExpressionFrame:
    """The genes that a curve selects, moved so that there are n_genes or, without n_genes, at x_offset."""
    if n_genes is None:
        return frame.keep_genes(dropout_by_curve(dropout_statistics(frame, threshold, at_least), decay, x_offset, y_offset))
    return frame.keep_genes(dropout_genes(frame, n_genes, decay, y_offset, threshold, at_least))


ACTIONS = {
    "log": log_scale,
    "binarize": binarize,
    "normalize": normalize_cells,
    "normalize_groups": normalize_groups,
    "standardize": standardize,
    "variable_genes": lambda frame, **kw: frame.keep_genes(variable_genes(frame, **kw)),
    "dropout_genes": _dropout,
}
DEFAULT = [("normalize", {}), ("log", {}), ("variable_genes", {}), ("standardize", {})]


def warnings_for(steps: list[tuple[str, dict]]) -> list[str]:
    """Dropout statistics need raw counts: says where they come after a normalization or a logarithm."""
    last = {name: i for i, (name, _) in enumerate(steps)}
    return [f"dropout_genes after {other}" for other in ("normalize", "log") if last.get("dropout_genes", -1) > last.get(other, len(steps))]


def run(frame: ExpressionFrame, steps: list[tuple[str, dict]] | None = None) -> ExpressionFrame:
    """All steps as one lazy plan; missing values are 0."""
    frame = frame.fill_missing()
    for name, parameters in DEFAULT if steps is None else steps:
        frame = ACTIONS[name](frame, **parameters)
    return frame
