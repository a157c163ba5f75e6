"""The size of the batches that pass between the JVM and Python; see ``dossiergrid.batches``."""

from dossiergrid.batches import KEY, ROWS, bound_batches

__all__ = ["KEY", "ROWS", "bound_batches"]
