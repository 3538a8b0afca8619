"""Named queries over the driver's tables, each with its check SQL where SQL can express it."""

from marketloom.registry.base import QUERIES, SQL  # noqa: F401


def load() -> None:
    """Import every group so that its queries register."""
    import importlib

    for group in GROUPS:
        importlib.import_module(f"marketloom.registry.{group}")


GROUPS = ["recs", "toolbox", "market", "lists", "evals", "io"]
