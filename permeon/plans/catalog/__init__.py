"""The registered queries, by topic."""

from importlib import import_module

TOPICS = ("tables", "analysis", "preparation", "ensembles", "learning", "texts", "streams", "batches")


def load():
    """(queries, SQL twins) of every topic."""
    from permeon.plans.catalog.registry import ORACLES, QUERIES

    for topic in TOPICS:
        import_module(f"permeon.plans.catalog.{topic}")
    return dict(QUERIES), dict(ORACLES)
