"""Bindings of the operators to the driver tables, one module per family."""

from prefspark.plans import registry

FAMILIES = (
    "scalars",
    "labelling",
    "evaluation",
    "signals_q",
    "matching",
    "queue_q",
    "event_rules",
    "vectors_q",
    "sources_q",
    "feature_store",
    "streams",
)


def load_all() -> dict[str, registry.Query]:
    """Import every family module and return the filled registry."""
    import importlib

    for name in FAMILIES:
        importlib.import_module(f"prefspark.plans.{name}")
    return registry.REGISTRY
