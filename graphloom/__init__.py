"""Knowledge graphs from text on Spark: extraction, merging, de-duplication, retrieval, evaluation."""

from importlib import import_module

#: Public names and the modules they live in; loaded when first asked for.
_PUBLIC = {
    "ExtractConfig": "operators.extract",
    "KGFrames": "schema",
    "PropertyGraphSink": "sources.sinks",
    "aggregate": "operators.graph",
    "build": "operators.graph",
    "connection": "sources.sinks",
    "dashboard": "sources.sinks",
    "deduplicate": "operators.dedupe",
    "extract": "operators.extract",
    "generate": "operators.extract",
    "repair": "operators.graph",
    "retrieve": "operators.retrieve",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
