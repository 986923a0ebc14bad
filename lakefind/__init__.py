"""Search and faceting over lake tables, on Spark."""

_HOME = {"Engine": "engine", "Index": "engine", "Corpus": "plans.compile", "Schema": "schema", "VersionedTable": "sources.table", "ingest": "sources.ingest", "Lines": "sources.ingest"}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    # tasks import the package too, for single functions; they need not load all of it
    if name not in _HOME:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_HOME[name]}", __name__), name)
